"""Frames, voiced regions and loudness of signals: media_id, sample_idx, v."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators.intervals import gaps


def order_statistic(values: Column, rank: Column) -> Column:
    """The value at a 0-based rank of a group's values, as an aggregate; a group's frames fit in a row."""
    return F.get(F.sort_array(F.collect_list(values)), rank)


def frames(samples: DataFrame, size: int = 480) -> DataFrame:
    """media_id, frame_idx, rms of whole frames; an incomplete tail is dropped."""
    rows = samples.groupBy("media_id", F.floor(F.col("sample_idx") / size).alias("frame_idx"))
    return rows.agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"), F.count("*").alias("n")).where(F.col("n") == size).drop("n")


def voiced(frames: DataFrame, multiplier: float = 3.0, floor: float = 0.005) -> DataFrame:
    """frames with voiced: rms above floor and above multiplier times the noise, the rms at rank n div 5."""
    ranked = frames.select("media_id", "rms", F.row_number().over(Window.partitionBy("media_id").orderBy("rms")).alias("r"), F.count("*").over(Window.partitionBy("media_id")).alias("n"))
    noise = ranked.where(F.col("r") == F.floor(F.col("n") / 5) + 1).select("media_id", F.col("rms").alias("noise"))
    return frames.join(noise, "media_id").withColumn("voiced", F.col("rms") > F.greatest(F.lit(floor), multiplier * F.col("noise"))).drop("noise")


def regions(voiced: DataFrame, pause: float = 0.6, seconds: float = 0.03) -> DataFrame:
    """media_id, region, start, end of islands of voiced frames, cut where more than int(pause / seconds) frames lie between."""
    order = Window.partitionBy("media_id").orderBy("frame_idx")
    rows = voiced.where("voiced").withColumn("step", F.col("frame_idx") - F.lag("frame_idx").over(order))
    rows = rows.withColumn("region", F.sum(F.when(F.col("step") > int(pause / seconds + 1e-9), 1).otherwise(0)).over(order))
    return rows.groupBy("media_id", "region").agg((F.min("frame_idx") * seconds).alias("start"), ((F.max("frame_idx") + 1) * seconds).alias("end"))


def silences(regions: DataFrame, least: float = 0.8) -> DataFrame:
    return gaps(regions, ["media_id"], least)


def pause_boundaries(regions: DataFrame, least: float = 0.8) -> DataFrame:
    return silences(regions, least).select("media_id", ((F.col("start") + F.col("end")) / 2).alias("t"))


def boost(samples: DataFrame) -> DataFrame:
    """media_id, gain of quiet media: 1e-5 < rms < 0.003 and all samples finite; at most 20, 0.03 / rms and 0.95 / peak."""
    v = F.col("v").cast("double")
    a = samples.groupBy("media_id").agg(F.sqrt(F.avg(v * v)).alias("rms"), F.max(F.abs(v)).alias("peak"), F.bool_and(~F.isnan(v) & (F.abs(v) < float("inf"))).alias("finite"))
    gain = F.least(F.lit(20.0), 0.03 / F.col("rms"), 0.95 / F.col("peak"))
    quiet = F.col("finite") & (F.col("rms") > 1e-5) & (F.col("rms") < 0.003) & (gain > 1)
    return a.select("media_id", F.when(quiet, gain).otherwise(1.0).alias("gain"))


def level(samples: DataFrame, *, window: int = 8000, frame: int = 320, ceiling: float = 20.0, least: float = 0.0005, multiplier: float = 3.0) -> DataFrame:
    """media_id, window_idx, rms, live, gain: how much each window of a medium is raised towards the loud windows.

    The noise is the frames' rms at rank int(0.1 n); a window above max(least, multiplier * noise) is live; the target
    is the live windows' rms at rank int(0.75 n).  All gains are 1 unless more than 3 windows are live, there are more
    than 4, and some gain exceeds 1.05.
    """
    v = F.col("v").cast("double")
    parts = samples.select("media_id", F.floor(F.col("sample_idx") / frame).alias("f"), F.floor(F.col("sample_idx") / window).alias("window_idx"), (v * v).alias("e"))
    small = parts.groupBy("media_id", "window_idx", "f").agg(F.sum("e").alias("e"), F.count("*").alias("n"))
    whole = small.withColumn("rms", F.sqrt(F.col("e") / F.col("n")))
    ranked = whole.select("media_id", "rms", F.row_number().over(Window.partitionBy("media_id").orderBy("rms")).alias("r"), F.count("*").over(Window.partitionBy("media_id")).alias("c"))
    noise = ranked.where(F.col("r") == F.floor(F.col("c") * 0.1) + 1).select("media_id", F.col("rms").alias("noise"))
    rows = small.groupBy("media_id", "window_idx").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("rms")).join(noise, "media_id")
    rows = rows.withColumn("live", F.col("rms") > F.greatest(F.lit(least), multiplier * F.col("noise"))).drop("noise")
    alive = rows.where("live").select("media_id", "rms", F.row_number().over(Window.partitionBy("media_id").orderBy("rms")).alias("r"), F.count("*").over(Window.partitionBy("media_id")).alias("c"))
    target = alive.where(F.col("r") == F.floor(F.col("c") * 0.75) + 1).where("c > 3").select("media_id", F.col("rms").alias("target"))
    rows = rows.join(target, "media_id", "left")
    gain = F.when(F.col("live") & F.col("target").isNotNull(), F.least(F.lit(ceiling), F.greatest(F.lit(1.0), F.col("target") / F.col("rms")))).otherwise(1.0)
    all_of = Window.partitionBy("media_id")
    rows = rows.withColumn("gain", gain).withColumn("raise", (F.max("gain").over(all_of) > 1.05) & (F.count("*").over(all_of) > 4))
    return rows.select("media_id", "window_idx", "rms", "live", F.when(F.col("raise"), F.col("gain")).otherwise(1.0).alias("gain"))


def is_silent(samples: DataFrame) -> DataFrame:
    """media_id, silent: whether every sample is 0."""
    return samples.groupBy("media_id").agg(F.bool_and(F.col("v") == 0).alias("silent"))


def level_samples(samples: DataFrame, levels: DataFrame, *, window: int = 8000) -> DataFrame:
    """samples (media_id, sample_idx, v) times the gain of level(), which goes in a line to that of the next window, and
    held within 0.99. Where nothing is raised the samples stay as they are."""
    order = Window.partitionBy("media_id").orderBy("window_idx")
    gains = levels.select("media_id", "window_idx", "gain", F.coalesce(F.lead("gain").over(order), F.col("gain")).alias("after"), (F.max("gain").over(Window.partitionBy("media_id")) > 1).alias("raised"))
    rows = samples.withColumn("window_idx", F.floor(F.col("sample_idx") / window))
    spans = rows.groupBy("media_id", "window_idx").agg(F.count("*").alias("span"), F.min("sample_idx").alias("first"))
    rows = rows.join(gains.join(spans, ["media_id", "window_idx"]), ["media_id", "window_idx"])
    mix = F.col("gain") + (F.col("after") - F.col("gain")) * ((F.col("sample_idx") - F.col("first")) / F.col("span"))
    raised = F.greatest(F.lit(-0.99), F.least(F.lit(0.99), F.col("v") * mix))
    return rows.select("media_id", "sample_idx", F.when(F.col("raised"), raised).otherwise(F.col("v")).alias("v"))


def prepare(samples: DataFrame, *, window: int = 8000, frame: int = 320, multiplier: float = 3.0) -> DataFrame:
    """Quiet media raised as a whole, then their quiet stretches."""
    boosted = samples.join(boost(samples), "media_id").select("media_id", "sample_idx", (F.col("v") * F.col("gain")).alias("v"))
    return level_samples(boosted, level(boosted, window=window, frame=frame, multiplier=multiplier), window=window)


def fit(pieces: DataFrame, voiced: DataFrame, *, seconds: float = 0.03) -> DataFrame:
    """pieces (media_id, piece_idx, start, end) with their borders moved to where the voice is: a start back by up to
    0.6 s and an end forward by up to 2 s, as long as no 0.25 s of silence lies between, and never into a neighbour.
    Each piece begins where the one before may end, so a medium is one fold over its frames, which are sent as an array."""
    flags = voiced.groupBy("media_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("frame_idx", "voiced"))), lambda x: x["voiced"]).alias("flags"))
    rows = pieces.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("start", "piece_idx", "end"))).alias("pieces")).join(flags, "media_id", "left")

    def reach(flags, at, to, step):
        """The last voiced frame on the way from at to `to`, without crossing 0.25 s of silence; at if there is none."""
        found, silent, stop = at, 0, int(0.25 / seconds)
        while at != to and silent < stop:
            at += step
            found, silent = (at, 0) if flags[at] else (found, silent + 1)
        return found

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for media, some, flags in zip(frame["media_id"], frame["pieces"], frame["flags"], strict=True):
                n = 0 if flags is None else len(flags)
                at = lambda x, n=n: min(n - 1, max(0, int(x / seconds)))
                before = 0.0
                for i, p in enumerate(some):
                    start, end = p["start"], p["end"]
                    after = some[i + 1]["start"] if i + 1 < len(some) else n * seconds
                    if n:
                        onset = reach(flags, at(start), min(at(start), max(at(before), at(start - 0.6))), -1)
                        last, ceiling = at(end), min(at(after), at(end + 2))
                        offset = reach(flags, last, max(last, ceiling), 1)
                        start = max(before, min(start, onset * seconds))
                        end = max(start, min(after, max(end, (offset + (offset > last)) * seconds)))
                    out.append((media, p["piece_idx"], start, end))
                    before = end
            yield pd.DataFrame(out, columns=["media_id", "piece_idx", "start", "end"])

    return rows.mapInPandas(run, "media_id long, piece_idx long, start double, end double")
