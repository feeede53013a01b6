"""Cues: limits, gaps, capitals, speaker marks, tracks and lookups by time, as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import intervals as iv


def _order() -> Window:
    return Window.partitionBy("media_id").orderBy("start", "idx")


def _before() -> Window:
    return _order().rowsBetween(Window.unboundedPreceding, -1)


def clamp(cues: DataFrame, media_end: Column, most: float = 7.0) -> DataFrame:
    """Cues within the medium and at most `most` seconds long; those that start in its last 0.2 s or end up empty go."""
    end = F.least("end", media_end, F.col("start") + most)
    return cues.where(F.col("start") < media_end - 0.2).withColumn("end", end).where("end > start")


def bridge_gaps(cues: DataFrame, least: float = 0.08, most: float = 1.0, longest: float = 7.0) -> DataFrame:
    """Gaps between 0.08 and 1 s shrink to 0.08 s, as far as cues may grow."""
    following = F.lead("start").over(_order())
    gap = following - F.col("end")
    return cues.withColumn("end", F.when((gap > least) & (gap < most), F.greatest("end", F.least(following - least, F.col("start") + longest))).otherwise(F.col("end")))


def capitalize(cues: DataFrame) -> DataFrame:
    """The first text, and every one after a text that ends a sentence, starts with a capital; empty texts do not count."""
    last = F.last(F.when(F.col("text") != "", F.col("text")), ignorenulls=True).over(_before())
    starts = (F.col("text") != "") & (last.isNull() | last.rlike('[.!?…"\'）」]$'))
    return cues.withColumn("text", F.when(starts, F.concat(F.upper(F.substring("text", 1, 1)), F.substr("text", F.lit(2)))).otherwise(F.col("text")))


def marked() -> Column:
    """Whether a known speaker is not the last known one, as the first is not."""
    last = F.last("speaker", ignorenulls=True).over(_before())
    return F.col("speaker").isNotNull() & ~F.col("speaker").eqNullSafe(last)


def speaker_marks(cues: DataFrame, mark: str = "— ") -> DataFrame:
    """A dash before the text where the speaker changes."""
    return cues.withColumn("text", F.when(marked(), F.concat(F.lit(mark), "text")).otherwise(F.col("text")))


def close_at_pauses(pieces: DataFrame, pause: float = 0.8) -> DataFrame:
    """A full stop where a text ends in a letter or digit and the next, a pause later, starts with a capital."""
    text = F.rtrim("text")
    following, at = F.lead("text").over(_order()), F.lead("start").over(_order())
    ends = text.rlike(r"[\p{L}\p{N}]$") & F.ltrim(following).rlike(r"^\p{Lu}") & (at - F.col("end") >= pause)
    return pieces.withColumn("text", F.when(ends, F.concat(text, F.lit("."))).otherwise(F.col("text")))


def combine_tracks(cues: DataFrame) -> DataFrame:
    """media_id, start, end, text: between neighbouring end points all texts shown, by start; equal neighbours are one."""
    cells = iv.elementary(cues)
    shown = iv.overlap_join(cells, cues).groupBy("media_id", "start", "end")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("b_start").alias("s"), F.col("b_idx").alias("i"), F.col("b_text").alias("t")))), lambda x: x["t"]), "\n")
    rows = shown.agg(text.alias("text"))
    order = Window.partitionBy("media_id").orderBy("start")
    new = (F.lag("end").over(order) == F.col("start")) & (F.lag("text").over(order) == F.col("text"))
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(new, F.lit(False)), 0).otherwise(1)).over(order))
    return rows.groupBy("media_id", "run", "text").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def cue_at(cues: DataFrame, points: DataFrame) -> DataFrame:
    """points (media_id, point_idx, t) with the first cue that is shown at t, or null."""
    found = iv.contains_join(cues, points).groupBy("media_id", "point_idx").agg(F.min(F.struct("start", "idx")).alias("c"))
    return points.join(found, ["media_id", "point_idx"], "left").select("media_id", "point_idx", F.col("c.idx").alias("idx"))


def next_cue(cues: DataFrame, points: DataFrame, slack: float = 0.05) -> DataFrame:
    """points with the cue of the first start after t + slack, else the last cue: an as-of join by union and window."""
    both = cues.select("media_id", F.col("start").alias("at"), F.lit(1).alias("kind"), "idx", F.lit(None).cast("long").alias("point_idx"))
    both = both.unionByName(points.select("media_id", (F.col("t") + slack).alias("at"), F.lit(2).alias("kind"), F.lit(None).cast("long").alias("idx"), "point_idx"))
    order = Window.partitionBy("media_id").orderBy("at", "kind", "idx")
    backwards = Window.partitionBy("media_id").orderBy(F.desc("at"), F.desc("kind"), F.desc("idx"))
    after = F.last("idx", ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, -1))
    latest = F.last("idx", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("found", F.coalesce(after, latest)).where("kind = 2").select("media_id", "point_idx", F.col("found").alias("idx"))


def previous_cue(cues: DataFrame, points: DataFrame, slack: float = 0.05, restart: float = 1.0) -> DataFrame:
    """points with the cue that is gone back to: the one that is shown, if it began more than `restart` seconds ago, else the
    last one that began before t - slack, else the first."""
    both = cues.select("media_id", F.col("start").alias("at"), F.lit(2).alias("kind"), "idx", F.lit(None).cast("long").alias("point_idx"))
    both = both.unionByName(points.select("media_id", (F.col("t") - slack).alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("idx"), "point_idx"))
    order = Window.partitionBy("media_id").orderBy("at", "kind", "idx")
    before = F.last("idx", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("idx", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("found", F.coalesce(before, first)).where("kind = 1").select("media_id", "point_idx", "found")
    shown = cue_at(cues, points).select("media_id", "point_idx", F.col("idx").alias("shown")).join(cues.select("media_id", F.col("idx").alias("shown"), "start"), ["media_id", "shown"]).join(points, ["media_id", "point_idx"])
    again = shown.where(F.col("t") - F.col("start") > restart).select("media_id", "point_idx", "shown")
    return found.join(again, ["media_id", "point_idx"], "left").select("media_id", "point_idx", F.coalesce("shown", "found").alias("idx"))


def prose(pieces: DataFrame, pause: float = 10.0) -> DataFrame:
    """media_id, text: trimmed texts in paragraphs, a new one after `pause` seconds since the last kept piece."""
    kept = pieces.withColumn("text", F.trim("text")).where("text <> ''")
    kept = kept.withColumn("para", F.sum(F.when(F.col("start") - F.lag("end").over(_order()) >= pause, 1).otherwise(0)).over(_order()))
    joined = lambda value, *order: F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value])
    paragraphs = kept.groupBy("media_id", "para").agg(F.array_join(joined("text", "start", "idx"), " ").alias("text"))
    return paragraphs.groupBy("media_id").agg(F.array_join(joined("text", "para"), "\n\n").alias("text"))


def fix_overlaps(cues: DataFrame) -> DataFrame:
    """Cues by start and idx, numbered anew; each starts at the end of the one before at the earliest, and one left without
    length gets 0.4 s. What a cue's end becomes decides the next one's start, so a medium's times, and nothing else, are
    one fold over arrays."""
    import numpy as np

    def run(frames):
        import pandas as pd

        for frame in frames:
            starts, ends = [], []
            for a, b in zip(frame["starts"], frame["ends"], strict=True):
                reach, s, e = -np.inf, [], []
                for x, y in zip(a, b, strict=True):
                    x = max(x, reach)
                    reach = y if y > x else x + 0.4
                    s.append(x), e.append(reach)
                starts.append(s), ends.append(e)
            yield pd.DataFrame({"media_id": frame["media_id"], "starts": starts, "ends": ends})

    n = F.row_number().over(_order())
    rows = cues.withColumn("n", n)
    times = rows.groupBy("media_id").agg(F.sort_array(F.collect_list(F.struct("n", "start", "end"))).alias("x"))
    times = times.select("media_id", F.transform("x", lambda x: x["start"]).alias("starts"), F.transform("x", lambda x: x["end"]).alias("ends"))
    fixed = times.mapInPandas(run, "media_id long, starts array<double>, ends array<double>")
    fixed = fixed.select("media_id", F.posexplode(F.arrays_zip("starts", "ends")).alias("n", "t")).select("media_id", (F.col("n") + 1).alias("n"), "t.starts", "t.ends")
    return rows.join(fixed, ["media_id", "n"]).withColumn("start", F.col("starts")).withColumn("end", F.col("ends")).withColumn("idx", F.col("n")).drop("n", "starts", "ends")
