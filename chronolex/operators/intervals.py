"""Interval kit: joins on overlap, unions, gaps and islands, all keyed by media_id.

Overlap joins put every interval into time buckets and join on (media_id, bucket), so that a long medium is spread over
tasks; a pair is kept in the first bucket that both share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 64.0


def bucketed(df: DataFrame, start: str, end: str, width: float = BUCKET) -> DataFrame:
    first, last = F.floor(F.col(start) / width), F.floor(F.greatest(start, end) / width)
    return df.withColumn("bucket", F.explode(F.sequence(first, last)))


def overlap_join(a: DataFrame, b: DataFrame, *, how: str = "inner", width: float = BUCKET) -> DataFrame:
    """Pairs with a.start < b.end and b.start < a.end of one media_id. b's columns get the prefix `b_`.

    how: inner, left_semi or left_anti (for these a must be free of repeated rows).
    """
    b = b.select(*[F.col(c).alias(c if c == "media_id" else f"b_{c}") for c in b.columns])
    left, right = bucketed(a, "start", "end", width), bucketed(b, "b_start", "b_end", width)
    pairs = left.join(right, ["media_id", "bucket"]).where((F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end")))
    pairs = pairs.where(F.col("bucket") == F.floor(F.greatest("start", "b_start") / width)).drop("bucket")
    if how == "inner":
        return pairs
    same = [a[c].eqNullSafe(F.col(f"k_{c}")) for c in a.columns]
    keys = pairs.select(*[F.col(c).alias(f"k_{c}") for c in a.columns]).distinct()
    condition = same[0]
    for c in same[1:]:
        condition = condition & c
    return a.join(keys, condition, how)


def contains_join(a: DataFrame, points: DataFrame, *, width: float = BUCKET) -> DataFrame:
    """Pairs with a.start <= t < a.end of one media_id; points has media_id and t."""
    left = bucketed(a, "start", "end", width)
    right = points.withColumn("bucket", F.floor(F.col("t") / width))
    return left.join(right, ["media_id", "bucket"]).where((F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))).drop("bucket")


def overlap(a_start: str = "start", a_end: str = "end", b_start: str = "b_start", b_end: str = "b_end") -> Column:
    return F.least(a_end, b_end) - F.greatest(a_start, b_start)


def _before(keys: list[str], *order: str) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def union_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and length: the measure of the union of the intervals of each key."""
    reach = F.max("end").over(_before(keys, "start", "end"))
    own = F.greatest(F.lit(0.0), F.col("end") - F.greatest(F.coalesce(reach, F.col("start")), F.col("start")))
    return df.withColumn("own", own).groupBy(*keys).agg(F.sum("own").alias("length"))


def merge_regions(df: DataFrame, keys: list[str], gap: float = 0.5) -> DataFrame:
    """keys, region, start, end: intervals joined while the next starts at most `gap` after the running end."""
    reach = F.max("end").over(_before(keys, "start", "end"))
    order = Window.partitionBy(*keys).orderBy("start", "end")
    df = df.withColumn("new", F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0))
    df = df.withColumn("region", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "region").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def gaps(regions: DataFrame, keys: list[str], least: float = 0.0) -> DataFrame:
    """keys, start, end between a region and the next one, if that is longer than `least` and positive."""
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("start", "end"))
    out = regions.select(*keys, F.col("end").alias("start"), following.alias("end"))
    return out.where((F.col("end") - F.col("start") > 0) & (F.col("end") - F.col("start") >= least))


def elementary(df: DataFrame) -> DataFrame:
    """media_id, start, end between neighbouring end points of any interval."""
    points = df.select("media_id", F.col("start").alias("p")).union(df.select("media_id", F.col("end"))).distinct()
    return points.select("media_id", F.col("p").alias("start"), F.lead("p").over(Window.partitionBy("media_id").orderBy("p")).alias("end")).where("end IS NOT NULL")


def uncovered(regions: DataFrame, key: str, cues: DataFrame) -> DataFrame:
    """media_id, key, start, end: what is left of each region (media_id, key, start, end) without the union of the cues."""
    cut = overlap_join(regions, merge_regions(cues.select("media_id", "start", "end"), ["media_id"], gap=0.0).drop("region"))
    parts = cut.select("media_id", key, "start", "end", F.greatest("start", "b_start").alias("a"), F.least("end", "b_end").alias("b"))
    order = Window.partitionBy("media_id", key).orderBy("a")
    before = parts.select("media_id", key, F.coalesce(F.lag("b").over(order), F.col("start")).alias("start"), F.col("a").alias("end"))
    last = parts.groupBy("media_id", key).agg(F.max("b").alias("start"), F.first("end").alias("end"))
    whole = regions.join(parts.select("media_id", key).distinct(), ["media_id", key], "left_anti").select("media_id", key, "start", "end")
    return before.unionByName(last).unionByName(whole).where("end > start")


#: Times as whole numbers, so that running sums are exact: this many a second.
TICKS = 1e9


def talked(pieces: DataFrame, turns: DataFrame) -> DataFrame:
    """media_id, piece_idx, speaker, seconds, n, last: for each piece and each speaker with a turn that overlaps it, how long
    those turns overlap it together, how many they are, and the greatest turn_idx of them (null where that takes a look at
    the turns themselves, see `assign`).

    No pairs are made.  What a speaker has talked up to a time is a running sum over the ends of turns; a piece's share is the
    difference of two such sums.  Turns that overlap are those begun before the piece's end less those ended by its start.  So
    the rows grow with pieces times speakers of a medium, however dense its turns are.
    """
    tick = lambda c: F.round(F.col(c) * TICKS).cast("long")
    none = F.lit(None)
    speakers = turns.select("media_id", "speaker").distinct()
    # At equal times ends come first, then what is asked for, then starts.
    known = turns.select("media_id", "speaker", "turn_idx", tick("start").alias("s"), tick("end").alias("e"))
    begun = F.struct(F.col("s").alias("t"), F.lit(2).alias("o"), F.lit(1).alias("step"), F.col("s").alias("move"), F.struct("turn_idx", "e").alias("turn"))
    ended = F.struct(F.col("e").alias("t"), F.lit(0).alias("o"), F.lit(-1).alias("step"), (-F.col("e")).alias("move"), none.cast("struct<turn_idx: bigint, e: bigint>").alias("turn"))
    borders = known.select("media_id", "speaker", none.cast("long").alias("piece_idx"), F.explode(F.array(begun, ended)).alias("x"))
    point = lambda c: F.struct(tick(c).alias("t"), F.lit(1).alias("o"), F.lit(0).alias("step"), F.lit(0).cast("long").alias("move"), none.cast("struct<turn_idx: bigint, e: bigint>").alias("turn"))
    asked = pieces.select("media_id", "piece_idx", F.explode(F.array(point("start"), point("end"))).alias("x")).join(speakers, "media_id").select("media_id", "speaker", "piece_idx", "x")
    rows = borders.unionByName(asked).select("media_id", "speaker", "piece_idx", "x.*")
    so_far = Window.partitionBy("media_id", "speaker").orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0)
    sums = [F.sum("step").over(so_far).alias("open"), F.sum("move").over(so_far).alias("moved"), F.count_if(F.col("o") == 2).over(so_far).alias("begun"), F.count_if(F.col("o") == 0).over(so_far).alias("ended"), F.max("turn").over(so_far).alias("turn")]
    at = rows.select("media_id", "speaker", "piece_idx", "t", "o", *sums).where("o = 1").withColumn("said", F.col("t") * F.col("open") - F.col("moved"))
    first = F.min(F.struct("t", "said", "ended")).alias("a")
    last = F.max(F.struct("t", "said", "begun", "turn")).alias("b")
    both = at.groupBy("media_id", "piece_idx", "speaker").agg(first, last)
    n = F.col("b.begun") - F.col("a.ended")
    latest = F.when(F.col("b.turn.e") > F.col("a.t"), F.col("b.turn.turn_idx"))
    return both.select("media_id", "piece_idx", "speaker", F.round((F.col("b.said") - F.col("a.said")) / TICKS, 7).alias("seconds"), n.alias("n"), latest.alias("last")).where("n > 0")


def intersection(a: DataFrame, b: DataFrame, a_keys: list[str], b_keys: list[str]) -> DataFrame:
    """a_keys and b_keys, start, end: where the unions of the intervals of each key overlap; both have media_id among their keys."""
    left = merge_regions(a, a_keys, gap=0.0).drop("region")
    right = merge_regions(b, b_keys, gap=0.0).drop("region")
    pairs = overlap_join(left, right)
    return pairs.select(*a_keys, *[F.col(f"b_{k}").alias(k) for k in b_keys if k != "media_id"], F.greatest("start", "b_start").alias("start"), F.least("end", "b_end").alias("end"))
