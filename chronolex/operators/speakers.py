"""Who speaks: assignment by overlap, labels, voices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.storage import stored
from chronolex.operators.intervals import overlap_join, talked


def assign(pieces: DataFrame, turns: DataFrame) -> DataFrame:
    """pieces with the speaker whose turns overlap a piece most; of equals, the one whose last such turn comes first.

    A piece that no turn overlaps keeps its speaker.  Only where two speakers have talked equally long, and their last turns are
    not told by running sums, are pieces paired with turns.
    """
    sums = stored(talked(pieces.select("media_id", "piece_idx", "start", "end"), turns))
    most = sums.groupBy("media_id", "piece_idx").agg(F.max("seconds").alias("seconds"))
    top = sums.join(most, ["media_id", "piece_idx", "seconds"])
    ties = top.groupBy("media_id", "piece_idx").agg(F.count("*").alias("n"), F.count("last").alias("told"), F.min(F.struct("last", "speaker")).alias("best"))
    clear = ties.where("n = 1 OR told = n").select("media_id", "piece_idx", F.col("best.speaker").alias("found"))
    open_ = pieces.join(ties.where("n > 1 AND told < n").select("media_id", "piece_idx"), ["media_id", "piece_idx"]).select("media_id", "piece_idx", "start", "end")
    lasts = overlap_join(open_, turns).groupBy("media_id", "piece_idx", F.col("b_speaker").alias("speaker")).agg(F.max("b_turn_idx").alias("last"))
    settled = top.drop("last").join(lasts, ["media_id", "piece_idx", "speaker"]).groupBy("media_id", "piece_idx").agg(F.min(F.struct("last", "speaker")).alias("best"))
    best = clear.unionByName(settled.select("media_id", "piece_idx", F.col("best.speaker").alias("found")))
    return pieces.join(best, ["media_id", "piece_idx"], "left").withColumn("speaker", F.coalesce("found", "speaker")).drop("found")


def renumber(pieces: DataFrame, prefix: str = "Speaker ") -> DataFrame:
    """pieces with speakers named by their order of appearance; null stays null."""
    firsts = pieces.where("speaker IS NOT NULL").groupBy("media_id", "speaker").agg(F.min("piece_idx").alias("first"))
    names = firsts.withColumn("name", F.concat(F.lit(prefix), F.row_number().over(Window.partitionBy("media_id").orderBy("first", "speaker")).cast("string"))).drop("first")
    return pieces.join(names, ["media_id", "speaker"], "left").withColumn("speaker", F.col("name")).drop("name")


def prune_tiny(turns: DataFrame, least: float = 2.0) -> DataFrame:
    """turns without the speakers who have less than `least` seconds in a medium, unless all have."""
    totals = turns.groupBy("media_id", "speaker").agg(F.sum(F.col("end") - F.col("start")).alias("total"))
    any_left = F.max(F.col("total") >= least).over(Window.partitionBy("media_id"))
    drop = totals.withColumn("any_left", any_left).where((F.col("total") < least) & F.col("any_left")).select("media_id", "speaker")
    return turns.join(drop, ["media_id", "speaker"], "left_anti")


def boundaries(turns: DataFrame, lead: float = 0.5) -> DataFrame:
    """media_id, t: where the voice changes, `lead` seconds early and not before 0."""
    order = Window.partitionBy("media_id").orderBy("start", "turn_idx")
    rows = turns.select("media_id", "start", "end", "speaker", F.lag("speaker").over(order).alias("previous"), F.lead("speaker").over(order).alias("following"))
    starts = rows.where("previous <> speaker").select("media_id", F.col("start").alias("t"))
    ends = rows.where("following <> speaker").select("media_id", F.col("end").alias("t"))
    return starts.union(ends).select("media_id", F.greatest(F.col("t") - lead, F.lit(0.0)).alias("t")).distinct()


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; 2 if the lengths differ, are 0, or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (F.size(a) == 0) | (norms == 0), F.lit(2.0)).otherwise(1 - dot(a, b) / norms)


def similar_pairs(voices: DataFrame, threshold: float) -> DataFrame:
    """a, b, distance of voices of one medium whose cosine distance is below threshold. voices: media_id, label,
    first_heard, embedding; a medium has a handful of voices, so comparing all of them is bounded."""
    a = voices.select("media_id", F.col("label").alias("a"), F.struct("first_heard", "label").alias("ao"), F.col("embedding").alias("ae"))
    b = voices.select("media_id", F.col("label").alias("b"), F.struct("first_heard", "label").alias("bo"), F.col("embedding").alias("be"))
    pairs = a.join(b, "media_id").where(F.col("ao") < F.col("bo")).withColumn("distance", cosine_distance(F.col("ae"), F.col("be")))
    return pairs.where(F.col("distance") < threshold).select("a", "b", "distance", "ao", "bo")


def group_same_voice(voices: DataFrame, threshold: float = 0.5, rounds: int = 32) -> DataFrame:
    """label, group_label: each voice joins the group of the first earlier voice within threshold (not single linkage)."""
    pairs = similar_pairs(voices, threshold)
    parents = pairs.groupBy(F.col("b").alias("label")).agg(F.min("ao").alias("ao")).select("label", F.col("ao.label").alias("parent"))
    rows = voices.select("label").join(parents, "label", "left").select("label", F.coalesce("parent", "label").alias("group_label"))
    for _ in range(rounds):  # each round halves the way to the root
        up = rows.select(F.col("label").alias("group_label"), F.col("group_label").alias("above"))
        nexts = stored(rows.join(up, "group_label").select("label", F.col("above").alias("group_label"), (F.col("above") != F.col("group_label")).alias("moved")))
        moved = nexts.where("moved").limit(1).count()
        rows = nexts.select("label", "group_label")
        if not moved:
            return rows
    raise RuntimeError(f"voices lead to earlier ones in more than 2 ** {rounds} steps")


def merge_same_voice(turns: DataFrame, voices: DataFrame, threshold: float = 0.5, sample: float = 12.0, least: float = 2.0) -> DataFrame:
    """turns (media_id, turn_idx, label, start, end) with the labels of one voice made the earliest one's. A label's sample are
    its longest turns until they make up `sample` seconds; labels with less than `least` seconds keep their name. voices has
    media_id, label and embedding."""
    length = F.col("end") - F.col("start")
    before = F.sum(length).over(Window.partitionBy("media_id", "label").orderBy(length.desc(), "turn_idx").rowsBetween(Window.unboundedPreceding, -1))
    taken = turns.withColumn("before", before).where(F.coalesce("before", F.lit(0.0)) < sample)
    heard = taken.groupBy("media_id", "label").agg(F.sum(length).alias("seconds")).where(F.col("seconds") >= least).select("media_id", "label")
    firsts = turns.groupBy("media_id", "label").agg(F.min("start").alias("first_heard"))
    known = voices.select("media_id", "label", "embedding").join(heard, ["media_id", "label"]).join(firsts, ["media_id", "label"])
    groups = group_same_voice(stored(known), threshold)
    return turns.join(groups, "label", "left").withColumn("label", F.coalesce("group_label", "label")).drop("group_label")
