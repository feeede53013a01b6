"""Measures over edit paths: rows (key columns, step, kind, i, j) of fold.align(), with i the place in the reference and j
in the hypothesis; and the tables they are about."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.operators import folds as fo

#: Steps of paths that a task holds before it gives them out.
MOST_STEPS = 200_000


def paths(pairs: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """pairs with two arrays of strings -> keys, step, kind, i, j: an edit path of least cost for each pair."""
    types = dict(pairs.dtypes)

    def run(frames):
        import pandas as pd

        for frame in frames:
            made = {name: [] for name in (*keys, "step", "kind", "i", "j")}
            for row in frame.itertuples(index=False):
                steps = fo.align(list(row[-2]), list(row[-1]))
                for name, value in zip(keys, row[:-2], strict=True):
                    made[name] += [value] * len(steps)
                made["step"] += range(len(steps))
                for name, values in zip(("kind", "i", "j"), zip(*steps, strict=True), strict=True) if steps else ():
                    made[name] += values
                if len(made["step"]) > MOST_STEPS:
                    yield pd.DataFrame(made).astype({"i": "Int64", "j": "Int64"})
                    made = {name: [] for name in made}
            yield pd.DataFrame(made).astype({"i": "Int64", "j": "Int64"})

    return pairs.select(*keys, ref, hyp).mapInPandas(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "step int, kind string, i int, j int"]))


def counts(path: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda kind: F.sum((F.col("kind") == kind).cast("long"))
    return path.groupBy(*keys).agg(n("same").alias("same"), n("sub").alias("sub"), n("del").alias("deleted"), n("ins").alias("inserted"))


def counts_of_texts(pairs: DataFrame, keys: list[str], ref: str, hyp: str) -> DataFrame:
    """counts() of paths() of two texts' words, between single spaces.  A task holds the words and the path of one pair at a
    time; the texts come as they are, which is a fraction of their words as arrays."""
    types = dict(pairs.dtypes)
    kinds = {"same": "same", "sub": "sub", "del": "deleted", "ins": "inserted"}

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            made = []
            for a, b in zip(batch.column(ref), batch.column(hyp), strict=True):
                n = Counter(kind for kind, _, _ in fo.align(a.as_py().split(" "), b.as_py().split(" ")))
                made.append([n[kind] for kind in kinds])
            columns = [pa.array([x[i] for x in made], pa.int64()) for i in range(len(kinds))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *columns], names=[*keys, *kinds.values()])

    found = pairs.select(*keys, ref, hyp).mapInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), *(f"{name} long" for name in kinds.values())]))
    return found.groupBy(*keys).agg(*[F.sum(name).alias(name) for name in kinds.values()])


def boundary_score(path: DataFrame, keys: list[str], ref_marks: DataFrame, hyp_marks: DataFrame, slack: int = 2) -> DataFrame:
    """keys, mapped, found, marks, right: boundaries of the reference (keys, i), each at the place of the last word up to
    it that is in the hypothesis; how many have one of the hypothesis (keys, j) within `slack`; and the other way."""
    order = Window.partitionBy(*keys).orderBy("step")
    last = F.last(F.when(F.col("kind").isin("same", "sub"), F.col("j")), ignorenulls=True).over(order)
    at = path.withColumn("m", last).where("i IS NOT NULL").select(*keys, "i", "m")
    mapped = at.join(ref_marks, [*keys, "i"]).where("m IS NOT NULL").select(*keys, "i", "m")
    near = lambda rows, c: rows.withColumn("p", F.explode(F.sequence(F.col(c) - slack, F.col(c) + slack)))
    found = near(mapped, "m").join(hyp_marks.withColumnRenamed("j", "p").distinct(), [*keys, "p"], "left_semi").select(*keys, "i").distinct()
    right = near(hyp_marks, "j").join(mapped.select(*keys, F.col("m").alias("p")).distinct(), [*keys, "p"], "left_semi").select(*keys, "j").distinct()
    parts = [rows.groupBy(*keys).agg(F.count("*").alias(name)) for rows, name in ((mapped, "mapped"), (found, "found"), (hyp_marks, "marks"), (right, "right"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, keys, "full")
    return out.na.fill(0)


def edit_runs(path: DataFrame, keys: list[str], words: DataFrame, kind: str, place: str) -> DataFrame:
    """keys, run: the words (keys, place, word) of neighbouring insertions (kind ins, place j) or deletions (del, i)."""
    rows = path.where(F.col("kind") == kind).select(*keys, place)
    island = F.col(place) - F.row_number().over(Window.partitionBy(*keys).orderBy(place))
    rows = rows.withColumn("island", island).join(words, [*keys, place])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place, "word"))), lambda x: x["word"]), " ")
    return rows.groupBy(*keys, "island").agg(joined.alias("run")).drop("island")


def top_runs(runs: DataFrame, most: int = 15) -> DataFrame:
    """The `most` runs of the largest count times length: a report."""
    counted = runs.groupBy("run").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") * F.length("run"))
    return counted.orderBy(F.desc("weight"), "run").limit(most)


def spans_inside(path: DataFrame, keys: list[str], words: DataFrame, fillers: list[str]) -> DataFrame:
    """word, total, extra: how often each filler is in the hypothesis (keys, j, word), and how often it was put in."""
    put_in = path.where(F.col("kind").isin("ins", "sub")).select(*keys, "j").withColumn("extra", F.lit(1))
    rows = words.where(F.col("word").isin(fillers)).join(put_in, [*keys, "j"], "left")
    return rows.groupBy("word").agg(F.count("*").alias("total"), F.count("extra").alias("extra"))


def lost(path: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """keys of the references of which more than `share` is deleted, and how much."""
    n = path.where("i IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"), F.sum((F.col("kind") == "del").cast("long")).alias("gone"))
    return n.where(F.col("gone") / F.col("n") > share)


def broken_drafts(cues: DataFrame, translated: Column) -> DataFrame:
    """media_id and how many drafts end without a mark and go on within 0.3 s, how many translations hold dense letters,
    and how many begin with a hesitation."""
    from chronolex.functions.text import CLOSING, DENSE, LEADING_HESITATION

    following = F.lead("start").over(Window.partitionBy("media_id").orderBy("start", "idx"))
    cut = F.trim("text").rlike(f"[^{CLOSING}]$") & (following - F.col("end") < 0.3)
    rows = cues.withColumn("cut", F.coalesce(cut, F.lit(False))).withColumn("out", translated)
    n = lambda c: F.sum(c.cast("long"))
    return rows.groupBy("media_id").agg(n(F.col("cut")).alias("broken"), n(F.col("out").rlike(f"[{DENSE}]")).alias("dense"), n(F.trim("out").rlike(LEADING_HESITATION)).alias("hesitations"))
