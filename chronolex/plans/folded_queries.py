"""Queries on ordered folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.text import url_bytes
from chronolex.operators import cues as cu
from chronolex.operators import folds as fo
from chronolex.operators import layout
from chronolex.plans.cue_queries import _cues
from chronolex.plans.registry import query
from chronolex.sources import tables as t

_CUE = "media_id long, idx int, start double, end double, text string, speaker string"


def _flat(cues):
    return ((i + 1, c["start"], c["end"], c["text"], c["speaker"]) for i, c in enumerate(cues))


@query()
def c1_make_cues(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces, cut at signs, to cues; half a second of every minute is silent. Tested against its parts one by one."""
    words = t.pieces(spark, sf).select("media_id", "piece_idx", "speaker", "start", "end", F.posexplode(F.split("text", "(?<=[.,]) ")).alias("k", "text"))
    span = (F.col("end") - F.col("start")) / 12
    words = words.select("media_id", "piece_idx", "k", "speaker", "text", (F.col("start") + F.col("k") * span).alias("start"), (F.col("start") + (F.col("k") + 1) * span).alias("end"))

    def step(rows):
        last = max(r["end"] for r in rows)
        return _flat(fo.make_cues(rows, [(60.0 * i, 60.0 * i + 0.5) for i in range(1, int(last // 60) + 2)], last))

    return fo.fold(words, "media_id", ["start", "piece_idx", "k"], _CUE, step)


@query()
def c3_merge_tiny(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of whole texts, of which two in three are short enough to be joined with the one before."""
    near = F.col("idx") * 2.0
    short = _cues(spark, sf).withColumn("start", near).withColumn("end", near + (F.col("idx") % 3) * 0.5 + 0.2).withColumn("speaker", F.lit("a"))
    return fo.fold(short, "media_id", ["start", "idx"], _CUE, lambda rows: _flat(fo.merge_tiny(rows)))


@query("""WITH RECURSIVE t AS (SELECT event_id // 200 AS media_id, event_id % 200 + 1 AS k, (event_id % 200) * 20e0 AS s, (event_id % 200) * 20e0 + value - 20 AS e FROM events),
    f AS (SELECT media_id, min(k) AS k FROM t GROUP BY 1),
    w AS (SELECT media_id, k, k - k + 1 AS idx, s AS start, CASE WHEN e <= s THEN s + 4e-1 ELSE e END AS "end" FROM t JOIN f USING (media_id, k)
      UNION ALL SELECT t.media_id, t.k, w.idx + 1, greatest(t.s, w."end"), CASE WHEN t.e <= greatest(t.s, w."end") THEN greatest(t.s, w."end") + 4e-1 ELSE t.e END FROM w JOIN t ON t.media_id = w.media_id AND t.k = w.k + 1)
    SELECT media_id, idx::INT AS idx, round(start, 6) AS start, round("end", 6) AS "end" FROM w""")
def c4_fix_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    place = F.floor(e % 200) * 20.0
    rows = t.table(spark, sf, "events").select(F.floor(e / 200).alias("media_id"), "event_id", place.alias("start"), (place + F.col("value") - 20).alias("end"))
    out = cu.fix_overlaps(rows.withColumnRenamed("event_id", "idx"))
    return out.select("media_id", F.col("idx").cast("int").alias("idx"), F.round("start", 6).alias("start"), F.round("end", 6).alias("end"))


@query()
def c6_units(spark: SparkSession, sf: str) -> DataFrame:
    short = _cues(spark, sf).withColumn("end", F.col("start") + 6).withColumn("speaker", F.lit("a"))
    return fo.fold(short, "media_id", ["start", "idx"], "media_id long, unit int, idx long", lambda rows: ((u, int(c["idx"])) for u, unit in enumerate(fo.sentence_units(rows, gap=20, chars=1500)) for c in unit))


def _per_text(df: DataFrame, key: str, schema: str, make) -> DataFrame:
    def run(frames):
        import pandas as pd

        names = [x.split()[0] for x in schema.split(", ")]
        for frame in frames:
            yield pd.DataFrame([(k, *x) for k, text in zip(frame[key], frame["text"], strict=True) for x in make(text or "")], columns=names)

    return df.select(key, "text").mapInPandas(run, schema)


@query()
def t9_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _per_text(t.table(spark, sf, "documents"), "doc_id", "doc_id long, n int, text string", lambda x: enumerate(fo.sentences(x)))


@query()
def t12_wrap(spark: SparkSession, sf: str) -> DataFrame:
    return _per_text(t.table(spark, sf, "documents"), "doc_id", "doc_id long, n int, text string", lambda x: enumerate(layout.wrap(" ".join(x.split()))))


def _chunks_sql(cost, limit):
    return f"""WITH RECURSIVE t AS (SELECT conv_id AS k, turn, {cost} AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
    w AS (SELECT k, n, turn, 0 AS chunk, c AS used FROM t WHERE n = 1
      UNION ALL SELECT t.k, t.n, t.turn, w.chunk + CASE WHEN w.used + t.c > {limit} THEN 1 ELSE 0 END, CASE WHEN w.used + t.c > {limit} THEN t.c ELSE w.used + t.c END FROM w JOIN t ON t.k = w.k AND t.n = w.n + 1)
    SELECT k AS conv_id, turn, chunk::INT AS chunk FROM w"""


def _packed(spark, sf, cost, limit):
    rows = t.table(spark, sf, "conversations").select("conv_id", "turn", cost.alias("n"))
    return fo.fold(rows, "conv_id", ["turn"], "conv_id long, turn long, chunk int", lambda rows: ((int(r["turn"]), c) for r, c in zip(rows, fo.chunks([int(r["n"]) for r in rows], limit, 0), strict=True)))


@query(_chunks_sql("length(text) + 1", 600))
def u4_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A conversation's texts packed greedily into requests of 600 characters."""
    return _packed(spark, sf, F.length("text") + 1, 600)


@query(_chunks_sql("3 * strlen(text) - 2 * length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) + 3", 2000))
def u5_chunks_of_bytes(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the bytes of the escaped texts, in requests of 2000."""
    return _packed(spark, sf, url_bytes(F.col("text")) + 3, 2000)


@query()
def b5_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of samples, 500 a medium, that show about the same text."""
    rows = t.table(spark, sf, "events").select(F.floor(F.col("event_id") / 500).alias("media_id"), "event_id", F.col("event_type").alias("text"))
    step = lambda rows: ((i, run[0][0], run[-1][0], run[0][1]) for i, run in enumerate(fo.runs([(r["event_id"], r["text"]) for r in rows], fo.near_text)))
    return fo.fold(rows, "media_id", ["event_id"], "media_id long, run int, first long, last long, text string", step)


@query()
def b7_assemble(spark: SparkSession, sf: str) -> DataFrame:
    """Cues of the runs of samples, which are empty where the value is small."""
    e = F.col("event_id")
    rows = t.table(spark, sf, "events").select(F.floor(e / 500).alias("media_id"), (e % 500 / 2.0).alias("at"), F.when(F.col("value") < 20, "").otherwise(F.col("event_type")).alias("text"))
    step = lambda rows: ((i + 1, *c) for i, c in enumerate(fo.assemble([(r["at"], r["text"]) for r in rows], 250.0, fo.near_text)))
    return fo.fold(rows, "media_id", ["at"], "media_id long, idx int, start double, end double, text string", step)
