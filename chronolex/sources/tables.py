"""The driver's tables as timed-text inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters that are spoken in a second, and seconds of pause after each piece.
CHARS_PER_SECOND, PAUSE = 15.0, 0.9
#: Events that make up a medium of turns, so that media grow in number and not in size.
PER_MEDIUM = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, piece_idx, speaker, text, start, end: conversations read aloud."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("media_id"), F.col("turn").alias("piece_idx"), F.col("role").alias("speaker"), "text", F.length("text").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("media_id").orderBy("piece_idx").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    start = before / CHARS_PER_SECOND + PAUSE * F.col("piece_idx")
    return c.select("media_id", "piece_idx", "speaker", "text", start.alias("start"), (start + F.col("n") / CHARS_PER_SECOND).alias("end"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, turn_idx, speaker, start, end: who speaks when, from events."""
    start = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    e = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / PER_MEDIUM).alias("media_id"), F.col("event_id").alias("turn_idx"), F.col("event_type").alias("speaker"), (start / F.lit(6e7)).alias("start"), "value")
    return e.select("media_id", "turn_idx", "speaker", "start", (F.col("start") + F.col("value")).alias("end"))


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, piece_idx, speaker (null), start, end: stretches whose speaker is not known."""
    t = turns(spark, sf_dir)
    return t.select("media_id", F.col("turn_idx").alias("piece_idx"), F.lit(None).cast("string").alias("speaker"), (F.col("start") + 10).alias("start"), (F.col("start") + 40).alias("end"))


def samples(spark: SparkSession, sf_dir: str, per_media: int = 4000) -> DataFrame:
    """media_id, sample_idx, v: events' values as a signal, cut into media of per_media samples by event_id."""
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / per_media).alias("media_id"), (F.col("event_id") % per_media).alias("sample_idx"), F.col("value").alias("v"))


def submedia(n: int) -> Column:
    """A medium's turns dealt to n media."""
    return F.floor(F.col("turn_idx") / PER_MEDIUM) * n + F.col("turn_idx") % n


def voices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """media_id, label, first_heard, embedding: 200 voices a medium."""
    return table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 200).alias("media_id"), F.col("vec_id").alias("label"), F.col("vec_id").cast("double").alias("first_heard"), "embedding")


# The same as SQL, for checks against another engine.
SQL = {
    "pieces": """
        SELECT conv_id AS media_id, turn AS piece_idx, role AS speaker, text,
               coalesce(sum(length(text)) OVER w, 0) / 15e0 + 9e-1 * turn AS start,
               coalesce(sum(length(text)) OVER w, 0) / 15e0 + 9e-1 * turn + length(text) / 15e0 AS "end"
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "turns": """
        SELECT event_id // 2000 AS media_id, event_id AS turn_idx, event_type AS speaker,
               (epoch_us(ts) - 1704067200000000) / 6e7 AS start, (epoch_us(ts) - 1704067200000000) / 6e7 + value AS "end"
        FROM events""",
    "clips": """SELECT media_id, turn_idx AS piece_idx, NULL AS speaker, start + 10 AS start, start + 40 AS "end" FROM turns""",
    "samples": "SELECT event_id // 4000 AS media_id, event_id % 4000 AS sample_idx, value AS v FROM events",
    "voices": "SELECT vec_id // 200 AS media_id, vec_id AS label, vec_id::DOUBLE AS first_heard, embedding FROM embeddings",
}


def sql(*names: str) -> str:
    """A WITH clause, open for more tables, that defines the named inputs."""
    names = tuple(dict.fromkeys([n for name in names for n in (("turns", name) if name == "clips" else (name,))]))
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({SQL[n]})" for n in names)
