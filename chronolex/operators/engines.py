"""Engines: languages they cover, which one runs, and what their calls' log says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Codes and English names of the languages, and which of them the engines cover.
LANGUAGES = {
    "pt": "Portuguese", "en": "English", "es": "Spanish", "fr": "French", "de": "German", "it": "Italian", "nl": "Dutch", "pl": "Polish", "ru": "Russian",
    "uk": "Ukrainian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi", "tr": "Turkish", "vi": "Vietnamese", "th": "Thai",
}
NOT_DEEPL = ("hi", "th", "vi")
DEEPL_TARGETS = {"pt": "pt-BR", "en": "en-US"}
GOOGLE = {"zh": "zh-CN"}
PARAKEET = ("pt", "en", "es", "fr", "de", "it", "nl", "pl", "ru", "uk")


def languages(spark: SparkSession) -> DataFrame:
    """code, name, deepl_source, deepl_target, google, parakeet: a row per language, null where an engine lacks it."""
    rows = [(c, n, None if c in NOT_DEEPL else c, None if c in NOT_DEEPL else DEEPL_TARGETS.get(c, c), GOOGLE.get(c, c), c in PARAKEET) for c, n in LANGUAGES.items()]
    return spark.createDataFrame(rows, "code string, name string, deepl_source string, deepl_target string, google string, parakeet boolean")


def identity(rows: DataFrame, language: Column) -> DataFrame:
    return rows.withColumn("translated", F.col("text")).withColumn("target", language)


def choose(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (wanted, code, available, ...) with the engine that runs: what is wanted if it can, else whisper."""
    found = rows.join(F.broadcast(known.select("code", "parakeet")), "code", "left")  # a row per language
    can = F.when(F.col("wanted") == "parakeet", F.coalesce("parakeet", F.lit(False))).when(F.col("wanted").isin("apple", "qwen", "qwenLarge"), F.col("available")).otherwise(True)
    return found.withColumn("engine", F.when(can, F.col("wanted")).otherwise("whisper")).drop("parakeet")


def circuit(calls: DataFrame, key: str, *, most: int = 3, pause: float = 60.0) -> DataFrame:
    """calls (key, event_id, t, failed) with streak, the failures in a row up to a call, and refused: whether it comes
    within `pause` seconds of an earlier failure that was at least the `most`-th of its row."""
    order = Window.partitionBy(key).orderBy("t", "event_id")
    runs = calls.withColumn("run", F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(order))
    streak = F.sum(F.col("failed").cast("int")).over(Window.partitionBy(key, "run").orderBy("t", "event_id"))
    rows = runs.withColumn("streak", F.when(F.col("failed"), streak).otherwise(0).cast("long"))
    opened = F.max(F.when(F.col("streak") >= most, F.col("t"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("refused", F.coalesce(F.col("t") - opened < pause, F.lit(False))).drop("run")
