"""Cleaning of a corpus in five stages, each over all documents that the one before kept."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import bpe, common, jaccard, kneser_ney, lsa, pii

#: Settings of a session that runs the stages.  Rows that go to a Python worker at a time: whole texts, some of them very long,
#: wait in both processes.  Characters of a plan that the driver keeps for each of a run's many jobs.
SETTINGS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.maxPlanStringLength": "4000"}


def in_little_memory(stage):
    """The stage in a session with SETTINGS, which bound what a task holds outside the heap and what the driver keeps."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for name, value in SETTINGS.items():
            spark.conf.set(name, value)
        return stage(spark, docs, sf_dir)

    return run


@in_little_memory
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of at most the perplexity that their language allows; blank and null texts go, repeated rows are judged
    alike, an empty table stays one."""
    renamed = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text", "lang")}
    judged = kneser_ney.judge(docs.withColumnsRenamed(renamed), common.table(spark, sf_dir, "labels"))
    return judged.where("keep").select(*[F.col(renamed.get(c, c)).alias(c) for c in docs.columns])


@in_little_memory
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each component of links, and all that no link reaches; of repeated rows with one
    id all stay or go; blank texts and rows without an id have no links."""
    found = jaccard.join_components(docs, n=5, percent=80)
    gone = common.stored(found.where("component_id < doc_id").select("doc_id").distinct(), "duplicates")
    return common.semi_join_checked(docs, gone, "doc_id", common.ID_ROWS, "left_anti").select(docs.columns)


@in_little_memory
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage; blank texts have none."""
    return lsa.clean(docs, common.table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their personal data replaced by the kind of it; n_chars is counted anew (null text: null)."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


@in_little_memory
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids (little-endian unsigned 32-bit) and whether they decode to the text."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.encode_checked(docs.select("doc_id", "lang", "source", "text"), ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("byte-level BPE encoding and decoding", tokens),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.stored(docs, "stage")
    return docs
