"""Awkward tables through every operator and every stage of the pipeline: empty ones, nulls, empty and very long texts,
ties, repeated rows, and extra columns whose names clash with those used inside."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
pytest.importorskip("chronolex.llm.queries")
from chronolex.llm import bpe, chat, common, html_crf, jaccard, kneser_ney, licences, lsa, pii, simhash, warc  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "word after word goes on, and on. " * 30_000
ROWS = [
    (1, "Plain text of some words that stand here.", "en", "s", 41), (1, "Plain text of some words that stand here.", "en", "s", 41), (2, "", "en", "s", 0), (3, None, None, None, None),
    (None, "No id here at all, mail a@b.co now.", "en", "s", 35), (4, " \n\t ", "de", "s", 4), (5, LONG, "en", "s", len(LONG)), (6, "x" * 200_000, "en", "s", 200_000), (7, "naïve 😀 text, +1 555 010 2000 more", "fr", "s", 33),
]
#: Names that operators use inside.
CLASHES = ["d", "k", "cuts", "row_text", "l", "row", "near", "found", "base", "key", "cid", "node", "sig", "words", "score", "threshold", "keep", "worst", "of", "bits", "which", "id", "next_id", "ids", "n_tokens", "scored", "perplexity", "n_symbols", "h", "w", "t", "held"]
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ITEMS = [(1, "some words that stand here and are a benchmark passage of their own kind"), (2, None), (3, ""), (None, "an item without an id that nobody copies at all in this table")]


def tables(spark):
    full = spark.createDataFrame([*ROWS, *[(None, None, None, None, None)] * 3], SCHEMA)
    return {"empty": full.where("false"), "clashing": full.select("*", *[F.lit(i).cast("string").alias(c) for i, c in enumerate(CLASHES)])}


def operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (7, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {
        "simhash": simhash.digests, "licences": licences.scan, "bpe": lambda d: bpe.token_digests(d, RANKS, PATTERN), "pii": pii.digests,
        "redact": pii.redact, "jaccard": jaccard.join_components, "judge": lambda d: kneser_ney.judge(d, labels), "encode": lambda d: bpe.encode_checked(d, RANKS, PATTERN),
        "clean": lambda d: lsa.clean(d, items),
    }


@pytest.mark.parametrize("name", ["simhash", "licences", "bpe", "pii", "redact", "jaccard", "judge", "encode", "clean"])
def test_documents(spark, name):
    run = operators(spark)[name]
    for kind, df in tables(spark).items():
        out = run(df)
        assert out.count() == df.count(), (name, kind)
        if kind == "clashing" and name in ("redact", "clean"):
            assert out.columns == df.columns
            assert {tuple(r[c] for c in CLASHES) for r in out.collect()} == {tuple(map(str, range(len(CLASHES))))}


def test_pages(spark):
    schema = "page_id long, url string, html string"
    long = "<article>" + "<p>Some words in a long text.</p>" * 20_000 + "</article>"
    rows = [(1, "u", "<article><p>Words that make up a text.</p></article>"), (1, "u", "<article><p>Words that make up a text.</p></article>"), (None, None, None), (2, "u", ""), (3, "u", long), (4, "u", "<div>" * 5000 + "deep" + "</span>" * 50), (5, "u", "<p>a<math>x</math> b<svg><text>t</text></svg></p>")]
    df = spark.createDataFrame(rows, schema)
    extra = df.select("*", F.lit(1).alias("text"), F.lit(2).alias("n_chars"), F.lit(3).alias("k"), F.lit(4).alias("refers"))
    for some, n in ((df, len(rows)), (extra, len(rows)), (df.where("false"), 0)):
        assert html_crf.extract(some).count() == n
        path = common.scratch(spark, "t")
        pages = some.withColumn("payload", F.col("html").cast("binary"))
        warc.write_archive(pages, path, key="page_id", url="url", payload="payload")
        read = warc.resolve(common.stored(warc.payloads(warc.reassemble(warc.read_archive(spark, path))), "r"))
        assert read.count() == n
    found = {r["page_id"]: r["n_chars"] for r in html_crf.extract(df).collect()}
    assert found[3] == len("\n".join(["Some words in a long text."] * 20_000))


def test_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", None), (None, None, None, None), (2, 0, "assistant", LONG), (3, 5, "", "")]
    df = spark.createDataFrame(rows, schema)
    extra = df.select("*", *[F.lit("x").alias(c) for c in ("block", "piece", "reply", "at", "h", "b", "nth", "formatted", "examples")])
    want = sorted(map(str, chat.digests(df).collect()))
    assert sorted(map(str, chat.digests(extra).collect())) == want
    assert len(want) == 4
    assert chat.digests(df.where("false")).count() == 0


def test_stages(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for kind, df in tables(spark).items():
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, df, str(tmp_path))
            assert out.count() <= df.count(), (kind, i)
            assert i == 4 or out.columns == df.columns, (kind, i)
