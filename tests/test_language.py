"""Language detection: counts against a loop, the query against the given languages, certainty, texts without letters."""

from __future__ import annotations

import collections
import re

import duckdb
import pytest

from chronolex.operators import language as la

SF = "/root/testdata/sf0.01"
ROWS = [("de", "Der schnelle Fuchs über dem Haus."), ("en", "The quick fox over the house."), ("en", "Them then."), (None, "never counted"), ("de", None), ("de", "")]


def test_counts_against_a_loop(spark):
    want = collections.Counter()
    for lang, text in ROWS:
        if lang:
            for w in re.findall(r"[^\W\d_]+", (text or "").lower()):
                want.update((lang, g) for g in la.grams(w))
    df = spark.createDataFrame(ROWS, "lang string, text string")
    assert {(r["lang"], r["gram"]): r["n"] for r in la.gram_counts(df).collect()} == dict(want)


def test_grams():
    assert la.grams("ab") == ["a", "b", " a", "ab", "b ", " ab", "ab "]
    assert la.grams("é") == ["é", " é", "é ", " é "]


def test_texts_without_letters_and_models_without_texts(spark):
    df = spark.createDataFrame([(1, "x", "12 34 !"), (2, "x", None), (3, "x", "wort")], "id long, language string, text string")
    empty = la.trained(spark.createDataFrame([], "lang string, text string"))
    assert {tuple(r) for r in la.detected(df, empty).select("id", "language", "certainty").collect()} == {(1, None, None), (2, None, None), (3, None, None)}
    one = la.trained(spark.createDataFrame([("de", f"wort {i}" * 3) for i in range(20)], "lang string, text string"))
    assert {tuple(r) for r in la.detected(df, one).select("id", "language", "certainty").collect()} == {(1, None, None), (2, None, None), (3, "de", 1.0)}


def test_unsure_texts_are_null():
    model = la.Model({g: {"x": 120, "y": 80} for g in la.grams("b")} | {g: {"x": 80, "y": 120} for g in la.grams("a")}, temperature=2.0)
    lang, certainty = model.judge(["b"])
    assert lang == "x"
    assert 0.5 < certainty < la.CERTAIN
    assert model.judge(["b"] * 40)[1] > la.CERTAIN
    tie = la.Model({g: {"x": 1, "y": 1} for g in la.grams("a")})
    assert tie.judge(["a"]) == ("x", 0.5)


@pytest.fixture(scope="module")
def found(spark):
    from chronolex.plans import registry

    return registry.queries()["t25_language"](spark, SF).collect()


def test_languages_of_the_table(found):
    rows = [r for r in found if r["lang"] is not None]
    n = duckdb.sql(f"SELECT count(*) FROM '{SF}/documents.parquet'").fetchall()[0][0]
    assert len(found) == n
    given = [r for r in rows if r["language"] is not None]
    assert sum(r["language"] == r["lang"] for r in given) / len(given) > 0.98
    assert len(given) / len(rows) > 0.95
    long = [r for r in rows if r["n_words"] >= 50]
    assert sum(r["language"] is None for r in long) / len(long) < 0.01
    assert all((r["certainty"] >= la.CERTAIN) == (r["language"] is not None) for r in rows if r["certainty"] is not None and abs(r["certainty"] - la.CERTAIN) > 1e-5)


def test_certainty_is_calibrated(spark):
    """Of single words, those that are given a language are right about as often as their certainty says."""
    docs = duckdb.sql(f"SELECT lang, text FROM '{SF}/documents.parquet' WHERE lang IS NOT NULL AND text IS NOT NULL ORDER BY doc_id").fetchall()
    model = la.trained(spark.createDataFrame(docs[::2], "lang string, text string"))
    right, sure, n = 0, 0.0, 0
    for lang, text in docs[1::2]:
        for w in re.findall(r"[^\W\d_]+", text.lower())[::7]:
            found, certainty = model.judge([w])
            right, sure, n = right + (found == lang), sure + certainty, n + 1
    assert abs(right / n - sure / n) < 0.08, (right / n, sure / n)
