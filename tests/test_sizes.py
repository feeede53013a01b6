"""Cases that showed on larger tables only: equal distances, long texts, small groups, dense cues."""

from __future__ import annotations

import collections
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as tx
from chronolex.operators import audits, boxes, folds, intervals, layout
from chronolex.operators import segmentation as sg
from chronolex.plans import registry

BIG = "/root/testdata/sf0.1"


def against_sql(spark, folder, name):
    db = duckdb.connect()
    db.execute("SET timezone = 'UTC'")
    for p in folder.glob("*.parquet"):
        db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = registry.queries()[name](spark, str(folder))
    names = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(names)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.select(*names).collect()), key=str) == sorted(want, key=str)
    return want


@pytest.fixture
def events(tmp_path):
    def write(sql):
        duckdb.execute(f"COPY ({sql}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        return tmp_path

    return write


def test_boundaries_at_the_very_distance(spark, events):
    folder = events(f"SELECT * FROM '{BIG}/events.parquet' WHERE event_id // 2000 = 18 AND event_id % 40 = 19")
    assert len(against_sql(spark, folder, "m27_paired_boundaries")) == 1


def test_long_dense_texts_are_joined_in_one_pass(spark, tmp_path):
    text = "ありがとう a b, " * 8000
    duckdb.execute(f"COPY (SELECT 1::BIGINT AS doc_id, '{text}' AS text UNION ALL SELECT 3, '{text[::-1]}') TO '{tmp_path}/documents.parquet' (FORMAT parquet)")
    began = time.time()
    against_sql(spark, tmp_path, "t3_join")
    assert time.time() - began < 20


def test_joined_tokens(spark):
    rows = [(["日", "", "a"], "日a"), (["a", "", "日"], "a 日"), (["", "a", "b", "日"], "a b日"), (["a\x01", "日", "b", "c"], "a\x01日b c"), (["日 ", "x"], "日 x"), (["a", None, "日"], None), (["a", "", "b"], "a  b")]
    df = spark.createDataFrame([(x,) for x, _ in rows], "t array<string>").select(tx.join_tokens(F.col("t")).alias("j"))
    assert [r["j"] for r in df.collect()] == [want for _, want in rows]


def test_folds_of_small_groups(spark):
    """Keys of few rows, keys over the borders of batches, null keys, NaN; 30000 keys took over a minute one by one."""
    rows = spark.range(180_000).select(F.when(F.col("id") >= 6, F.floor(F.col("id") / 6)).alias("k"), (-F.col("id")).alias("n"), F.when(F.col("id") % 6 == 1, float("nan")).otherwise(F.col("id").cast("double")).alias("x"))
    began = time.time()
    out = folds.fold(rows, "k", ["n"], "k long, n int, first long, missing int", lambda own: [(len(own), own[0]["n"], sum(r["x"] is None for r in own))]).collect()
    assert time.time() - began < 20
    assert {r["k"]: tuple(r)[1:] for r in out} == {(k or None): (6, -6 * k - 5, 1) for k in range(30_000)}
    wide = folds.fold(spark.range(25_000).selectExpr("id", "1L AS k"), "k", ["id"], "k long, n int, last long", lambda own: [(len(own), own[-1]["id"])])
    assert [tuple(r) for r in wide.collect()] == [(1, 25_000, 24_999)]


def test_scripts_of_box_texts():
    for text in ("abc", "12", "", "éa", "これは", "これは ab", "abc これ", "ж"):
        for language in ("en", "ja", "ru"):
            count = lambda names, text=text: len(re.findall(f"[{''.join(tx.SCRIPTS[n] for n in names)}]", "".join(x for x in text if x.isalpha())))
            assert boxes.is_written(text, language) == (2 * count(tx.ACCEPTED.get(language, ("latin",))) > count(tuple(tx.SCRIPTS)))


def test_dense_cues_are_united_before_they_meet_regions(spark, events, monkeypatch):
    made, join = [], intervals.overlap_join
    monkeypatch.setattr(intervals, "overlap_join", lambda *a, **k: made.append(join(*a, **k)) or made[-1])
    folder = events(f"SELECT * REPLACE (CASE event_id % 9 WHEN 0 THEN -value WHEN 1 THEN 0 ELSE value END AS value) FROM '{BIG}/events.parquet' WHERE event_id // 2000 IN (3, 4)")
    rows = against_sql(spark, folder, "m13_uncovered")
    assert sum(df.count() for df in made) < 2 * len(rows)  # 11 for each region where every cue met it


@pytest.fixture(scope="module")
def lexicon():
    texts = [x for (x,) in duckdb.execute("SELECT text FROM '/root/testdata/sf0.001/documents.parquet' WHERE lang = 'en' ORDER BY doc_id").fetchall()]
    counts = collections.Counter(w for x in texts for w in re.findall(r"[^\W\d_]+", x.lower()) if len(w) <= sg.LONGEST)
    return sg.Lexicon({w: float(n) for w, n in counts.items()}), texts


ODD = ["İstanbul ab", "ΑΣ σς ΟΔΟΣ,x", "", "a" * 60, "12 ab", "ß日本は とても", "x" * 300, "é ab", "\U0001d400ab c", "a,bü", ",,ab", "日本ab,cdは"]


def test_many_lattices_are_those_of_single_runs(lexicon, monkeypatch):
    own, texts = lexicon
    some = [x[:600] for x in texts[:25]] + ODD
    unspaced, split = ["".join(x.split()) for x in some], lambda x: sg.phrases(sg.words(own, x), latin_runs=False)
    runs = [x for text in unspaced for x in re.findall(r"[^\W\d_]+", text.lower())] + ["q" * 90]
    want = collections.Counter()
    for i, run in enumerate(runs):
        for w, n in own.expected(run).items():
            want[w] += n * (1 + i % 2)
    for letters in (sg.LATTICE_LETTERS, 100):  # longer runs go one by one
        monkeypatch.setattr(sg, "LATTICE_LETTERS", letters)
        assert [tuple(x) for x in sg.compared_many(own, some).T.tolist()] == [sg.compared(own, x) for x in some]
        assert sg.ends_of_phrases(own, unspaced) == [sg.phrase_ends(split, x) for x in unspaced]
        sums = sg.Expected(own)
        sums.add(runs, np.arange(len(runs)) % 2 + 1)
        got = collections.Counter()
        for w, n in zip(*sums.given(), strict=True):
            got[w] += n
        assert max(abs(got[w] - want[w]) for w in {*got, *want}) < 1e-5
    assert sg.compared_many(None, ["ab cd", ""]).tolist() == [[1, 0], [sg.compared(None, "ab cd")[1], 0], [sg.compared(None, "ab cd")[2], 0]]


def test_lines_of_many_texts_take_microseconds_a_letter(lexicon):
    own, texts = lexicon
    unspaced = ["".join(x.split())[:400] for x in texts]
    sg.ends_of_phrases(own, unspaced[:1])
    began = time.time()
    lines = sg.answered(sg.gathered([layout.wrapping(x, 20, dense=True) for x in unspaced]), lambda asked: sg.ends_of_phrases(own, asked))
    assert (time.time() - began) / sum(map(len, unspaced)) < 25e-6  # some 60 one by one
    split = lambda x: sg.phrases(sg.words(own, x), latin_runs=False)
    assert lines[:10] == [layout.wrap(x, 20, split=split, dense=True) for x in unspaced[:10]]


def test_counts_of_texts_are_those_of_their_paths(spark):
    pairs = spark.range(40).select("id", F.concat(F.repeat(F.lit("ab cd "), 500), F.col("id").cast("string")).alias("a"), F.concat(F.repeat(F.lit("ab "), 2), F.col("id").cast("string")).alias("b"))
    names = ["id", "same", "sub", "deleted", "inserted"]
    got = audits.counts_of_texts(pairs, ["id"], "a", "b")
    arrays = pairs.select("id", F.split("a", " ").alias("a"), F.split("b", " ").alias("b"))
    assert sorted(got.select(names).collect()) == sorted(audits.counts(audits.paths(arrays, ["id"], "a", "b"), ["id"]).select(names).collect())
