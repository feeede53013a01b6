"""Batches that come back with another count or fail, against plain recursion."""

from __future__ import annotations

import collections

import duckdb
import pytest

from chronolex.operators import batches as bt

SF = "/root/testdata/sf0.001"


def _breaking():
    def breaks(texts):
        """Loses a line of batches with a long text, adds one where a text has a comma, fails where one has a question mark."""
        if any("?" in x for x in texts):
            raise ValueError("no questions")
        out = [x.upper() for x in texts]
        if len(texts) > 1 and max(map(len, texts)) > 12:
            return out[:-1]
        if any("," in x for x in texts):
            return [part for x in out for part in x.split(",")]
        return out

    return breaks


breaks = _breaking()  # not by name: tasks cannot import the tests


def recursion(texts, call):
    """[(text, error)] by plain recursion."""
    try:
        out = call(texts)
        if len(out) == len(texts):
            return [(x, None) for x in out]
        if len(texts) == 1:
            return [(" ".join(out).strip(), None)]
    except Exception as e:  # noqa: BLE001
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}")]
    middle = len(texts) // 2
    return recursion(texts[:middle], call) + recursion(texts[middle:], call)


@pytest.mark.parametrize("size", [1, 3, 10])
def test_every_line_is_given_or_an_error(spark, size):
    words = ["short", "a rather long text", "one, two", "why?", "", "  ", None, "x"]
    rows = [(m, i, words[(m * 7 + i * i) % 8]) for m in range(5) for i in range(23)]
    got = {(r["media_id"], r["idx"]): (r["translated"], r["error"]) for r in bt.translated(spark.createDataFrame(rows, "media_id long, idx long, text string"), breaks, size=size).collect()}
    want = {(m, i): ("", None) for m, i, x in rows if not (x or "").strip()}
    for m in range(5):
        own = [(i, x) for k, i, x in rows if k == m and (x or "").strip()]
        for a in range(0, len(own), size):
            part = own[a : a + size]
            want |= {(m, i): r for (i, _), r in zip(part, recursion([x for _, x in part], breaks), strict=True)}
    assert got == want
    assert len({e for _, e in got.values()}) == 2


def test_retries():
    calls = collections.Counter()

    def flaky(kind, fails):
        def call(texts):
            calls[kind, fails] += 1
            if calls[kind, fails] <= fails:
                raise kind("busy")
            return texts

        return call

    assert bt.Retry(2).run(flaky(ValueError, 1), ["a"]) == ["a"]
    with pytest.raises(ValueError, match="busy"):
        bt.Retry(2).run(flaky(ValueError, 2), ["a"])
    assert bt.Retry(3, (0.0,), (OSError,)).run(flaky(OSError, 2), ["a"]) == ["a"]
    with pytest.raises(KeyError):
        bt.BUSY.run(flaky(KeyError, 1), ["a"])
    assert calls[KeyError, 1] == 1
    assert bt.halves(["a"], flaky(TypeError, 9), bt.Retry(1)) == (None, "TypeError: busy")
    assert bt.halves(["a", "b"], flaky(TypeError, 8), bt.Retry(1)) == (None, None)


def test_no_rows(spark):
    assert bt.translated(spark.createDataFrame([], "media_id long, idx long, text string"), breaks).count() == 0


def test_query_against_recursion(spark):
    from chronolex.plans import batch_queries, registry

    rows = duckdb.sql(f"SELECT conv_id, turn, text FROM '{SF}/conversations.parquet' ORDER BY conv_id, turn").fetchall()
    want = {}
    by = collections.defaultdict(list)
    for c, i, x in rows:
        by[c].append((i, x))
    for c, own in by.items():
        own = [(i, x) for i, x in own if x and x.strip()]
        for a in range(0, len(own), batch_queries.LINES):
            part = own[a : a + batch_queries.LINES]
            want |= {(c, i): r for (i, _), r in zip(part, recursion([x for _, x in part], batch_queries.reversing), strict=True)}
    got = {(r["media_id"], r["idx"]): (r["translated"], r["error"]) for r in registry.queries()["u12_halved"](spark, SF).collect()}
    assert {k: v for k, v in got.items() if v != ("", None)} == want
