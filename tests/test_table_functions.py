"""Table functions give the rows that folds give; what they need of their table is checked before anything runs."""

from __future__ import annotations

import random

import pytest
from pyspark.errors import AnalysisException

from chronolex.operators import pieces
from chronolex.operators import table_functions as tf
from chronolex.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("one", "other"), [("p1_group_tokens", "u11_tokens"), ("p2_group_runs", "u11_runs"), ("p4_group_words", "u11_words"), ("c9_enforce_lines", "u11_lines")])
def test_same_rows_as_the_fold(spark, one, other):
    names = sorted(registry.queries()[one](spark, SF).columns)
    rows = [sorted(str([r[c] for c in names]) for r in registry.queries()[q](spark, SF).collect()) for q in (one, other)]
    assert rows[0] == rows[1]
    assert rows[0]


def test_tables_are_checked(spark):
    tf.register(spark)
    with pytest.raises(AnalysisException, match="needs a column text"):
        spark.sql("SELECT * FROM group_words(TABLE(SELECT 1L AS media_id))").collect()
    with pytest.raises(AnalysisException, match="must be a table"):
        spark.sql("SELECT * FROM group_words(1)").collect()
    none = "SELECT 1L AS media_id, 'a' AS text, 0D AS start, 1D AS end WHERE false"
    assert spark.sql(f"SELECT * FROM group_words(TABLE({none}) PARTITION BY media_id ORDER BY start)").collect() == []
    spark.createDataFrame([(1, "a.", 0.0, 1.0), (1, "-", 2.0, 3.0), (1, "b", 4.0, 5.0)], "media_id long, text string, start double, end double").createOrReplaceTempView("three_words")
    one = spark.sql("SELECT * FROM group_words(TABLE(three_words) PARTITION BY media_id ORDER BY start)").collect()
    assert [tuple(r) for r in one] == [(1, 0, "a.-", 0.0, 3.0), (1, 1, "b", 4.0, 5.0)]


def test_pieces_come_out_as_they_are_made():
    state = pieces.WordPieces(every=20.0)
    assert state.feed("one.", 0.0, 0.5) == []
    assert state.feed("two.", 0.6, 1.0) == [("one.", 0.0, 0.5)]
    assert state.flush() == [("two.", 0.6, 1.0)]
    assert state.flush() == []


def test_sides():
    r = random.Random(3)
    bounds = sorted(round(r.uniform(0, 50), 1) for _ in range(30))
    for _ in range(200):
        t = round(r.uniform(-1, 51), 1)
        assert pieces.side(t, bounds) == sum(b <= t for b in bounds)
