from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from chronolex.functions import text as tx


def of(spark, f, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(f(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(("given", "wanted"), [("Um, I was there.", "I was there."), ("I was, uh, thinking", "I was thinking"), ("umbrella here", "umbrella here"), ("uh", "")])
def test_hesitations(spark, given, wanted):
    assert of(spark, tx.strip_hesitations_en, given) == wanted


def test_japanese(spark):
    assert of(spark, tx.strip_hesitations_ja, "えーと、行きます") == "行きます"
    assert of(spark, tx.split_tokens, "日本 abc") == ["日", "本", "abc"]
    assert of(spark, tx.tighten_dense, "日 本 a") == "日本 a"
    assert of(spark, lambda c: tx.join_tokens(F.split(c, "/")), "日/本/ab/cd") == "日本ab cd"


def test_fillers(spark):
    assert of(spark, tx.is_filler, "Thanks for watching! Thanks for watching!")
    assert of(spark, tx.is_filler, "...")
    assert not of(spark, tx.is_filler, "Thanks for the fish")


def test_timecodes(spark):
    assert of(spark, lambda c: tx.timecode(c.cast("double")), "3661.0005") == "01:01:01,001"
    assert of(spark, tx.parse_timecode, "01:02:03,5") == 3723.5
    assert of(spark, tx.parse_timecode, "1:60:00,0") is None
    assert of(spark, tx.parse_timecode, "1:02") is None


def test_versions_and_container(spark):
    assert of(spark, tx.is_newer, "v1.10", "1.9.9")
    assert not of(spark, tx.is_newer, "1.0", "v1")
    assert of(spark, lambda c: tx.container(F.unhex(c)), "52494646000000005741564500") == "WAV"
    assert of(spark, lambda c: tx.container(F.unhex(c)), "0000") is None


def test_nulls(spark):
    for f in (tx.normalize, tx.tidy, lambda c: tx.clock(c.cast("double")), lambda c: tx.timecode(c.cast("double")), tx.palette_index, tx.strip_special, tx.split_tokens):
        assert of(spark, f, None) is None
