"""WAV and SubRip as data sources: exact round trips, partitions, files of others, failed and overwritten writes."""

from __future__ import annotations

import os
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolex.sources import media_files as mf
from chronolex.sources import srt


@pytest.fixture(autouse=True)
def registered(spark):
    mf.register(spark)


def signal(spark, rows):
    return spark.createDataFrame(rows, "media_id long, sample_idx long, v double")


def test_round_trip_of_doubles_in_partitions(spark, tmp_path):
    r = np.random.default_rng(1)
    rows = [(m, i, float(v)) for m, n in ((1, 1), (2, 5000), (-3, 777)) for i, v in enumerate(r.normal(size=n) * 1e6)] + [(4, 10, 1.0), (4, 11, None), (4, 20, -2.0)]
    path = f"file://{tmp_path}/w"
    mf.write_wav(signal(spark, rows), path, encoding="float64")
    back = spark.read.format("wav").option("partitionSamples", "300").load(path)
    assert back.rdd.getNumPartitions() > 17
    assert sorted(map(tuple, back.select("media_id", "sample_idx", "v").collect())) == sorted((m, i, 0.0 if v is None else v) for m, i, v in rows)
    assert not [x for x in os.listdir(tmp_path / "w") if x.startswith("_")]


def test_sixteen_bits_can_be_read_by_others(spark, tmp_path):
    v = [0.0, 0.5, -1.0, 1.0, 7.0, -7.0, 1e-9, None]
    mf.write_wav(signal(spark, [(1, i, x) for i, x in enumerate(v)]).coalesce(1), str(tmp_path / "w"), rate="8000")
    (name,) = [x for x in os.listdir(tmp_path / "w") if x.endswith(".wav")]
    with wave.open(str(tmp_path / "w" / name)) as f:
        assert (f.getframerate(), f.getnchannels(), f.getsampwidth()) == (8000, 1, 2)
        codes = struct.unpack("<8h", f.readframes(8))
    assert codes == (0, 16384, -32767, 32767, 32767, -32767, 0, 0)
    back = spark.read.format("wav").load(str(tmp_path / "w")).orderBy("sample_idx").select("v").collect()
    assert [round(r["v"] * 32767) for r in back] == list(codes)


def test_files_of_others(spark, tmp_path):
    with wave.open(str(tmp_path / "stereo.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(44_100)
        f.writeframes(struct.pack("<6h", 100, 300, -100, -300, 0, 32767))
    rows = spark.read.format("wav").load(str(tmp_path)).orderBy("sample_idx").collect()
    assert [r["media_id"] for r in rows] == [None] * 3
    assert np.allclose([r["v"] * 32767 for r in rows], [200, -200, 16383.5])
    (tmp_path / "bad.wav").write_bytes(b"no sound")
    with pytest.raises(Exception, match="not a WAV file"):
        spark.read.format("wav").load(str(tmp_path)).count()
    with pytest.raises(ValueError, match="stand before"):
        mf.wav_layout(b"RIFF\0\0\0\0WAVEdata\0\0\0\0", 20)


def test_nothing_is_seen_of_a_failed_write(spark, tmp_path):
    path = str(tmp_path / "w")
    mf.write_wav(signal(spark, [(1, 0, 1.0)]), path)
    bad = signal(spark, [(2, i, 0.1) for i in range(2000)]).withColumn("v", F.when((F.col("sample_idx") == 1999) & (F.rand() >= 0), F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        bad.repartition(4, "sample_idx").write.format("wav").mode("append").save(path)
    assert [x for x in os.listdir(path) if not x.startswith("1-")] == []
    assert spark.read.format("wav").load(path).count() == 1


def test_overwrite_and_empty(spark, tmp_path):
    path = str(tmp_path / "w")
    rows = signal(spark, [(1, 0, 1.0), (2, 0, 0.5)])
    rows.write.format("wav").mode("append").save(path)
    rows.where("media_id = 2").write.format("wav").mode("overwrite").save(path)
    assert [r["media_id"] for r in spark.read.format("wav").load(path).collect()] == [2]
    rows.where("false").write.format("wav").mode("overwrite").save(path)
    assert spark.read.format("wav").load(path).count() == 0
    assert spark.read.format("wav").load(str(tmp_path / "nowhere")).count() == 0


def test_long_runs_are_cut(spark, tmp_path, monkeypatch):
    class Small(mf.Wav):
        def writer(self, schema, overwrite):
            out = super().writer(schema, overwrite)
            mf.FILE_BYTES = 1000
            return out

    monkeypatch.setattr(mf, "FILE_BYTES", 1000)
    writer = Small({"path": str(tmp_path / "w"), "encoding": "float64"}).writer(None, False)
    import pyarrow as pa

    batches = [pa.record_batch({"media_id": [5] * 90, "sample_idx": list(range(k, k + 90)), "v": [float(k)] * 90}) for k in range(0, 900, 90)]
    writer.commit([writer.write(iter(batches)), None])
    assert len(os.listdir(tmp_path / "w")) == 5
    assert [r["sample_idx"] for r in spark.read.format("wav").load(str(tmp_path / "w")).orderBy("sample_idx").collect()] == list(range(900))


TEXT = "﻿1\r\n00:00:01,5 --> 00:00:02,000\r\n<i>One</i>\r\n two \r\n\r\n\r\n0:03.25 --> 0:03.2\nno number\n \n3\nbad --> 00:00:09,000\nx\n\n4\n00:00:05,000 --> 00:00:06,000\n今日\nは\n\n5\n00:00:07,000 --> 00:00:08,000\n<b></b>\n"


def test_subrip_is_parsed_like_columns(spark, tmp_path):
    for name, text in (("a b", TEXT.encode()), ("é", "1\n00:00:01,000 --> 00:00:02,000\ncaf\xe9\n".encode("latin-1")), ("none", b"")):
        (tmp_path / f"{name}.srt").write_bytes(text)
    got = sorted(tuple(r)[1:] for r in spark.read.format("srt").option("partitionFiles", "1").load(str(tmp_path)).collect())
    want = sorted((r["idx"], r["start"], r["end"], r["text"]) for r in srt.read(spark, f"file://{tmp_path}").collect())
    assert got == want
    assert len(got) == 3


def test_subrip_round_trip(spark, tmp_path):
    rows = [("a/b", 1, 0.0, 1.5, "one"), ("a/b", 2, 2.0, 3.0, "two\nlines"), ("c", 1, 3661.25, 3662.0, "x"), ("c", 2, 4000.0, 4001.0, "…")]
    mf.write_srt(spark.createDataFrame(rows, "media_id string, idx int, start double, end double, text string"), str(tmp_path / "s"))
    assert sorted(os.listdir(tmp_path / "s")) == ["a%2Fb.srt", "c.srt"]
    back = sorted(map(tuple, spark.read.format("srt").load(str(tmp_path / "s")).collect()))
    assert back == [("a/b", 1, 0.0, 1.5, "one"), ("a/b", 2, 2.0, 3.0, "two lines"), ("c", 1, 3661.25, 3662.0, "x")]
