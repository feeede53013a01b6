"""Streams in shuffled micro-batches, over restarts, with timers and in event time, against their twins over tables."""

from __future__ import annotations

import random
import time

import pytest
from pyspark.sql import functions as F

from chronolex.sources import tables as t
from chronolex.streaming import event_time, live

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def state_store(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def streamed(spark, path, df, order, make, parts, runs=2):
    """What make(stream) gives out for df's rows, sent in `parts` files in the given order, with a restart between `runs`."""
    rows = sorted(df.collect(), key=order)
    size = -(-len(rows) // parts)
    out = []
    for run in range(runs):
        for k in range(run * parts // runs, (run + 1) * parts // runs):
            if part := rows[k * size : (k + 1) * size]:
                spark.createDataFrame(part, df.schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
                time.sleep(0.02)
        source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
        query = make(source).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        assert query.exception() is None
        query.stop()
    out = spark.read.parquet(f"{path}/out")
    return sorted(map(tuple, out.collect()), key=str)


def dense(rows):
    """seq as 0, 1, 2 and so on in each medium."""
    from pyspark.sql import Window

    return rows.withColumn("seq", (F.row_number().over(Window.partitionBy("media_id").orderBy("seq")) - 1).cast("long"))


def shuffled(seed):
    r = random.Random(seed)
    return lambda row: r.random()


def events(spark):
    e = t.table(spark, SF, "events")
    return dense(e.select((F.col("user_id") % 9).alias("media_id"), F.col("event_id").alias("seq"), "event_type", (F.col("event_id") + F.col("value")).alias("arrived")))


def test_order_is_restored_over_a_restart(spark, tmp_path):
    rows = events(spark)
    want = live.in_order(rows.withColumnRenamed("seq", "idx")).select("media_id", "idx", "given_at")
    got = streamed(spark, tmp_path, rows.select("media_id", "seq", "arrived"), shuffled(1), lambda s: live.over_stream(s, "reached", "arrived", ordered=True), 8)
    assert got == sorted(map(tuple, want.collect()), key=str)


def test_pauses_in_an_ordered_stream(spark, tmp_path):
    rows = events(spark)
    want = live.while_running(rows, F.col("event_type") == "error", F.col("event_type") == "purchase").select("media_id", "seq", "event_type")
    got = streamed(spark, tmp_path, rows.select("media_id", "seq", "event_type"), shuffled(2), lambda s: live.over_stream(s, "gate", "event_type", ordered=True, pauses="error", resumes="purchase"), 6)
    assert got == sorted(map(tuple, want.collect()), key=str)
    assert 0 < len(got) < rows.count()


def test_commits_of_an_ordered_stream(spark, tmp_path):
    from chronolex.plans import registry

    p = dense(t.pieces(spark, SF).select("media_id", F.col("piece_idx").alias("seq"), "text"))
    want = registry.queries()["s8_commit"](spark, SF).select("media_id", "n", "source")
    got = streamed(spark, tmp_path, p, shuffled(3), lambda s: live.committed(live.over_stream(s, "before", "text", ordered=True)), 6)
    assert sorted(str((m, n, x)) for m, _, n, x in got) == sorted(str(tuple(r)) for r in want.collect())


def test_repeated_and_missing_places(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 2, "c"), (1, 0, "again"), (1, 2, "again"), (1, 1, "b"), (1, 4, "e"), (2, 1, "never")], "media_id long, seq long, item string")
    steps = {("a", 0): 0, ("c", 2): 1, ("again", 0): 2, ("again", 2): 3, ("b", 1): 4, ("e", 4): 5, ("never", 1): 6}
    got = streamed(spark, tmp_path, rows, lambda r: steps[r["item"], r["seq"]], lambda s: live.over_stream(s, "through", "item", ordered=True), 7, runs=3)
    assert got == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c")]


def test_state_has_named_fields():
    state = live.Latest(most=3)
    for x in "abcd":
        state.feed(x)
    again = live.restored(live.Latest, {"most": 9}, live.saved(state))
    assert (again.most, list(again.items)) == (3, ["b", "c", "d"])
    older = live.restored(live.Segmenter, {}, '{"at": 7, "gone": 1}')
    assert (older.at, older.floor) == (7, 0.002)
    assert not hasattr(older, "gone")


def _for_a_while(spark, tmp_path, df, make, done, seconds=90):
    """Rows that make(stream) gives out while the query goes on, until done(rows)."""
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    name = f"t{random.randrange(10**9)}"
    query = make(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="300 milliseconds").start()
    end = time.time() + seconds
    try:
        while time.time() < end:
            assert query.exception() is None
            rows = sorted(map(tuple, spark.table(name).collect()), key=str)
            if done(rows):
                return rows
            time.sleep(0.5)
    finally:
        query.stop()
    raise AssertionError(rows)


def test_rehearsals_fire_while_a_medium_is_silent(spark, tmp_path):
    rows = [(1, 0, 6000), (1, 1, 3000), (2, 0, 5000), (3, 0, 9000), (3, 1, None), (4, 0, 20_000)]
    df = spark.createDataFrame(rows, "media_id long, seq long, n long")
    got = _for_a_while(spark, tmp_path, df, lambda s: live.rehearsals(s, every=0.5), lambda rows: len(rows) >= 2)
    time.sleep(0.1)
    assert got == [(1, 1, 9000), (4, 0, 20_000)]


def test_what_is_held_comes_out_when_nothing_comes(spark, tmp_path):
    df = spark.createDataFrame([(1, 0, "one. two"), (2, 0, "three")], "media_id long, seq long, text string")
    got = _for_a_while(spark, tmp_path, df, lambda s: live.over_stream(s, "phrases", "text", idle_seconds=1), lambda rows: len(rows) >= 3)
    assert got == [(1, 0, "one."), (1, 0, "two"), (2, 0, "three")]


EVENT = "id long, ts timestamp, kind string"


def _rows(seed, n, spread):
    r = random.Random(seed)
    return [(i, 1_700_000_000 + 60 * i + r.randint(-spread, spread), r.choice("ab")) for i in range(n)]


def _frame(spark, rows):
    return spark.createDataFrame(rows, "id long, s long, kind string").select("id", F.timestamp_seconds("s").alias("ts"), "kind")


@pytest.mark.parametrize("slide", [None, "2 minutes"])
def test_counts_and_late_rows_against_a_loop_and_sparks_own(spark, tmp_path, slide):
    rows = _rows(5, 240, 900)
    parts = [rows[i : i + 40] for i in range(0, 240, 40)]
    out = event_time.Counted(spark, f"{tmp_path}/out", "kind", "3 minutes", "10 minutes", slide)
    step, top, counts, late = 600 if slide is None else 120, None, {}, []
    for part in parts:
        _frame(spark, part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.02)
        source = spark.readStream.schema(EVENT).parquet(f"{tmp_path}/in")
        out.run(source, f"{tmp_path}/ck")
        own = event_time.native_counts(source, "kind", "3 minutes", "10 minutes", slide)
        query = own.writeStream.format("parquet").option("path", f"{tmp_path}/own").option("checkpointLocation", f"{tmp_path}/own-ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(240)
        for i, s, kind in part:
            start = s // step * step
            while start > s - 600:
                if top is not None and start + 600 <= top - 180:
                    late.append((i, start))
                else:
                    counts[start, kind] = counts.get((start, kind), 0) + 1
                start -= step
        top = max(top or 0, *(s for _, s, _ in part))
    seconds = F.unix_seconds("window_start")
    assert sorted(map(tuple, out.late(EVENT).select("id", seconds).collect())) == sorted(late)
    assert late
    closed = {k: n for k, n in counts.items() if k[0] + 600 <= top - 180}
    assert {(r[0], r["kind"]): r["n"] for r in out.counts("string").select(seconds, "kind", "n").collect()} == closed
    assert {(r[0], r["kind"]): r["n"] for r in out.counts("string", closed=False).select(seconds, "kind", "n").collect()} == counts
    assert {(r[0], r["kind"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/own").select(seconds, "kind", "n").collect()} == closed


def test_a_batch_that_runs_twice_counts_once(spark, tmp_path):
    out = event_time.Counted(spark, f"{tmp_path}/out", "kind", "0 seconds", "10 minutes")
    assert out.counts("string").count() == 0
    assert out.late(EVENT).count() == 0
    first, second = _frame(spark, _rows(1, 30, 0)), _frame(spark, _rows(2, 30, 0))
    for number, batch in ((0, first), (0, first), (1, second), (1, second)):
        out.add(batch, number)
    n = out.counts("string", closed=False).agg(F.sum("n")).first()[0]
    assert n + out.late(EVENT).count() == 60
