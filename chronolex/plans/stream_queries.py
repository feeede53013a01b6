"""Queries that run a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.storage import folder
from chronolex.plans.registry import query
from chronolex.sources import tables as t
from chronolex.streaming.event_time import Counted

#: Windows, how late rows may be, and the time in which arrivals are taken together.
LENGTH, SLIDE, DELAY, ARRIVALS_US = "6 hours", "2 hours", "2 hours", 259_200_000_000
EVENT = "event_id long, ts timestamp, event_type string, arrival long"


def _arrivals(spark: SparkSession, sf: str) -> DataFrame:
    """Events with the number of the batch in which they arrive: ten minutes late for each unit of their value."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000) + F.round(F.col("value") * 100).cast("long") * 6_000_000
    return t.table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", F.floor(us / ARRIVALS_US).alias("arrival"))


def _counted(spark: SparkSession, sf: str, slide: str | None) -> Counted:
    """The events' counts, streamed in the order of arrival; the stream is stopped after each batch and goes on from its checkpoint."""
    base, rows = folder(spark), _arrivals(spark, sf)
    out = Counted(spark, f"{base}/out", "event_type", DELAY, LENGTH, slide)
    for number in [r["arrival"] for r in rows.select("arrival").distinct().orderBy("arrival").collect()]:
        rows.where(F.col("arrival") == number).write.mode("append").parquet(f"{base}/in")
        out.run(spark.readStream.schema(EVENT).parquet(f"{base}/in"), f"{base}/checkpoint")
    return out


def _sql(slides: int, result: str) -> str:
    step = 21_600 // slides
    return f"""WITH a AS (SELECT event_id, ts, event_type, (epoch_us(ts) - 1704067200000000 + round(value * 100)::BIGINT * 6000000) // {ARRIVALS_US} AS b FROM events),
    m AS (SELECT b, max(max(ts)) OVER (ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 2 HOUR AS mark FROM a GROUP BY b),
    w AS (SELECT a.*, mark, make_timestamp(((epoch_us(ts) // 1000000) // {step} - k) * {step} * 1000000) AS window_start FROM a JOIN m USING (b), range({slides}) r(k)),
    x AS (SELECT *, window_start + INTERVAL 6 HOUR AS window_end, coalesce(window_start + INTERVAL 6 HOUR <= mark, false) AS late FROM w)
    {result}"""


_COUNTS = "SELECT window_start, window_end, event_type, count(*) AS n FROM x WHERE NOT late AND window_end <= (SELECT max(ts) - INTERVAL 2 HOUR FROM a) GROUP BY ALL"


def _plain(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@query(_sql(1, _COUNTS))
def s12_tumbling(spark: SparkSession, sf: str) -> DataFrame:
    """Events in windows of six hours that are closed, without those that came too late."""
    return _plain(_counted(spark, sf, None).counts("string"))


@query(_sql(3, _COUNTS))
def s12_sliding(spark: SparkSession, sf: str) -> DataFrame:
    """The same in windows that begin every two hours."""
    return _plain(_counted(spark, sf, SLIDE).counts("string"))


@query(_sql(3, "SELECT event_id, window_start, window_end FROM x WHERE late"))
def s12_late(spark: SparkSession, sf: str) -> DataFrame:
    """Events that came too late, and the windows that they missed."""
    return _plain(_counted(spark, sf, SLIDE).late(EVENT)).select("event_id", "window_start", "window_end")
