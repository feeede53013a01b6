"""Counts in windows of event time over a stream, with a watermark, and the late rows in a table of their own.

Spark's own windowed counts drop late rows in silence.  Here each micro-batch writes, under its number, the counts that it
adds to each window, its late rows and its greatest event time; a batch that is run again after a failure overwrites what it
wrote, so every row counts once.  The watermark of a batch is the greatest event time of the batches before it less the delay,
and a row is late for a window that ends at or before it.  That is what Spark's counts drop if an empty batch follows each
batch, as it does when a stream ends; between batches that follow each other at once they are milder by one batch.  What is
read grows with the windows, not with the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, key: str, length: str, slide: str | None = None) -> DataFrame:
    """events with window_start and window_end: a row for each window that holds it; without slide windows do not overlap."""
    w = F.window("ts", length, slide or length)
    return events.withColumn("w", w).select("*", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")).drop("w")


def native_counts(events: DataFrame, key: str, delay: str, length: str, slide: str | None = None) -> DataFrame:
    """Spark's own counts of a stream or a table, for append mode; late rows are dropped."""
    counts = events.withWatermark("ts", delay).groupBy(F.window("ts", length, slide or length).alias("w"), key).count()
    return counts.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), key, F.col("count").alias("n"))


def _seconds(spark: SparkSession, duration: str) -> float:
    return float(spark.sql(f"SELECT unix_micros(timestamp_seconds(0) + INTERVAL {duration}) / 1e6 AS s").first()["s"])


class Counted:
    """Where the counts, late rows and watermarks of one stream lie."""

    def __init__(self, spark: SparkSession, folder: str, key: str, delay: str, length: str, slide: str | None = None):
        self.spark, self.folder, self.key, self.length, self.slide = spark, folder.rstrip("/"), key, length, slide
        self.delay = _seconds(spark, delay)

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.folder}/{name}") if self._exists(name) else self.spark.createDataFrame([], f"{schema}, batch long")

    def _exists(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def watermark(self, before: int | None = None):
        """Of the batch with that number; without one, of the next batch. None while nothing came."""
        tops = self._table("tops", "ts timestamp")
        at = (tops if before is None else tops.where(F.col("batch") < before)).agg(F.max("ts")).first()[0]
        return None if at is None else self.spark.range(1).select(F.timestamp_micros(F.unix_micros(F.lit(at)) - int(self.delay * 1e6)).alias("w")).first()["w"]

    def add(self, batch: DataFrame, number: int) -> None:
        """One micro-batch, as foreachBatch gives it."""
        batch = batch.persist()
        try:
            mark = self.watermark(number)
            rows = windowed(batch, self.key, self.length, self.slide)
            late = F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark)
            where = lambda name: f"{self.folder}/{name}/batch={number}"
            rows.where(late).write.mode("overwrite").parquet(where("late"))
            rows.where(~late).groupBy("window_start", "window_end", self.key).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(where("counts"))
            batch.agg(F.max("ts").alias("ts")).write.mode("overwrite").parquet(where("tops"))
        finally:
            batch.unpersist()

    def counts(self, key_type: str, closed: bool = True) -> DataFrame:
        """window_start, window_end, key and n; of closed windows only, which no row can change any more, or of all."""
        rows = self._table("counts", f"window_start timestamp, window_end timestamp, {self.key} {key_type}, n long")
        if closed:
            mark = self.watermark()
            rows = rows.where(F.lit(False) if mark is None else F.col("window_end") <= F.lit(mark))
        return rows.groupBy("window_start", "window_end", self.key).agg(F.sum("n").alias("n"))

    def late(self, schema: str) -> DataFrame:
        """The late rows, with a row for each window that they missed. schema: of the events' columns."""
        return self._table("late", f"{schema}, window_start timestamp, window_end timestamp")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that the stream has now; run again with the same checkpoint it goes on where it was."""
        query = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
