"""Small helpers the operators of this subpackage share."""

from __future__ import annotations

import functools
import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of ids that are broadcast: 16 bytes each.
ID_ROWS = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; on one machine (local[..]) a temporary one is set where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/chronolex/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later jobs neither compute it again nor depend on an executor."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Delete tables of stored() that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        files = df.inputFiles()
        if files and "/chronolex/" in files[0]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def returned() -> None:
    """Give back to the system what this Python worker has freed."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def returning(work):
    """work, a generator that a task runs, with freed memory given back when it begins, as workers serve many jobs and a
    broadcast goes just before, and when it ends, as a worker that waits for its next task keeps what it holds."""

    @functools.wraps(work)
    def run(batches):
        gc.collect()
        returned()
        try:
            yield from work(batches)
        finally:
            returned()

    return run


def broadcast_checked(df: DataFrame, max_rows: int) -> DataFrame:
    """df, marked to be broadcast if it is counted to have at most max_rows rows; else Spark shuffles it."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def semi_join_checked(left: DataFrame, keys: DataFrame, key: str, max_rows: int, how: str = "left_semi") -> DataFrame:
    """Rows of left whose key is among keys (left_anti: is not); keys are broadcast only if counted to be at most max_rows."""
    return left.join(broadcast_checked(keys, max_rows), key, how)
