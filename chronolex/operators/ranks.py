"""Values at exact ranks of groups of any size.

A group's values are counted before they are shuffled, and the distinct ones dealt by ranges, so that a group with a third of all
rows is spread over tasks; from the ranges' counts follows the one range in which a rank lies, and only that is looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.storage import stored


def at_ranks(df: DataFrame, key: str, value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key, name, value: for each of `ranks` the value at that rank, counted from 0, which is given by the number of the group's
    rows that have a value. Groups without any, or without that rank, are left out."""
    counted = df.where(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    parts = stored(counted.repartitionByRange(key, "v").withColumn("part", F.spark_partition_id()))
    sums = parts.groupBy(key, "part").agg(F.sum("n").alias("in_part"))  # a row for each key and range that share rows
    order = Window.partitionBy(key).orderBy("part")
    sums = sums.select(key, "part", "in_part", (F.sum("in_part").over(order) - F.col("in_part")).alias("before"), F.sum("in_part").over(Window.partitionBy(key)).alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("total")).cast("long").alias("rank")) for name, rank in ranks.items()])).alias("w")
    wanted = sums.select(key, "part", "in_part", "before", each).select(key, "part", "before", "in_part", "w.*").where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("in_part")))
    near = parts.join(wanted, [key, "part"])
    up_to = F.sum("n").over(Window.partitionBy(key, "name").orderBy("v")) + F.col("before")
    found = near.withColumn("up_to", up_to).where(F.col("up_to") > F.col("rank"))
    return found.groupBy(key, "name").agg(F.min("v").alias("value"))
