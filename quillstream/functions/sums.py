"""Running sums that no single task has to hold a whole group for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_BITS = 12


def running_sum(rows: DataFrame, group: str, order: str, value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over the rows of ``group`` up to this one, by ``order`` (a whole number, unique in the group).

    Two levels: sums of blocks of 4,096 numbers, then rows within their block, so that a group holding a
    third of all rows is spread over many windows.
    """
    blocked = rows.withColumn("_value", value).withColumn("_block", F.shiftright(order, BLOCK_BITS))
    sums = blocked.groupBy(group, "_block").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(F.col(group).alias("_group"), F.col("_block").alias("_b"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    joined = blocked.join(bases, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_block") == F.col("_b")))
    return joined.withColumn(name, F.col("_base") + F.sum("_value").over(within)).drop("_value", "_block", "_group", "_b", "_base")
