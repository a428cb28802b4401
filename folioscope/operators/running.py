"""Running values over long groups: windows over stretches of the order column, chained by one row a stretch.

A group (one manuscript, one user) may hold a third of all rows; no window here holds more than `width` positions of it, and
the chaining windows see one row for each stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

WIDTH = 4096


def _stretches(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_stretch", F.floor(F.col(order) / width))


def running_last(df: DataFrame, key: str, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the last value that is not null up to and with each row of its key, in the order of an integer column."""
    d = _stretches(df.withColumn("_value", value), order, width)
    ends = d.groupBy(key, "_stretch").agg(F.max_by(F.struct("_value"), F.when(F.col("_value").isNotNull(), F.col(order))).alias("end"))
    before = F.last("end", ignorenulls=True).over(W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(key, "_stretch", before.alias("_before"))
    inside = F.last(F.when(F.col("_value").isNotNull(), F.struct("_value")), ignorenulls=True).over(W.partitionBy(key, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("_inside", inside).join(ends, [key, "_stretch"]).withColumn(name, F.coalesce("_inside", "_before")["_value"]).drop("_value", "_stretch", "_inside", "_before")


def running_sum(df: DataFrame, key: str, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the sum of a value over all rows of its key up to and with each row."""
    d = _stretches(df.withColumn("_value", value), order, width)
    sums = d.groupBy(key, "_stretch").agg(F.sum("_value").alias("s"))
    before = F.sum("s").over(W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select(key, "_stretch", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum("_value").over(W.partitionBy(key, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("_inside", inside).join(sums, [key, "_stretch"]).withColumn(name, F.col("_before") + F.coalesce("_inside", F.lit(0))).drop("_value", "_stretch", "_inside", "_before")


def running_min(df: DataFrame, key: str, order: str, value: Column, name: str, width: int = WIDTH) -> DataFrame:
    """df with the least value that is not null up to and with each row of its key."""
    d = _stretches(df.withColumn("_value", value), order, width)
    ends = d.groupBy(key, "_stretch").agg(F.min("_value").alias("s"))
    before = F.min("s").over(W.partitionBy(key).orderBy("_stretch").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select(key, "_stretch", before.alias("_before"))
    inside = F.min("_value").over(W.partitionBy(key, "_stretch").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    return d.withColumn("_inside", inside).join(ends, [key, "_stretch"]).withColumn(name, F.least("_inside", "_before")).drop("_value", "_stretch", "_inside", "_before")
