"""Positions and running totals over a whole table, without moving it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commweave.functions.storage import Snapshot


def running_before(df: DataFrame, by: list[Column], value: Column | None = None, name: str = "before") -> DataFrame:
    """``df`` plus the sum of ``value`` (by default 1: the 0-based position) over all rows that sort before.

    Rows are dealt by range and written once; each range is summed on its own and shifted by the totals of the ranges
    before it, of which there are as many as shuffle partitions.
    """
    value = F.lit(1) if value is None else value
    ranged = Snapshot(df.withColumn("_value", value.cast("long")).repartitionByRange(*by).withColumn("_range", F.spark_partition_id())).df
    shift = ranged.groupBy("_range").agg(F.sum("_value").alias("_sum"))
    shift = shift.withColumn("_shift", F.sum("_sum").over(Window.orderBy("_range")) - F.col("_sum")).drop("_sum")
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return ranged.withColumn("_inside", inside).join(F.broadcast(shift), "_range").withColumn(name, F.col("_inside") + F.col("_shift")).drop("_value", "_range", "_inside", "_shift")


def mixed_hash(v: Column, seed: int = 0) -> Column:
    """A hash of ids from 0 on that plain SQL computes alike: (v * 2654435761 + seed) mod 2**32, by halves of 16 bits."""
    low = v.cast("long").bitwiseAND(F.lit((1 << 32) - 1))
    high, low = F.shiftright(low, 16), low.bitwiseAND(F.lit((1 << 16) - 1))
    return ((high * F.lit(2654435761)) % F.lit(1 << 16) * F.lit(1 << 16) + low * F.lit(2654435761) + F.lit(seed)) % F.lit(1 << 32)
