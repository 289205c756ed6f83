"""Graphs made from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commweave.functions.order import running_before
from commweave.functions.storage import Snapshot

#: Added to supplier and part ids so that they don't fall together with the other side's.
OFFSET = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def copart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that share an order: simple and symmetric."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").distinct()
    other = lines.select("l_orderkey", F.col("l_partkey").alias("dst"))
    return lines.join(other, "l_orderkey").where("l_partkey <> dst").select(F.col("l_partkey").alias("src"), "dst").distinct()


def part_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts and their suppliers: bipartite."""
    return _both_ways(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), (F.col("l_suppkey") + OFFSET).alias("dst")).distinct())


def cust_supp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the suppliers of their orders."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("src"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") + OFFSET).alias("dst"))
    return _both_ways(orders.join(lines, "l_orderkey").select("src", "dst").distinct())


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their parts, an entry for each line: a multigraph with gaps in its ids."""
    return _both_ways(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), (F.col("l_partkey") + OFFSET).alias("dst")))


def user_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's user and the next event's user, directed, with loops and repeats; event_id and event_type ride along.

    Events are numbered by ranges of time and meet the one numbered next, so no task orders all of them.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_id", "event_type", "user_id")
    placed = Snapshot(running_before(events, [F.col("ts"), F.col("event_id")], name="place")).df
    following = placed.select((F.col("place") - 1).alias("place"), F.col("user_id").alias("dst"))
    return placed.join(following, "place").where("dst is not null").select(F.col("user_id").alias("src"), "dst", "event_id", "event_type")


def planted(spark: SparkSession, blocks: int = 20, size: int = 20, inside: float = 0.3, outside: float = 0.005, seed: int = 1) -> DataFrame:
    """A symmetric random graph with planted communities v div size, drawn by a hash so that it is alike anywhere."""
    n = blocks * size
    ids = spark.range(n)
    pairs = ids.select(F.col("id").alias("src")).withColumn("dst", F.explode(F.sequence(F.col("src"), F.lit(n - 1)))).where("src <> dst")
    drawn = F.pmod(F.xxhash64("src", "dst", F.lit(seed)), F.lit(1_000_000)) / 1e6
    same = F.floor(F.col("src") / size) == F.floor(F.col("dst") / size)
    return _both_ways(pairs.where(drawn < F.when(same, inside).otherwise(outside)))
