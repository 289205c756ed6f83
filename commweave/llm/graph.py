"""Connected components by alternating large-star and small-star steps; nothing but counts reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commweave.llm.common import Cut


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """edges (src, dst) of any one orderable type to (node, component), component the smallest node of the component.

    Nodes without an edge to another don't appear; self-loops, repeated edges and edges with a null end are ignored.
    Every step keeps one edge for each node and neighbour at most. A hub's edges meet only in joins, which adaptive
    execution splits, and in minima, which are taken before the shuffle.
    """
    proper = edges.where(F.col("src") != F.col("dst")).select(F.greatest("src", "dst").alias("hi"), F.least("src", "dst").alias("lo")).distinct()
    now, before = Cut(proper), None
    for _ in range(rounds):
        mark = now.df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x")).first()
        if mark == before or not mark["n"]:
            break
        then, before = now, mark
        e = now.df
        least = e.select(F.col("lo").alias("node"), F.col("hi").alias("other")).unionByName(e.select(F.col("hi").alias("node"), F.col("lo").alias("other"))).groupBy("node").agg(F.min("other").alias("other"))
        least = least.select(F.col("node").alias("lo"), F.least("node", "other").alias("to"))
        large = e.join(least, "lo").select("hi", F.col("to").alias("lo")).distinct()
        small = large.groupBy("hi").agg(F.min("lo").alias("to"))
        moved = large.join(small, "hi").where(F.col("lo") != F.col("to")).select(F.col("lo").alias("hi"), F.col("to").alias("lo"))
        now = Cut(moved.unionByName(small.select("hi", F.col("to").alias("lo"))).distinct())
        then.drop()
    else:
        raise RuntimeError(f"components didn't settle in {rounds} rounds")
    stars = now.df
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(stars.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
