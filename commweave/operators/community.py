"""Memberships (v, c) and what is computed for each community."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commweave.functions.order import running_before
from commweave.functions.storage import Snapshot


class CapacityError(ValueError):
    """A community fits no worker, or the workers don't suffice."""


def singletons(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", F.col("v").alias("c"))


def totals(vertices: DataFrame, membership: DataFrame) -> DataFrame:
    """(c, t): sum of degrees by community."""
    return membership.join(vertices, "v").groupBy("c").agg(F.sum("k").alias("t"))


def sizes(vertices: DataFrame, membership: DataFrame) -> DataFrame:
    """(c, n, load): members and sum of degrees."""
    return membership.join(vertices, "v").groupBy("c").agg(F.count("*").alias("n"), F.sum("k").alias("load"))


def community_count(membership: DataFrame) -> DataFrame:
    return membership.agg(F.countDistinct("c").alias("n"))


def neighbor_communities(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(src, dst, c): the community of each entry's neighbour, its own id if it has none."""
    return edges.join(membership.withColumnRenamed("v", "dst"), "dst", "left").select("src", "dst", F.coalesce("c", "dst").alias("c"))


def neighbor_weights(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(v, cand, w): entries of v (or their weights) by the neighbours' community; repeats and self-loops count."""
    w = F.sum("w") if "w" in edges.columns else F.count("*")
    return edges.join(membership.withColumnRenamed("v", "dst"), "dst").groupBy(F.col("src").alias("v"), F.col("c").alias("cand")).agg(w.alias("w"))


def sparse_neighbor_map(edges: DataFrame, membership: DataFrame, vertices: DataFrame, owners: DataFrame, delta: DataFrame) -> DataFrame:
    """(part, neighbor, c, t): what a part has to know of other parts' vertices to move its own vertices of ``delta``."""
    a = owners.select(F.col("v").alias("src"), "part")
    b = owners.select(F.col("v").alias("dst"), F.col("part").alias("there"))
    wanted = edges.join(delta.select(F.col("v").alias("src")).distinct(), "src", "left_semi").join(a, "src").join(b, "dst").where("part <> there")
    near = wanted.select("part", F.col("dst").alias("neighbor")).distinct()
    known = membership.join(totals(vertices, membership), "c").select(F.col("v").alias("neighbor"), "c", "t")
    return near.join(known, "neighbor").select("part", "neighbor", "c", "t")


def sparse_community_map(edges: DataFrame, membership: DataFrame, vertices: DataFrame, owners: DataFrame, delta: DataFrame) -> DataFrame:
    """(part, c, t): the communities a part has to know: of its own vertices of ``delta`` and of their neighbours elsewhere."""
    near = sparse_neighbor_map(edges, membership, vertices, owners, delta).select("part", "c", "t")
    mine = delta.select("v").distinct().join(owners, "v").join(membership, "v").select("part", "c").distinct()
    return near.unionByName(mine.join(totals(vertices, membership), "c").select("part", "c", "t")).distinct()


def spans(vertices: DataFrame, membership: DataFrame) -> DataFrame:
    """(rank, c, start, length, degree_sum): communities by size, load (both descending) and id, laid out one after another."""
    by = [F.col("n").desc(), F.col("load").desc(), F.col("c")]
    ranked = running_before(sizes(vertices, membership), by, name="rank")
    placed = running_before(ranked, [F.col("rank")], F.col("n"), "start")
    return placed.select("rank", "c", "start", F.col("n").alias("length"), F.col("load").alias("degree_sum"))


def reorder(vertices: DataFrame, membership: DataFrame) -> DataFrame:
    """(old_v, new_v, rank): vertices renumbered community by community, by old id inside."""
    ranks = spans(vertices, membership).select("c", "rank")
    keyed = membership.join(ranks, "c").select(F.col("v").alias("old_v"), "rank")
    return running_before(keyed, [F.col("rank"), F.col("old_v")], name="new_v").select("old_v", "new_v", "rank")


def reordered(edges: DataFrame, vertices: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph under the ids of reorder(): edges (src, dst, src_c, dst_c), and vertices (v, k, c, old_v) with c their community's rank."""
    ids = Snapshot(reorder(vertices, membership)).df
    a = ids.select(F.col("old_v").alias("src"), F.col("new_v").alias("a"), F.col("rank").alias("src_c"))
    b = ids.select(F.col("old_v").alias("dst"), F.col("new_v").alias("b"), F.col("rank").alias("dst_c"))
    moved = edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"), "src_c", "dst_c")
    return moved, ids.join(vertices.withColumnRenamed("v", "old_v"), "old_v").select(F.col("new_v").alias("v"), "k", F.col("rank").alias("c"), "old_v")


def first_appearance(membership: DataFrame) -> DataFrame:
    """(c, new_c): communities numbered from 0 by their smallest vertex."""
    least = membership.groupBy("c").agg(F.min("v").alias("least"))
    return running_before(least, [F.col("least")], name="new_c").select("c", "new_c")


def pack(laid_out: DataFrame, workers: int, nodes: int, edges: int) -> DataFrame:
    """(rank, worker): next-fit in rank order; a worker that is left is never filled again.

    Next-fit is one pass in order, so it is one task over a row for each community.
    """

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        worker, held, load = 0, 0, 0
        for b in batches:
            placed = []
            for length, degree_sum in zip(b["length"], b["degree_sum"]):
                if length and held and (held + length > nodes or load + degree_sum > edges):
                    worker, held, load = worker + 1, 0, 0
                if length and (worker >= workers or length > nodes or degree_sum > edges):
                    raise CapacityError(f"no worker can take a community of {length} vertices and {degree_sum} entries")
                held, load = held + length, load + degree_sum
                placed.append(worker)
            yield pd.DataFrame({"rank": b["rank"], "worker": placed})

    return laid_out.select("rank", "length", "degree_sum").coalesce(1).sortWithinPartitions("rank").mapInPandas(walk, "rank long, worker long")


def sample(vertices: DataFrame, percent: float, seed: int = 0) -> DataFrame:
    """(v): max(1, floor(n * percent / 100)) vertices by a seeded hash; all of them for 0 percent.

    Ranks are counted by ranges of the hash, so no task sees more than one range.
    """
    from commweave.functions.order import mixed_hash

    scaled = int(max(0.0, min(100.0, percent)) * 100)
    if not scaled:
        return vertices.select("v")
    hashed = vertices.select("v", mixed_hash(F.col("v"), seed).alias("h")).withColumn("slice", F.shiftright("h", 20))
    counts = hashed.groupBy("slice").agg(F.count("*").alias("n"))  # 4,096 rows at most
    before = counts.withColumn("before", F.sum("n").over(Window.orderBy("slice")) - F.col("n"))
    wanted = counts.agg(F.greatest(F.lit(1), F.floor(F.sum("n") * F.lit(scaled) / F.lit(10000))).alias("wanted"))
    rank = F.row_number().over(Window.partitionBy("slice").orderBy("h", "v"))
    near = hashed.join(F.broadcast(before.crossJoin(wanted)), "slice").where("before < wanted")
    return near.withColumn("r", F.col("before") + rank).where("r <= wanted").select("v")
