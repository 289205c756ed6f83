"""Which vertices and communities a batch of edge updates (op, src, dst, ...) touches, and who owns them.

owners (v, owner) and community_owners (c, owner) are DataFrames; updates with an end that has no owner are skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INSERT, DELETE = "INSERT", "DELETE"


def resolve(updates: DataFrame, membership: DataFrame, owners: DataFrame, community_owners: DataFrame) -> DataFrame:
    """Updates plus the owner, community and community's owner of both ends."""
    known = membership.join(owners, "v").join(community_owners.withColumnRenamed("owner", "c_owner"), "c")
    for end, side in (("src", "u"), ("dst", "v")):
        updates = updates.join(known.select(F.col("v").alias(end), F.col("owner").alias(f"owner_{side}"), F.col("c").alias(f"c_{side}"), F.col("c_owner").alias(f"c_owner_{side}")), end)
    return updates


def affected_vertices(resolved: DataFrame) -> DataFrame:
    """(owner, v): both ends of every update, each once."""
    return resolved.selectExpr("stack(2, owner_u, src, owner_v, dst) as (owner, v)").distinct()


def affected_communities(resolved: DataFrame) -> DataFrame:
    """(owner, c): the communities of both ends at their owners, each once."""
    return resolved.selectExpr("stack(2, c_owner_u, c_u, c_owner_v, c_v) as (owner, c)").distinct()


def _joining(resolved: DataFrame) -> DataFrame:
    return resolved.where((F.col("op") == INSERT) & (F.col("c_u") != F.col("c_v")))


def candidate_communities(resolved: DataFrame) -> DataFrame:
    """(owner, c, n): communities that an insertion offers to the owner of its source, with repeats counted."""
    return _joining(resolved).groupBy(F.col("owner_u").alias("owner"), F.col("c_v").alias("c")).agg(F.count("*").alias("n"))


def remote_notifications(resolved: DataFrame) -> DataFrame:
    """(from_owner, c, to_owner, n): insertions between communities whose ends have different owners."""
    return _joining(resolved).where("owner_u <> owner_v").groupBy(F.col("owner_u").alias("from_owner"), F.col("c_v").alias("c"), F.col("c_owner_v").alias("to_owner")).agg(F.count("*").alias("n"))


def update_routing(resolved: DataFrame) -> DataFrame:
    """(owner, update_idx): every update goes to the owners of its ends, once if they are the same."""
    return resolved.select(F.explode(F.array_distinct(F.array("owner_u", "owner_v"))).alias("owner"), "update_idx")


def apply_updates(edges: DataFrame, updates: DataFrame) -> DataFrame:
    """Edges without the deleted pairs, plus the inserted ones."""
    gone = updates.where(F.col("op") == DELETE).select("src", "dst").distinct()
    return edges.join(gone, ["src", "dst"], "left_anti").select("src", "dst").unionByName(updates.where(F.col("op") == INSERT).select("src", "dst"))
