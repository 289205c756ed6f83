"""Graphs as DataFrames: edges (src, dst[, w]) with one row for each directed entry, vertices (v, k) with out-degrees."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commweave.functions.order import running_before


def degrees(edges: DataFrame) -> DataFrame:
    """(v, k) of every endpoint; k counts the entries that leave v, so a sink has 0."""
    ends = edges.select(F.col("src").alias("v"), F.lit(1).alias("n")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).alias("n")))
    return ends.groupBy("v").agg(F.sum("n").cast("long").alias("k"))


@dataclass
class Graph:
    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def from_edges(cls, df: DataFrame, src: str = "src", dst: str = "dst", symmetrize: bool = False) -> Graph:
        """Entries exactly as given: repeated entries and self-loops stay. symmetrize adds the reverse of each."""
        edges = df.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst"))
        if symmetrize:
            edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        return cls(edges, degrees(edges))

    def two_m(self) -> DataFrame:
        """One row (two_m): the sum of all degrees."""
        return self.vertices.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("two_m"))


def number(vertices: DataFrame) -> DataFrame:
    """(orig, v): the vertices v numbered from 0 by ascending id."""
    return running_before(vertices.select(F.col("v").alias("orig")), [F.col("orig")], name="v").select("orig", "v")


def dense_ids(edges: DataFrame) -> DataFrame:
    """(orig, v): the ends of edges numbered from 0 by ascending id."""
    return number(edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct())


def encode(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with both ends replaced by their dense ids."""
    a = ids.select(F.col("orig").alias("src"), F.col("v").alias("a"))
    b = ids.select(F.col("orig").alias("dst"), F.col("v").alias("b"))
    return edges.join(a, "src").join(b, "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))


def csr_offsets(vertices: DataFrame) -> DataFrame:
    """(v, k, start): where a vertex's entries start when all are laid out by vertex."""
    return running_before(vertices.select("v", "k"), [F.col("v")], F.col("k"), "start")


def adjacency(edges: DataFrame) -> DataFrame:
    """(v, neighbors): sorted neighbours with repeats."""
    return edges.groupBy(F.col("src").alias("v")).agg(F.array_sort(F.collect_list("dst")).alias("neighbors"))


def ranges(vertices: DataFrame, parts: int) -> DataFrame:
    """(v, part): contiguous ranges of ceil(n / parts) vertices by ascending id."""
    numbered = number(vertices)
    width = vertices.agg(F.ceil(F.count("*") / F.lit(parts)).cast("long").alias("width"))
    return numbered.crossJoin(F.broadcast(width)).select(F.col("orig").alias("v"), F.floor(F.col("v") / F.col("width")).cast("long").alias("part"))


def range_partition(edges: DataFrame, parts: int) -> DataFrame:
    """ranges() of the ends of edges."""
    return ranges(degrees(edges), parts)


def external_edges(edges: DataFrame, owners: DataFrame) -> DataFrame:
    """(part, n_edges): entries of each part that lead to another part."""
    a = owners.select(F.col("v").alias("src"), "part")
    b = owners.select(F.col("v").alias("dst"), F.col("part").alias("there"))
    return edges.join(a, "src").join(b, "dst").where("part <> there").groupBy("part").agg(F.count("*").alias("n_edges"))
