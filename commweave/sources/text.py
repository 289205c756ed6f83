"""Text formats: edge lists, memberships, edge traces; and the CSV that a run writes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class FormatError(ValueError):
    """Input that the format doesn't allow."""


def _tokens(line: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(line, r"\s+", " ")), " "), lambda t: t != "")


def parse_edges(lines: DataFrame, line: str = "value") -> DataFrame:
    """(src, dst) of lines of two ids; columns beyond are left out. Lines without two ids have nulls, blank ones go."""
    t = lines.select(_tokens(F.col(line)).alias("t")).where(F.size("t") > 0)
    at = lambda i: F.expr(f"try_cast(get(t, {i}) as bigint)")
    return t.select(at(0).alias("src"), at(1).alias("dst"))


def read_edge_list(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(src, dst) of an edge list whose first line is ``N M`` (or, with header=False, an edge).

    FormatError for a header that isn't two numbers, a line without two ids, or no edge at all.
    """
    lines = spark.read.text(path, wholetext=False).withColumn("at", F.struct(F.input_file_name(), F.monotonically_increasing_id()))
    if header:
        first = lines.orderBy("at").select("value").first()
        if first is None or len(first[0].split()) != 2 or not all(x.isdigit() for x in first[0].split()):
            raise FormatError("the first line must be the numbers of nodes and edges")
        mark = lines.agg(F.min("at").alias("first"))
        lines = lines.join(F.broadcast(mark), F.col("at") > F.col("first"), "left_semi")
    edges = parse_edges(lines)
    seen = edges.agg(F.count("*").alias("n"), F.count_if(F.col("src").isNull() | F.col("dst").isNull()).alias("bad")).first()
    if seen["bad"]:
        raise FormatError(f"{seen['bad']} lines aren't pairs of ids")
    if not seen["n"]:
        raise FormatError("the graph has no edge")
    return edges


def parse_membership(lines: DataFrame, line: str = "value") -> DataFrame:
    """(idx, c, bad) of lines ``idx comm``; empty lines and comments go, others are bad."""
    kept = lines.where((F.col(line) != "") & ~F.col(line).startswith("#")).select(_tokens(F.col(line)).alias("t"))
    at = lambda i: F.expr(f"try_cast(get(t, {i}) as bigint)")
    rows = kept.select(at(0).alias("idx"), at(1).alias("c"))
    return rows.withColumn("bad", F.col("idx").isNull() | F.col("c").isNull() | (F.col("idx") < 0) | (F.col("c") < 0))


def membership_faults(parsed: DataFrame, n: int | Column) -> DataFrame:
    """(kind, n): how many malformed, out_of_range, duplicate and missing entries a membership of n vertices has."""
    n = F.lit(n) if isinstance(n, int) else n
    good = parsed.where(~F.col("bad"))
    inside = good.where(F.col("idx") < n).groupBy("idx").agg(F.count("*").alias("times"))
    counts = inside.agg(F.count_if(F.col("times") > 1).alias("duplicate"), (F.first(n, ignorenulls=True) - F.count("*")).alias("missing"))
    rows = parsed.agg(F.count_if("bad").alias("malformed"), F.count_if(~F.col("bad") & (F.col("idx") >= n)).alias("out_of_range"))
    return rows.crossJoin(counts).selectExpr("stack(4, 'malformed', malformed, 'out_of_range', out_of_range, 'duplicate', duplicate, 'missing', coalesce(missing, 0)) as (kind, n)")


def communities_named(membership: DataFrame) -> DataFrame:
    """One row (num): one more than the largest community, which is how many there can be."""
    return membership.agg((F.coalesce(F.max("c"), F.lit(-1)) + 1).alias("num"))


def keyed_membership(parsed: DataFrame, ids: DataFrame, by_index: bool = True) -> DataFrame:
    """(v, c) by dense id: of rows (idx, c) whose idx is a dense id or (by_index=False) an original id of ``ids`` (orig, v)."""
    if by_index:
        return parsed.select(F.col("idx").alias("v"), "c")
    return parsed.join(ids, F.col("idx") == F.col("orig")).select("v", "c")


def read_membership(spark: SparkSession, path: str, n: int, ids: DataFrame | None = None) -> DataFrame:
    """(v, c) for the n vertices 0..n-1 from lines ``idx comm`` or ``comm``; FormatError for any fault.

    ids (orig, v): lines name vertices by original id instead of dense index, all of them.

    A bare ``comm`` belongs to the running vertex, which moves on when a line names it; a file with bare lines is read
    in order by one task.
    """
    lines = spark.read.text(path)
    data = lines.where((F.col("value") != "") & ~F.col("value").startswith("#"))
    if ids is not None:
        # Ids that are no vertex's are out of range, as an index beyond the last one is.
        parsed = parse_membership(lines).join(ids, F.col("idx") == F.col("orig"), "left")
        parsed = parsed.select(F.when(F.col("idx").isNotNull(), F.coalesce("v", F.lit(n).cast("long"))).alias("idx"), "c", "bad")
    elif data.where(F.size(_tokens(F.col("value"))) == 1).isEmpty():
        parsed = parse_membership(lines)
    else:

        def in_order(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            following = 0
            for b in batches:
                out = []
                for value in b["value"]:
                    t = value.split()
                    good = bool(t) and all(x.isdigit() for x in t[:2])
                    idx, c = (int(t[0]), int(t[1])) if good and len(t) > 1 else (following, int(t[0]) if good else -1)
                    following += good and idx == following
                    out.append((idx, c, not good))
                yield pd.DataFrame(out, columns=["idx", "c", "bad"])

        ordered = data.withColumn("at", F.monotonically_increasing_id()).coalesce(1).sortWithinPartitions("at")
        parsed = ordered.select("value").mapInPandas(in_order, "idx long, c long, bad boolean")
    faults = {r["kind"]: r["n"] for r in membership_faults(parsed, n).collect()}
    if parsed.isEmpty():
        raise FormatError("the membership is empty")
    if found := {k: x for k, x in faults.items() if x}:
        raise FormatError(f"faults in the membership: {found}")
    return parsed.select(F.col("idx").alias("v"), "c")


def parse_trace(lines: DataFrame, most: int | Column, line: str = "value") -> DataFrame:
    """(op, src, dst, weight) of trace lines ``u v [w]``; works on streams too.

    Commas and semicolons separate as blanks do; blank lines and those of % or # go, as do lines whose ids aren't
    numbers below ``most``. A weight that is missing, no number, 0 or beyond 32 bits is 1. All are insertions.
    """
    body = F.trim(F.regexp_replace(F.col(line), r"[\s,;]+", " "))
    t = lines.where(~F.regexp_replace(F.col(line), r"^\s+", "").rlike("^(%|#|$)")).select(F.split(body, " ").alias("t"))
    at = lambda i: F.expr(f"try_cast(get(t, {i}) as bigint)")
    rows = t.select(at(0).alias("src"), at(1).alias("dst"), at(2).alias("w"))
    most = F.lit(most) if isinstance(most, int) else most
    inside = rows.where(F.col("src").between(0, most - 1) & F.col("dst").between(0, most - 1))
    weight = F.when(F.col("w").between(1, 4294967295), F.col("w")).otherwise(F.lit(1).cast("long"))
    return inside.select(F.lit("INSERT").alias("op"), "src", "dst", weight.alias("weight"))


def write_membership(membership: DataFrame, path: str) -> None:
    """``id,community`` without header, ordered by id."""
    membership.select("v", "c").orderBy("v").write.mode("overwrite").csv(path, header=False)
