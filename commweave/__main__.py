"""python -m commweave GRAPH [--rounds N] [--levels N] [--out DIR] [--membership FILE] ...: communities of an edge list."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from commweave.functions.ship import ship
from commweave.operators import community, graph, quality
from commweave.plans.detect import detect
from commweave.sources import text


def main(argv: list[str] | None = None) -> None:
    args = argparse.ArgumentParser(prog="commweave", description="Communities of an edge list, written as id,community.")
    args.add_argument("graph")
    args.add_argument("--rounds", type=int, default=10)
    args.add_argument("--levels", type=int, default=5)
    args.add_argument("--sub-rounds", type=int, default=8)
    args.add_argument("--out", default="membership")
    args.add_argument("--membership", help="lines 'index community' or 'community' by dense index")
    args.add_argument("--by-id", action="store_true", help="the membership's lines name vertices by their ids in the graph")
    args.add_argument("--delta-percent", type=float, default=float(os.environ.get("DELTA_PERCENT") or 0))
    args.add_argument("--seed", type=int, default=0)
    args.add_argument("--no-header", action="store_true")
    args.add_argument("--symmetrize", action="store_true")
    args.add_argument("--unweighted", action="store_true", help="forget edge weights between levels")
    args.add_argument("--refine", action="store_true")
    a = args.parse_args(argv)
    spark = ship(SparkSession.builder.appName("commweave").getOrCreate())
    edges = text.read_edge_list(spark, a.graph, header=not a.no_header)
    ids = graph.dense_ids(edges)
    g = graph.Graph.from_edges(graph.encode(edges, ids), symmetrize=a.symmetrize)
    start = text.read_membership(spark, a.membership, ids.count(), ids if a.by_id else None) if a.membership else community.singletons(g.vertices)
    metrics: list[dict] = []
    found = detect(g, start, max(1, a.rounds), a.levels, a.sub_rounds, not a.unweighted, a.delta_percent, seed=a.seed, refine=a.refine, metrics=metrics)
    text.write_membership(found.join(ids, "v").select(F.col("orig").alias("v"), "c"), a.out)
    r = quality.report(g.edges, g.vertices, start, found).first()
    for m in metrics:
        print("level {level}: {vertices} vertices, {communities} communities, {moves} moves in {rounds} rounds, {seconds:.1f} s".format(**m))
    print(f"{community.community_count(found).first()['n']} communities; edge-restricted quality {r['q0']:.6f} to {r['q1']:.6f} ({r['pct']:+.2f} %)")


if __name__ == "__main__":
    main()
