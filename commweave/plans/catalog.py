"""The named queries; each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from commweave.functions.storage import Snapshot, shared_dir
from commweave.functions.synth import synth_updates as synth
from commweave.operators import community, contract, graph, incremental, move, quality
from commweave.plans.detect import detect, local_move, move_affected
from commweave.sources import tables, text
from commweave.sources.store import stored

#: Warm start: vertex v in community v mod C0; parts and owners of the examples.
C0, PARTS, OWNERS = 25, 8, 4


def _warm(vertices: DataFrame) -> DataFrame:
    return vertices.select("v", (F.col("v") % C0).alias("c"))


def _copart(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    g = stored(spark, sf_dir, "copart")
    return g.edges, g.vertices, _warm(g.vertices)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(community, n_parts, total_degree) of the co-purchase graph, largest first."""
    g = stored(spark, sf_dir, "copart")
    found = detect(g)
    return community.sizes(g.vertices, found).select(F.col("c").alias("community"), F.col("n").alias("n_parts"), F.col("load").alias("total_degree")).orderBy(F.desc("n_parts"), "community")


def edge_scan(spark, sf_dir):
    lines = stored(spark, sf_dir, "user_next").edges.select(F.concat_ws(" ", "src", "dst").alias("value"))
    return text.parse_edges(lines).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


def dense_ids(spark, sf_dir):
    return graph.number(stored(spark, sf_dir, "order_part").vertices)


def csr_offsets(spark, sf_dir):
    return graph.csr_offsets(stored(spark, sf_dir, "part_supp").vertices)


def singleton_membership(spark, sf_dir):
    return community.singletons(stored(spark, sf_dir, "copart").vertices)


def membership_check(spark, sf_dir):
    """A membership with planted faults: every 97th entry is missing, every 89th is there twice, others are malformed or out of range."""
    ids = graph.number(stored(spark, sf_dir, "copart").vertices)
    n = ids.count()
    v, c = F.col("v"), F.col("v") % C0
    line = F.when(v % 83 == 1, F.concat_ws(" ", F.lit("x"), c)).when(v % 79 == 2, F.concat_ws(" ", v + n, c)).otherwise(F.concat_ws("\t", v, c))
    lines = ids.where(v % 97 != 0).select(F.explode(F.array_repeat(line, F.when(v % 89 == 0, 2).otherwise(1))).alias("value"))
    return text.membership_faults(text.parse_membership(lines), n)


def trace_parse(spark, sf_dir):
    """Trace lines in every spelling that the format knows, made from the events."""
    e = F.col("event_id")
    u, w = F.col("user_id").cast("string"), F.floor(F.abs("value")).cast("bigint").cast("string")
    v = (e % 200).cast("string")
    line = F.when(e % 8 == 0, F.concat(F.lit("# "), u)).when(e % 8 == 1, F.lit("   ")).when(e % 8 == 2, F.concat_ws(";", u, v, w)).when(e % 8 == 3, F.concat_ws(" ", u, v))
    line = line.when(e % 8 == 4, F.concat_ws(",", u, v, F.lit("0"))).when(e % 8 == 5, F.concat_ws(" ", F.lit("bad"), v)).when(e % 8 == 6, F.concat(F.lit("  "), u, F.lit(" , "), v, F.lit("\t9999999999"))).otherwise(F.concat_ws(" ", u, v, w))
    return text.parse_trace(tables.table(spark, sf_dir, "events").select(line.alias("value")), 150).select("src", "dst", "weight")


def degree(spark, sf_dir):
    return graph.degrees(stored(spark, sf_dir, "user_next").edges)


def total_degree(spark, sf_dir):
    found = None
    for name in ("copart", "part_supp", "cust_supp", "order_part", "user_next"):
        row = stored(spark, sf_dir, name).two_m().select(F.lit(name).alias("graph"), "two_m")
        found = row if found is None else found.unionByName(row)
    return found


def community_totals(spark, sf_dir):
    _, vertices, warm = _copart(spark, sf_dir)
    return community.totals(vertices, warm)


def community_sizes(spark, sf_dir):
    _, vertices, warm = _copart(spark, sf_dir)
    return community.sizes(vertices, warm)


def community_count(spark, sf_dir):
    return community.community_count(_copart(spark, sf_dir)[2])


def neighbor_communities(spark, sf_dir):
    g = stored(spark, sf_dir, "user_next")
    return community.neighbor_communities(g.edges, _warm(g.vertices))


def neighbor_weights(spark, sf_dir):
    g = stored(spark, sf_dir, "order_part")
    return community.neighbor_weights(g.edges, _warm(g.vertices))


def sparse_neighbor_map(spark, sf_dir):
    edges, vertices, warm = _copart(spark, sf_dir)
    delta = vertices.where("v % 10 = 0").select("v")
    return community.sparse_neighbor_map(edges, warm, vertices, graph.ranges(vertices, PARTS), delta)


def sparse_community_map(spark, sf_dir):
    """The communities that go with sparse_neighbor_map: a part's vertices' own and its external neighbours'."""
    edges, vertices, warm = _copart(spark, sf_dir)
    return community.sparse_community_map(edges, warm, vertices, graph.ranges(vertices, PARTS), vertices.where("v % 10 = 0").select("v"))


def external_edges(spark, sf_dir):
    g = stored(spark, sf_dir, "copart")
    return graph.external_edges(g.edges, graph.ranges(g.vertices, PARTS))


def range_partition(spark, sf_dir):
    return graph.ranges(stored(spark, sf_dir, "copart").vertices, PARTS)


def adjacency(spark, sf_dir):
    """Sorted neighbours of every vertex, as text, with their offsets."""
    g = stored(spark, sf_dir, "part_supp")
    return graph.csr_offsets(g.vertices).join(graph.adjacency(g.edges), "v").select("v", "start", F.array_join("neighbors", ",").alias("neighbors"))


def membership_by_id(spark, sf_dir):
    """A membership keyed by original ids, read from text: every vertex with its community, and how many communities there can be."""
    g = stored(spark, sf_dir, "part_supp")
    lines = g.vertices.select(F.concat_ws(" ", "v", F.col("v") % C0).alias("value"))
    found = text.keyed_membership(text.parse_membership(lines), graph.number(g.vertices), by_index=False)
    return found.crossJoin(F.broadcast(text.communities_named(found))).select("v", "c", "num")


def membership_csv(spark, sf_dir):
    """The CSV that a run writes, read back."""
    g = stored(spark, sf_dir, "copart")
    path = f"{shared_dir(spark)}/membership-{uuid.uuid4().hex}"
    text.write_membership(_warm(g.vertices), path)
    return spark.read.schema("v long, c long").csv(path)


def community_spans(spark, sf_dir):
    _, vertices, warm = _copart(spark, sf_dir)
    return community.spans(vertices, warm)


def reorder_vertices(spark, sf_dir):
    _, vertices, warm = _copart(spark, sf_dir)
    return community.reorder(vertices, warm)


def reorder_edges(spark, sf_dir):
    """The graph under the ids of reorder_vertices, each entry with the new communities of its ends."""
    edges, vertices, warm = _copart(spark, sf_dir)
    return community.reordered(edges, vertices, warm)[0]


def reorder_graph(spark, sf_dir):
    """Degree and community of every vertex under the new ids."""
    edges, vertices, warm = _copart(spark, sf_dir)
    return community.reordered(edges, vertices, warm)[1]


def pack_communities(spark, sf_dir):
    """Workers that hold three of the largest communities at most."""
    laid_out = community_spans(spark, sf_dir)
    most = laid_out.agg(F.max("length").alias("n"), F.max("degree_sum").alias("e")).first()
    return community.pack(laid_out, C0, 3 * most["n"], 3 * most["e"])


def delta_sample(spark, sf_dir):
    return community.sample(stored(spark, sf_dir, "copart").vertices, 10, 7)


def best_move(spark, sf_dir):
    return move.best_move(*_copart(spark, sf_dir))


def best_move_delta(spark, sf_dir):
    g = stored(spark, sf_dir, "part_supp")
    return move.best_move(g.edges, g.vertices, _warm(g.vertices), delta=g.vertices.where("v % 10 = 3"))


def best_move_directed(spark, sf_dir):
    g = stored(spark, sf_dir, "user_next")
    return move.best_move(g.edges, g.vertices, community.singletons(g.vertices))


def strict_scan_move(spark, sf_dir):
    """Candidates compared in the order of the entries, which is that of the events."""
    g = stored(spark, sf_dir, "user_next")
    return move.best_move_in_order(g.edges.select("src", "dst", F.col("event_id").alias("pos")), g.vertices, _warm(g.vertices))


def refine_move(spark, sf_dir):
    """Bipartite, and each vertex starts with the ones of its id modulo C0: many have no neighbour in their community."""
    g = stored(spark, sf_dir, "part_supp")
    return move.best_move(g.edges, g.vertices, _warm(g.vertices), refine=True)


def apply_moves(spark, sf_dir):
    edges, vertices, warm = _copart(spark, sf_dir)
    return move.apply_moves(warm, move.best_move(edges, vertices, warm))


def merged_totals(spark, sf_dir):
    edges, vertices, warm = _copart(spark, sf_dir)
    return move.merged_totals(community.totals(vertices, warm), move.best_move(edges, vertices, warm), vertices)


def move_count(spark, sf_dir):
    return best_move(spark, sf_dir).agg(F.count("*").alias("n_moves"))


def modularity_edge(spark, sf_dir):
    return quality.edge_restricted(*_copart(spark, sf_dir))


def modularity_newman(spark, sf_dir):
    return quality.newman(*_copart(spark, sf_dir))


def quality_report(spark, sf_dir):
    edges, vertices, warm = _copart(spark, sf_dir)
    return quality.report(edges, vertices, warm, move.apply_moves(warm, move.best_move(edges, vertices, warm)))


def dense_communities(spark, sf_dir):
    return community.first_appearance(_copart(spark, sf_dir)[2])


def contract_edges(spark, sf_dir):
    edges, _, warm = _copart(spark, sf_dir)
    return contract.contract_edges(edges, warm, community.first_appearance(warm))


def contract_degree(spark, sf_dir):
    return graph.degrees(contract_edges(spark, sf_dir))


def contract_weighted(spark, sf_dir):
    edges, _, warm = _copart(spark, sf_dir)
    return contract.contract_weighted(edges, warm, community.first_appearance(warm))


def flatten_membership(spark, sf_dir):
    """Vertices to their contracted vertex, and those five by five."""
    _, _, warm = _copart(spark, sf_dir)
    ids = community.first_appearance(warm)
    lineage = warm.join(ids, "c").select(F.col("v").alias("orig"), F.col("new_c").alias("cur"))
    return contract.flatten(lineage, ids.select(F.col("new_c").alias("v"), (F.col("new_c") % 5).alias("c")))


def _updates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Each event an update between its user and the next; errors delete. Vertex v belongs to v mod OWNERS, community c to c mod OWNERS."""
    g = stored(spark, sf_dir, "user_next")
    updates = g.edges.select(F.col("event_id").alias("update_idx"), F.when(F.col("event_type") == "error", incremental.DELETE).otherwise(incremental.INSERT).alias("op"), "src", "dst")
    vertices = g.vertices
    owners = vertices.select("v", (F.col("v") % OWNERS).alias("owner"))
    warm = _warm(vertices)
    return updates, warm, owners, warm.select("c", (F.col("c") % OWNERS).alias("owner")).distinct()


def affected_vertices(spark, sf_dir):
    return incremental.affected_vertices(incremental.resolve(*_updates(spark, sf_dir)))


def affected_communities(spark, sf_dir):
    return incremental.affected_communities(incremental.resolve(*_updates(spark, sf_dir)))


def candidate_communities(spark, sf_dir):
    return incremental.candidate_communities(incremental.resolve(*_updates(spark, sf_dir)))


def remote_notifications(spark, sf_dir):
    return incremental.remote_notifications(incremental.resolve(*_updates(spark, sf_dir)))


def update_routing(spark, sf_dir):
    return incremental.update_routing(incremental.resolve(*_updates(spark, sf_dir)))


def apply_updates(spark, sf_dir):
    updates = _updates(spark, sf_dir)[0]
    return incremental.apply_updates(stored(spark, sf_dir, "copart").edges, updates).groupBy("src", "dst").agg(F.count("*").alias("multiplicity"))


def local_move_rounds(spark, sf_dir):
    """Rounds of local moving from singletons until nothing moves or quality falls."""
    g = stored(spark, sf_dir, "user_next")
    return local_move(g.edges, g.vertices, community.singletons(g.vertices))[0]


def incremental_move(spark, sf_dir):
    """The updates are applied to the co-purchase graph, and the vertices that they touch are moved once more."""
    edges, vertices, warm = _copart(spark, sf_dir)
    found, _ = move_affected(edges, warm, _updates(spark, sf_dir)[0], rounds=1, sub_rounds=2, keep_best=False)
    return found


def detect_communities(spark, sf_dir):
    return detect(stored(spark, sf_dir, "copart"))


def synth_updates(spark, sf_dir):
    """Insertions at a tenth of the vertices of the users' graph."""
    n = stored(spark, sf_dir, "user_next").vertices.count()
    return synth(spark, n, 1000, epoch=1, share=1000)


def stream_affected(spark, sf_dir):
    """affected_vertices and affected_communities once more, from a file stream of the same updates: (kind, owner, id)."""
    from commweave.streaming.affected import stream_affected as start

    updates, warm, owners, community_owners = _updates(spark, sf_dir)
    source = Snapshot(updates)
    checkpoint = f"{source.path}-stream"
    stream = spark.readStream.schema(source.df.schema).parquet(source.path)
    out = f"{shared_dir(spark)}/{source.path.rsplit('/', 1)[-1]}-out"

    def sink(kind: str, rows: DataFrame, number: int) -> None:
        named = rows.toDF("owner", "id").select(F.lit(kind).alias("kind"), "owner", "id")
        named.write.mode("overwrite").parquet(f"{out}/kind_{kind}_{number}")

    start(stream, Snapshot(warm).df, Snapshot(owners).df, Snapshot(community_owners).df, sink, checkpoint).awaitTermination()
    return spark.read.schema("kind string, owner long, id long").parquet(f"{out}/kind_*").distinct()


QUERIES = {
    f.__name__: f
    for f in (
        edge_scan, dense_ids, csr_offsets, singleton_membership, membership_check, trace_parse, degree, total_degree, community_totals, community_sizes,
        community_count, neighbor_communities, neighbor_weights, sparse_neighbor_map, sparse_community_map, external_edges, range_partition, community_spans, reorder_vertices, reorder_edges, reorder_graph, adjacency, membership_by_id, membership_csv,
        pack_communities, delta_sample, best_move, best_move_delta, best_move_directed, strict_scan_move, refine_move, apply_moves, merged_totals, move_count, modularity_edge,
        modularity_newman, quality_report, dense_communities, contract_edges, contract_degree, contract_weighted, flatten_membership, affected_vertices,
        affected_communities, candidate_communities, remote_notifications, update_routing, apply_updates, local_move_rounds, incremental_move, detect_communities, synth_updates,
        stream_affected,
    )
}
