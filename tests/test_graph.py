import pytest
from pyspark.sql import functions as F

from commweave.functions.order import running_before
from commweave.operators import community, contract, graph, incremental, move, quality
from commweave.plans.detect import detect, local_move
from commweave.sources import tables


def both(pairs):
    return pairs + [(b, a) for a, b in pairs]


def k4s():
    pairs = [(4 * g + i, 4 * g + j) for g in range(3) for i in range(4) for j in range(i + 1, 4)]
    return both(pairs + [(3, 4), (7, 8), (11, 0)])


#: name: (edges, degrees in dense order, sum of degrees, quality and modularity of singletons, moves v: (to, delta))
TOYS = {
    "two_triangles": (both([(0, 1), (0, 2), (1, 2), (2, 3), (3, 4), (3, 5), (4, 5)]), [2, 2, 3, 3, 2, 2], 14, 0, -0.173469, {0: (1, 10), 1: (0, 10), 2: (0, 8), 3: (4, 8), 4: (5, 10), 5: (4, 10)}),
    "single_edge": (both([(0, 1)]), [1, 1], 2, 0, -0.5, {}),
    "star5": (both([(0, i) for i in range(1, 5)]), [4, 1, 1, 1, 1], 8, 0, -0.3125, {0: (1, 4), 1: (0, 4), 2: (0, 4), 3: (0, 4), 4: (0, 4)}),
    "gapped_ids": (both([(10, 20), (10, 30), (20, 30), (700, 800)]), [2, 2, 2, 1, 1], 8, 0, -0.21875, {0: (1, 4), 1: (0, 4), 2: (0, 4), 3: (4, 7), 4: (3, 7)}),
    "directed_sink": ([(0, 1), (1, 2), (0, 2)], [2, 1, 0], 3, 0, -0.555556, {0: (2, 3), 1: (2, 3)}),
    "multi_self": ([(0, 1)] * 2 + [(1, 0)] * 2 + [(1, 1), (1, 2), (2, 1)], [2, 4, 1], 7, -0.183673, -0.285714, {0: (1, 6), 2: (1, 3)}),
    "k4_ring": (k4s(), [4, 3, 3, 4] * 3, 42, 0, -0.085034, {4 * g + i: (4 * g + [1, 2, 1, 1][i], [30, 33, 33, 30][i]) for g in range(3) for i in range(4)}),
}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def toy(spark, name):
    edges = frame(spark, TOYS[name][0])
    edges = graph.encode(edges, graph.dense_ids(edges))
    return edges, graph.degrees(edges)


@pytest.mark.parametrize("name", TOYS)
def test_toys(spark, name):
    _, degrees, two_m, q, newman, moves = TOYS[name]
    edges, vertices = toy(spark, name)
    alone = community.singletons(vertices)
    assert [r["k"] for r in vertices.orderBy("v").collect()] == degrees
    assert vertices.agg(F.sum("k")).first()[0] == two_m
    assert quality.edge_restricted(edges, vertices, alone).first()["q"] == pytest.approx(q, abs=1e-6)
    assert quality.newman(edges, vertices, alone).first()["q"] == pytest.approx(newman, abs=1e-6)
    got = {r["v"]: (r["new_c"], r["delta"]) for r in move.best_move(edges, vertices, alone).collect()}
    assert got == moves
    ordered = edges.withColumn("pos", F.monotonically_increasing_id())
    in_order = {r["v"]: r["new_c"] for r in move.best_move_in_order(ordered, vertices, alone).collect()}
    assert in_order.keys() == got.keys()


def test_planted_memberships(spark):
    edges, vertices = toy(spark, "two_triangles")
    planted = vertices.select("v", F.floor(F.col("v") / 3).alias("c"))
    r = quality.edge_restricted(edges, vertices, planted).first()
    assert (r["intra"], r["s"], round(r["q"], 6)) == (12, 64, 0.530612)
    assert quality.newman(edges, vertices, planted).first()["q"] == pytest.approx(0.357143, abs=1e-6)
    one = vertices.select("v", F.lit(0).cast("long").alias("c"))
    assert quality.edge_restricted(edges, vertices, one).first()["q"] == pytest.approx(0.581633, abs=1e-6)
    assert quality.newman(edges, vertices, one).first()["q"] == pytest.approx(0, abs=1e-12)
    edges, vertices = toy(spark, "k4_ring")
    planted = vertices.select("v", F.floor(F.col("v") / 4).alias("c"))
    small = contract.contract_edges(edges, planted, community.first_appearance(planted))
    assert {(r["src"], r["dst"]) for r in small.collect()} == {(a, b) for a in range(3) for b in range(3) if a != b}
    weighted = contract.contract_weighted(edges, planted, community.first_appearance(planted))
    assert {(r["src"], r["dst"]): r["w"] for r in weighted.collect()} == {(a, b): 12 if a == b else 1 for a in range(3) for b in range(3)}


def test_moves_keep_totals(spark):
    edges = tables.planted(spark, 6, 8, 0.7, 0.05)
    vertices = graph.degrees(edges)
    warm = vertices.select("v", (F.col("v") % 7).alias("c"))
    moves, before = move.best_move(edges, vertices, warm), community.totals(vertices, warm)
    after = {r["c"]: r["t"] for r in community.totals(vertices, move.apply_moves(warm, moves)).collect()}
    for r in move.merged_totals(before, moves, vertices).collect():
        assert after.get(r["c"], 0) == r["t"]
    assert sum(after.values()) == edges.count()


def test_quality_of_nothing(spark):
    edges = frame(spark, [])
    vertices = graph.degrees(edges)
    assert quality.edge_restricted(edges, vertices, community.singletons(vertices)).first()["q"] == 0
    assert quality.newman(edges, vertices, community.singletons(vertices)).first()["q"] == 0


def test_detect_recovers_planted_communities(spark):
    g = graph.Graph.from_edges(tables.planted(spark, 5, 8, 0.9, 0.02))
    metrics = []
    found = detect(g, rounds=3, levels=2, sub_rounds=4, metrics=metrics)
    q = quality.newman(g.edges, g.vertices, found).first()["q"]
    planted = quality.newman(g.edges, g.vertices, g.vertices.select("v", F.floor(F.col("v") / 8).alias("c"))).first()["q"]
    assert q > 0.9 * planted and metrics[0]["moves"] > 0
    assert found.count() == g.vertices.count() and found.select("v").distinct().count() == found.count()


def test_sub_rounds_are_independent_of_partitioning(spark):
    edges = tables.planted(spark, 3, 6, 0.8, 0.1)
    vertices, results = graph.degrees(edges), []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found, counts = local_move(edges.repartition(int(n)), vertices, community.singletons(vertices), rounds=1, sub_rounds=3)
        results.append((sorted(map(tuple, found.collect())), counts))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_only_delta_vertices_move(spark):
    edges = tables.planted(spark, 3, 6, 0.8, 0.1)
    vertices = graph.degrees(edges)
    delta = community.sample(vertices, 30, seed=3)
    assert delta.count() == max(1, vertices.count() * 3000 // 10000)
    assert community.sample(vertices, 0).count() == vertices.count() and community.sample(vertices, 0.01).count() == 1
    moved = {r["v"] for r in move.best_move(edges, vertices, community.singletons(vertices), delta=delta).collect()}
    assert moved <= {r["v"] for r in delta.collect()}


def test_running_totals_and_spans(spark):
    df = spark.createDataFrame([(i * 7 % 50, i) for i in range(50)], "a long, b long")
    got = running_before(df, [F.col("a").desc()], F.col("b")).orderBy(F.desc("a")).collect()
    total = 0
    for r in got:
        assert r["before"] == total
        total += r["b"]
    vertices = spark.createDataFrame([(v, v % 3) for v in range(10)], "v long, k long")
    warm = vertices.select("v", (F.col("v") % 4).alias("c"))
    rows = community.spans(vertices, warm).orderBy("rank").collect()
    assert [r["start"] for r in rows] == [0, 3, 6, 8] and [r["length"] for r in rows] == [3, 3, 2, 2]
    order = community.reorder(vertices, warm).collect()
    assert sorted(r["new_v"] for r in order) == list(range(10))
    with pytest.raises(Exception, match="no worker"):
        community.pack(community.spans(vertices, warm), 1, 4, 100).collect()


def test_updates(spark):
    membership = spark.createDataFrame([(0, 0), (1, 0), (2, 1), (3, 1)], "v long, c long")
    owners = spark.createDataFrame([(0, 0), (1, 1), (2, 0), (3, 1)], "v long, owner long")
    community_owners = spark.createDataFrame([(0, 0), (1, 1)], "c long, owner long")
    rows = [(0, "INSERT", 0, 1), (1, "INSERT", 0, 3), (2, "DELETE", 1, 2), (3, "INSERT", 0, 2), (4, "INSERT", 0, 99)]
    updates = spark.createDataFrame(rows, "update_idx long, op string, src long, dst long")
    r = incremental.resolve(updates, membership, owners, community_owners)
    get = lambda df: sorted(map(tuple, df.collect()))
    assert get(incremental.affected_vertices(r)) == [(0, 0), (0, 2), (1, 1), (1, 3)]
    assert get(incremental.affected_communities(r)) == [(0, 0), (1, 1)]
    assert get(incremental.candidate_communities(r)) == [(0, 1, 2)]
    assert get(incremental.remote_notifications(r)) == [(0, 1, 1, 1)]
    assert get(incremental.update_routing(r)) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (1, 2)]
    assert get(incremental.apply_updates(frame(spark, [(1, 2), (1, 2), (5, 6)]), updates)) == [(0, 1), (0, 2), (0, 3), (0, 99), (5, 6)]


@pytest.mark.parametrize("weighted", [True, False])
def test_one_task_gives_what_joins_give(spark, weighted):
    import random

    r = random.Random(5)
    pairs = [(r.randrange(30) * 7, r.randrange(30) * 7) for _ in range(120)]
    edges = frame(spark, both(pairs) + [(7, 7), (0, 14), (0, 14), (1000, 0)])
    if weighted:
        edges = edges.groupBy("src", "dst").agg(F.sum("src").alias("w")).select("src", "dst", (F.col("w") % 5 + 1).alias("w"))
        vertices = edges.select(F.col("src").alias("v"), F.col("w").alias("k")).unionByName(edges.select(F.col("dst").alias("v"), F.lit(0).cast("long").alias("k"))).groupBy("v").agg(F.sum("k").alias("k"))
    else:
        vertices = graph.degrees(edges)
    start = vertices.select("v", (F.col("v") % 5).alias("c"))
    delta = vertices.where("v % 3 = 0").select("v")
    for more in ({"rounds": 3}, {"rounds": 2, "delta": delta, "sub_rounds": 2, "keep_best": False}, {"rounds": 1, "refine": True}):
        one, joins = (local_move(edges, vertices, start, one_task=n, **more) for n in (10_000, -1))
        assert one[1] == joins[1] and sum(one[1]) > 0
        assert sorted(map(tuple, one[0].collect())) == sorted(map(tuple, joins[0].collect()))
