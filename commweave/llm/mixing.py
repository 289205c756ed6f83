"""Mixing overlapping sources to target weights.

Sources overlap where they hold equal texts. Documents are aggregated by membership pattern, the set of sources that
hold their text. A min-cost flow routes the words of each pattern, through the rows that a source has of it, to the
sources' quotas; every further use of a pattern's texts, from whichever source, costs more than the one before. So a
source takes what only it has before what others need too. Seeded documents then realise the flow: each row of a
pattern and source is taken ``copies`` times, and a seeded subset once more.
"""

from __future__ import annotations

import json
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commweave.llm.common import cut

#: Seeded fine buckets of each pattern and source; the bucket in which their last words fall holds about 1/FINE of their
#: documents at least, and LEAST documents where there are fewer.
FINE, LEAST = 4096, 2000
MAX_REPEAT = 3
#: Plan rows up to which the plan is sent to all tasks; beyond, it is joined by shuffle.
BROADCAST_PLAN = 100_000
#: Patterns of several sources that the flow tells apart, those with the most words; texts of the others count for their own source only.
PATTERNS = 20_000
#: Cost of a word's first, second, third and any further use: convex, so no text is used again while another can serve.
PASS_COSTS = (0, 1, 3, 6)


def source_targets(sizes: dict[str | None, int], weights: tuple[int, ...] = (1, 2, 3), most: int = MAX_REPEAT) -> dict[str | None, float]:
    """Shares of the total by weight; a share stops at ``most`` times its source and the excess goes to the others by weight."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, target = float(sum(sizes.values())), list(order), {}
    while free:
        unit = left / sum(weight[s] for s in free)
        full = [s for s in free if unit * weight[s] > most * sizes[s]]
        if not full:
            target |= {s: unit * weight[s] for s in free}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free = [s for s in free if s not in target]
    return target


class _Network:
    """Maximum flow by levels (Dinic); arcs can be added between runs."""

    def __init__(self, nodes: int):
        self.heads: list[int] = []
        self.room: list[int] = []
        self.out: list[list[int]] = [[] for _ in range(nodes)]

    def arc(self, a: int, b: int, capacity: int) -> int:
        for x, y, c in ((a, b, capacity), (b, a, 0)):
            self.out[x].append(len(self.heads))
            self.heads.append(y)
            self.room.append(c)
        return len(self.heads) - 2

    def fill(self, start: int, end: int) -> None:
        heads, room, out = self.heads, self.room, self.out
        while True:
            level = [-1] * len(out)
            level[start], queue = 0, deque([start])
            while queue:
                a = queue.popleft()
                for e in out[a]:
                    if room[e] and level[heads[e]] < 0:
                        level[heads[e]] = level[a] + 1
                        queue.append(heads[e])
            if level[end] < 0:
                return
            at, path, a = [0] * len(out), [], start
            while True:
                if a == end:
                    pushed = min(room[e] for e in path)
                    for i, e in enumerate(path):
                        room[e] -= pushed
                        room[e ^ 1] += pushed
                    keep = next(i for i, e in enumerate(path) if not room[e])
                    a = heads[path[keep] ^ 1]
                    del path[keep:]
                while at[a] < len(out[a]) and not (room[out[a][at[a]]] and level[heads[out[a][at[a]]]] == level[a] + 1):
                    at[a] += 1
                if at[a] < len(out[a]):
                    path.append(out[a][at[a]])
                    a = heads[path[-1]]
                elif path:
                    e = path.pop()
                    a = heads[e ^ 1]
                    at[a] += 1
                else:
                    break


def route(words: dict[object, int], rooms: dict[tuple[object, object], int], quotas: dict, costs: tuple[int, ...] = PASS_COSTS) -> dict[tuple[object, object], int]:
    """Words that each (pattern, source) carries in a min-cost maximum flow.

    words: of a pattern's distinct texts; a pass over them is an arc of its cost, the last pass has no end. rooms: what
    (pattern, source) may carry. Only passes cost anything, and all leave from one node, so maximum flows with the
    passes of one cost after the other give the least cost: what a flow takes from a cheaper pass never gets less. The
    graph has a node for each pattern and source; its size doesn't depend on the number of documents.
    """
    order = sorted(words, key=str)
    sources = sorted(quotas, key=lambda s: (s is None, str(s)))
    at = {p: 2 + i for i, p in enumerate(order)}
    of = {s: 2 + len(order) + i for i, s in enumerate(sources)}
    net = _Network(2 + len(order) + len(sources))
    carried = {k: net.arc(at[k[0]], of[k[1]], rooms[k]) for k in sorted(rooms, key=str)}
    for s in sources:
        net.arc(of[s], 1, max(0, round(quotas[s])))
    total = sum(rooms.values())
    for i, _ in sorted(enumerate(costs), key=lambda x: x[1]):
        for p in order:
            net.arc(0, at[p], words[p] if i + 1 < len(costs) else total)
        net.fill(0, 1)
    return {k: net.room[e ^ 1] for k, e in carried.items()}


def mix(docs: DataFrame, doc_id: Column, source: Column, size: Column, alike: Column | None = None, quotas=None, seed: int = 42, patterns: int = PATTERNS) -> DataFrame:
    """``docs`` plus ``_repeats`` (0 to MAX_REPEAT, how often the mix takes the document).

    source: null is a source like any other. size: null counts as 0. alike: equal for documents with equal texts; by
    default, and where it is null, a document is like no other. quotas: source to words, or by default
    ``source_targets`` of the sources' sizes. A document of size 0 is taken as often as its pattern's rows in full. Rows
    equal in id, size and ``alike`` are told apart by nothing: in the one bucket where a pattern's words end, any of them
    may be the one that is taken. A column named ``_repeats`` is replaced; an empty table stays empty.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != "_repeats"]
    held = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)]
    keyed = docs.select(*held, doc_id.alias("_id"), source.cast("string").alias("_source"), F.coalesce(size, F.lit(0)).cast("long").alias("_size"), (F.lit(None).cast("string") if alike is None else alike.cast("string")).alias("_alike"))
    keyed = keyed.withColumn("_fine", F.pmod(F.xxhash64("_id", "_alike", F.lit(seed)), F.lit(FINE)).cast("int"))
    none = F.to_json(F.array("_source"))
    shared = keyed.where("_alike is not null").groupBy("_alike").agg(F.array_sort(F.collect_set(F.coalesce(F.to_json(F.struct("_source")), F.lit("{}")))).alias("_set"), F.max("_size").alias("_text"))
    # A group has an element for each source; a struct's JSON leaves out null.
    shared = cut(shared.where(F.size("_set") > 1).select("_alike", F.to_json(F.transform("_set", lambda x: F.get_json_object(x, "$._source"))).alias("_pattern"), "_text"))
    kept = shared.groupBy("_pattern").agg(F.sum("_text").alias("words")).orderBy(F.desc("words"), "_pattern").limit(patterns)
    kept = {r["_pattern"]: r["words"] for r in kept.collect()}  # ``patterns`` rows at most
    of = spark.createDataFrame([(k,) for k in kept], "_pattern string")
    several = shared.join(F.broadcast(of), "_pattern", "left_semi").select("_alike", "_pattern")
    keyed = keyed.join(several, "_alike", "left").withColumn("_cell", F.to_json(F.array(F.coalesce("_pattern", none), F.col("_source")))).withColumn("_pattern", F.coalesce("_pattern", none))
    buckets = cut(keyed.groupBy("_cell", "_pattern", "_source", "_fine").agg(F.count("*").alias("n"), F.sum("_size").alias("words")))
    cells = buckets.groupBy("_cell", "_pattern", "_source").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).collect()  # patterns * their sources, and sources
    sizes: dict = {}
    for r in cells:
        sizes[r["_source"]] = sizes.get(r["_source"], 0) + r["words"]
    if quotas is None:
        quotas = source_targets(sizes)
    words = {r["_pattern"]: kept.get(r["_pattern"], r["words"]) for r in cells}
    flow = route(words, {(r["_pattern"], r["_source"]): MAX_REPEAT * r["words"] for r in cells if r["_source"] in quotas}, quotas)
    plan = []
    for r in cells:
        copies, rest = divmod(flow.get((r["_pattern"], r["_source"]), 0), r["words"]) if r["words"] else (int(r["_source"] in quotas), 0)
        plan.append((r["_cell"], int(copies), int(rest), min(FINE, max(1, -(-r["n"] // LEAST)))))
    small = len(plan) <= BROADCAST_PLAN
    plan = spark.createDataFrame(plan, "_cell string, _copies int, _rest long, _coarse int")
    coarse = F.floor(F.col("_fine") * F.col("_coarse") / F.lit(FINE)).cast("int")
    in_order = Window.partitionBy("_cell").orderBy("_bucket")
    # A cell has FINE rows here at most.
    ends = (
        buckets.join(plan.where("_rest > 0"), "_cell")
        .groupBy("_cell", coarse.alias("_bucket"))
        .agg(F.sum("words").alias("words"), F.first("_rest").alias("_rest"))
        .withColumn("before", F.sum("words").over(in_order) - F.col("words"))
        .where((F.col("before") <= F.col("_rest")) & (F.col("_rest") < F.col("before") + F.col("words")))
        .groupBy("_cell")
        .agg(F.min("_bucket").alias("_end"), F.max(F.col("_rest") - F.col("before")).alias("_left"))
    )
    plan = cut(plan.join(ends, "_cell", "left"))
    placed = keyed.join(F.broadcast(plan) if small else plan, "_cell").withColumn("_bucket", coarse)
    clear = placed.where(F.coalesce(F.col("_bucket") != F.col("_end"), F.lit(True))).withColumn("_repeats", F.col("_copies") + F.when(F.col("_bucket") < F.col("_end"), 1).otherwise(0))
    ending = placed.where(F.col("_bucket") == F.col("_end")).withColumns({"_order": F.xxhash64(F.lit(seed + 1), "_id", "_alike"), "_repeats": F.col("_copies")})
    # Only ids' hashes and sizes go to Python; rows alike in these are numbered, and the first ones are taken.
    by = ["_cell", "_order", "_size"]
    counted = ending.groupBy(*by).agg(F.count("*").alias("n"), F.first("_left").alias("_left"))
    taken = counted.groupBy("_cell").applyInArrow(_fill, "_cell string, _order long, _size long, _taken long")
    numbered = ending.withColumn("_nth", F.row_number().over(Window.partitionBy(*by).orderBy(F.lit(0)))).join(taken, by, "left")
    chosen = numbered.withColumn("_repeats", F.col("_copies") + F.coalesce(F.col("_nth") <= F.col("_taken"), F.lit(False)).cast("int"))
    back = [*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)], "_repeats"]
    return clear.select(*back).unionByName(chosen.select(*back))


def _fill(docs: pa.Table) -> pa.Table:
    """In seeded order, once more every document that still fits; what stays open is less than any document left out.

    n documents are alike in _order and _size; _taken of them fit. Those of which none fits are left out.
    """
    order, sizes, n = (docs.column(x).to_numpy() for x in ("_order", "_size", "n"))
    at, left, taken = np.lexsort((sizes, order)), docs.column("_left")[0].as_py(), np.zeros(len(n), np.int64)
    for i in at.tolist():
        if 0 < sizes[i] <= left:
            taken[i] = min(n[i], left // sizes[i])
            left -= int(taken[i] * sizes[i])
    return docs.select(["_cell", "_order", "_size"]).append_column("_taken", pa.array(taken)).filter(pa.array(taken > 0))
