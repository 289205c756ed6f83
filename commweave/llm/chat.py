"""Chat formatting with minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant in turns, ending with either. Dynamic
programming over that automaton repairs the roles at the least cost: a turn may be merged with the one before, take
another role, or follow inserted empty turns. The repaired turns are rendered with role marks.

Costs of a block of turns are a matrix over the automaton's states, and blocks combine by (min, +) products, so a
conversation of any length is repaired in blocks of so many turns, by many tasks, with the same result. A turn's place
in its conversation is counted over ranges of all turns, so no task gathers a conversation to number it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commweave.functions.order import running_before
from commweave.llm.common import cut

ROLES = ("system", "user", "assistant")
#: Other names of the roles; anything else is of no role and must be relabelled.
ALIASES = {"human": 2, "prompter": 2, "gpt": 3, "bot": 3, "model": 3, "ai": 3} | {r: i + 1 for i, r in enumerate(ROLES)}
#: State 0 is the start, others are the role of the last turn.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
ACCEPTING = (2, 3)
MERGE, INSERT, RELABEL = 1, 2, 3
NEVER = 1 << 40
#: Turns of a block; a conversation of up to so many turns is one row.
BLOCK = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


@lru_cache(maxsize=None)
def inserted(a: int, b: int) -> tuple[int, ...] | None:
    """Shortest series of empty turns that leads from state a to state b; None if there is none."""
    for n in range(4):
        for roles in product((1, 2, 3), repeat=n):
            s, fine = a, True
            for r in roles:
                fine, s = fine and r in LEGAL[s], r
            if fine and s == b:
                return roles
    return None


@lru_cache(maxsize=None)
def step(role: int, a: int, b: int) -> tuple[int, tuple[int, ...], bool]:
    """Least cost of a turn (0: of no role) from state a to b, with its inserted turns and whether it is merged. Equal costs: the fewest insertions, then no merge."""
    relabel = 0 if role == b else RELABEL
    found = [(relabel + MERGE, 0, (), True)] if a == b else []
    for t in range(4):
        if b in LEGAL[t] and (way := inserted(a, t)) is not None:
            found.append((relabel + INSERT * len(way), len(way), way, False))
    if b == 0 or not found:
        return NEVER, (), False
    cost, _, way, merged = min(found, key=lambda x: (x[0], x[1], x[3]))
    return cost, way, merged


@lru_cache(maxsize=None)
def closing(a: int) -> tuple[int, tuple[int, ...]]:
    """Least cost of ending in state a, with the inserted turns."""
    ways = [w for b in ACCEPTING if (w := inserted(a, b)) is not None]
    best = min(ways, key=lambda w: (len(w), w))
    return INSERT * len(best), best


def costs(roles: list[int]) -> list[list[int]]:
    """Matrix of least costs from each state before to each state after the turns."""
    out = []
    for a in range(4):
        now = [0 if s == a else NEVER for s in range(4)]
        for r in roles:
            now = [min(now[s] + step(r, s, t)[0] for s in range(4)) for t in range(4)]
        out.append([min(x, NEVER) for x in now])
    return out


def path(roles: list[int], a: int, b: int) -> list[int]:
    """States after each turn on a least-cost way from a to b; of equal ones, the smallest state at every turn from the last back."""
    layers = [[0 if s == a else NEVER for s in range(4)]]
    for r in roles:
        layers.append([min(layers[-1][s] + step(r, s, t)[0] for s in range(4)) for t in range(4)])
    states, t = [], b
    for i in range(len(roles) - 1, -1, -1):
        states.append(t)
        t = min(range(4), key=lambda s: (layers[i][s] + step(roles[i], s, t)[0], s))
    return states[::-1]


def route(matrices: list[list[list[int]]]) -> tuple[list[int], int]:
    """States before the first and after each block of a whole conversation, and its cost."""
    layers = [[0, NEVER, NEVER, NEVER]]
    for m in matrices:
        layers.append([min(layers[-1][s] + m[s][t] for s in range(4)) for t in range(4)])
    t = min(range(4), key=lambda s: (layers[-1][s] + closing(s)[0], s))
    cost, states = layers[-1][t] + closing(t)[0], [t]
    for i in range(len(matrices) - 1, -1, -1):
        t = min(range(4), key=lambda s: (layers[i][s] + matrices[i][s][t], s))
        states.append(t)
    return states[::-1], cost


def code(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), 0)


def render(turns: list[tuple[int, str | None]], a: int, b: int, first: bool, last: bool) -> tuple[str, str, int]:
    """Text, operations and number of started messages of a block. Blocks' texts, joined, are the conversation's.

    A message is closed where the next begins, so that a later block can still add to it.
    """
    roles, text, ops, started, s = [r for r, _ in turns], [], [], 0, a

    def message(role: int, body: str) -> None:
        nonlocal started
        text.append(("" if first and not started else CLOSE) + f"{OPEN}{ROLES[role - 1]}\n{body}")
        started += 1

    for (r, body), t in zip(turns, path(roles, a, b)):
        _, way, merged = step(r, s, t)
        for x in way:
            message(x, "")
            ops.append(f"insert:{ROLES[x - 1]}")
        body = (body or "").replace("<|", "<\\|")
        if merged:
            text.append("\n" + body)
        else:
            message(t, body)
        ops.append(("merge" if merged else "keep") if r == t else f"{'merge' if merged else 'relabel'}:{ROLES[t - 1]}")
        s = t
    if last:
        for x in closing(s)[1]:
            message(x, "")
            ops.append(f"insert:{ROLES[x - 1]}")
        text.append(CLOSE)
    return "".join(text), ",".join(ops), started


def _groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of sorted batches; a null key is a group like any other."""
    kept: list[pd.DataFrame] = []
    last = None
    for b in batches:
        if not len(b):
            continue
        b = b.reset_index(drop=True)
        marks = list(zip(*(b[k].astype(object).where(b[k].notna(), None) for k in keys)))
        starts = [i for i in range(1, len(marks)) if marks[i] != marks[i - 1]]
        if kept and marks[0] != last:
            yield pd.concat(kept, ignore_index=True)
            kept = []
        for x, y in zip([0, *starts], [*starts, len(b)]):
            if x and kept:
                yield pd.concat(kept, ignore_index=True) if len(kept) > 1 else kept[0]
                kept = []
            kept.append(b.iloc[x:y])
        last = marks[-1]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def repair(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(conv_id, segment, n_turns, n_messages, cost, ops, rendered): one row for each conversation of up to ``block`` turns.

    Longer ones have a row for each ``block`` turns, in the order of segment, whose renderings, joined, are the
    conversation's. Turns go by number, then role and a hash of the text; null numbers come last. Null and unknown roles are of no
    role, null texts are empty, repeated turns are turns of their own, null ids are one conversation. cost is the whole
    conversation's. Marks within texts are escaped. Very long texts are kept whole. An empty table gives an empty one.
    """
    kind = turns.schema[conv].dataType.simpleString()
    given = turns.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.left("role", F.lit(32)).asc_nulls_first(), F.xxhash64("role", "text")]
    placed = running_before(given, order, name="place")
    firsts = placed.groupBy(F.col("conv_id").alias("_c")).agg(F.min("place").alias("first"))
    given = placed.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c"))).withColumn("block", F.floor((F.col("place") - F.col("first")) / block)).drop("_c", "first")
    by_block = given.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(batches, ["conv_id", "block"]):
            matrix = costs([code(r) for r in g["role"]])
            out.append((g["conv_id"].iloc[0], g["block"].iloc[0], [x for row in matrix for x in row]))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=["conv_id", "block", "m"])
                out = []
        yield pd.DataFrame(out, columns=["conv_id", "block", "m"])

    blocks = by_block.select("conv_id", "block", "role").mapInPandas(weigh, f"conv_id {kind}, block long, m array<long>")

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for g in _groups(batches, ["conv_id"]):
            matrices = [[list(m[4 * a : 4 * a + 4]) for a in range(4)] for m in g["m"]]
            states, cost = route(matrices)
            for i, b in enumerate(g["block"]):
                out.append((g["conv_id"].iloc[0], b, i, states[i], states[i + 1], i + 1 == len(matrices), cost))
            if len(out) >= 5000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    names = ["conv_id", "block", "segment", "a", "b", "last", "cost"]
    ways = cut(blocks.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInPandas(settle, f"conv_id {kind}, block long, segment int, a int, b int, last boolean, cost long"))
    ways = ways.withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    known = given.join(ways, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b")
    known = known.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "place")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns, out = ["conv_id", "segment", "n_turns", "n_messages", "cost", "ops", "rendered"], []
        for g in _groups(batches, ["conv_id", "block"]):
            x = g.iloc[0]
            turns_ = [(code(r), t) for r, t in zip(g["role"], g["text"])]
            rendered, ops, started = render(turns_, int(x["a"]), int(x["b"]), x["segment"] == 0, bool(x["last"]))
            out.append((x["conv_id"], x["segment"], len(g), started, x["cost"], ops, rendered))
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    return known.mapInPandas(write, f"conv_id {kind}, segment int, n_turns long, n_messages long, cost long, ops string, rendered string")
