"""Sharding by balanced label propagation, with built-in functions only.

Documents with equal texts are linked. Starting from hashed shards, linked documents move towards the shard that holds
most of their group while that shard's quota lasts, full shards exchanging what they hold; rows of one group and shard
are moved together as one counted row, so a step touches groups, not documents. It goes on until nothing moves. Shard
sizes are then made exact: what a full shard holds beyond its quota, documents without links first, fills the others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commweave.llm.common import Cut, cut

#: Shards, and steps after which propagation that still moves something is an error.
SHARDS, STEPS = 24, 1000
#: Buckets in which the rows of a shard are numbered: groups, then parts of large groups, then documents without links.
GROUP_BUCKETS, PART_BUCKETS, SINGLE_BUCKETS = 32, 32, 1024


def _pick(values: list[int], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), at + 1).cast("long")


def _granted(asked: dict[tuple[int, int, int], int], load: dict[int, int], room: list[int]) -> dict[tuple[int, int, int], float]:
    """Shares of what is asked for, (from, to, level) to rows: exchanges between two shards, then what there is room for, largest levels first.

    What leaves a shard makes room in it.
    """
    left = dict(asked)
    free = [room[t] - load.get(t, 0) for t in range(len(room))]

    def grant(f: int, t: int, most: int) -> int:
        done = 0
        for level in range(63, -1, -1):
            n = min(left.get((f, t, level), 0), most - done)
            if n > 0:
                left[f, t, level] -= n
                done += n
        return done

    pairs = {(f, t) for f, t, _ in asked}
    for f, t in sorted(pairs):
        if f < t and (t, f) in pairs:
            both = min(sum(n for (a, b, _), n in left.items() if (a, b) == x) for x in ((f, t), (t, f)))
            grant(f, t, both)
            grant(t, f, both)
    moved = True
    while moved:
        moved = False
        for f, t, level in sorted(left, key=lambda x: (-x[2], x)):
            n = min(left[f, t, level], max(free[t], 0))
            if n > 0:
                left[f, t, level] -= n
                free[t], free[f], moved = free[t] - n, free[f] + n, True
    return {k: (n - left[k]) / n for k, n in asked.items()}


def propagate(members: DataFrame, room: list[int], steps: int = STEPS) -> DataFrame:
    """(group, home, n) with 0-based home shards to (group, home, shard): the shard to which each part of a group goes.

    room[t]: rows of groups that shard t may hold. The parts of a group that isn't whole want the shard with most of
    it among those with room (ties: by a hash), or as many such shards as a larger group fills. What two shards want of
    each other is exchanged; beyond that the largest groups go first while there is room. Of those that are taken only
    in part, a hashed share goes, another one in each step. It ends when no move is granted.
    """
    now = Cut(members.withColumn("shard", F.col("home")))
    for number in range(steps):
        state = now.df
        load = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        held = state.groupBy("group", "shard").agg(F.sum("n").alias("here"))
        open_ = F.element_at(F.array(*[F.lit(room[t] > load.get(t, 0)) for t in range(len(room))]), F.col("shard") + 1)
        rank = F.struct(open_.alias("open"), "here", F.pmod(F.xxhash64("group", "shard"), F.lit(1 << 31)).alias("tie"), "shard")
        wanted = held.groupBy("group").agg(F.sort_array(F.collect_list(rank), asc=False).alias("best"), F.sum("here").alias("all")).where(F.size("best") > 1)  # a group has a row for each shard
        wanted = wanted.withColumn("best", F.slice(F.transform("best", lambda b: b["shard"]), 1, F.ceil(F.col("all") / max(*room, 1)).cast("int")))
        one = F.element_at("best", F.pmod(F.xxhash64("group", "home"), F.size("best")).cast("int") + 1)
        to = F.when(F.array_contains("best", F.col("shard")), F.col("shard")).otherwise(one)
        moves = Cut(state.join(wanted, "group", "left").withColumn("to", to).withColumn("level", F.floor(F.log2(F.col("all") + 1)).cast("int")))
        asked = moves.df.where(F.col("shard") != F.col("to")).groupBy("shard", "to", "level").agg(F.sum("n").alias("n")).collect()  # shards**2 * 63 rows at most
        share = _granted({(r["shard"], r["to"], r["level"]): r["n"] for r in asked}, load, room)
        if not any(share.values()):
            moves.drop()
            break
        granted = F.create_map(*[x for (f, t, level), part in sorted(share.items()) for x in (F.lit((f * len(room) + t) * 64 + level), F.lit(float(part)))])
        going = F.coalesce(granted[(F.col("shard") * len(room) + F.col("to")) * 64 + F.col("level")], F.lit(0.0))
        # A group that fits moves as a whole, a larger one part by part.
        part_of = F.when(F.col("all") > max(room), F.col("home")).otherwise(-1)
        drawn = F.pmod(F.xxhash64("group", part_of, F.lit(number)), F.lit(1 << 20)) / F.lit(float(1 << 20))
        then, now = now, Cut(moves.df.withColumn("shard", F.when(drawn < going, F.col("to")).otherwise(F.col("shard"))).select("group", "home", "n", "shard"))
        then.drop()
        moves.drop()
    else:
        raise RuntimeError(f"groups still move after {steps} steps")
    return now.df.select("group", "home", "shard")


def shard(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) of every row; group: SHA-256 of the text; shards' counts differ by one at most, slots count from 0.

    size: UTF-8 bytes and 8. Null texts have no bytes and no links; null and repeated ids are rows like any other.
    A group larger than a shard is spread over few shards; an empty table gives an empty one.
    """
    body = F.col(text).cast("binary")
    slim = cut(docs.select(F.col(doc_id).alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.coalesce(F.crc32(body), F.lit(0)).cast("long").alias("text_crc32"), F.sha2(body, 256).alias("group")).withColumn("home", F.pmod(F.xxhash64("doc_id", "size"), F.lit(shards)).cast("int")))
    total = slim.count()
    parts = slim.where(F.col("group").isNotNull()).groupBy("group", "home").agg(F.count("*").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("all")).where("all > 1").select("group")
    settled = propagate(parts.join(groups, "group"), [total // shards] * shards)
    placed = slim.join(settled, ["group", "home"], "left")
    linked = F.col("shard").isNotNull()
    of_group = F.pmod(F.xxhash64("group"), F.lit(GROUP_BUCKETS)) * PART_BUCKETS + F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(PART_BUCKETS))
    single = GROUP_BUCKETS * PART_BUCKETS + F.pmod(F.xxhash64("doc_id", "group"), F.lit(SINGLE_BUCKETS))
    placed = cut(placed.withColumn("bucket", F.when(linked, of_group).otherwise(single).cast("int")).withColumn("shard", F.coalesce("shard", "home")))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("bucket")) - F.col("n")).drop("n")  # 2,048 rows a shard
    load = [0] * shards
    for r in counts.groupBy("shard").agg(F.sum("n").alias("n")).collect():
        load[r["shard"]] = r["n"]
    quota = [total // shards] * shards
    for s in sorted(range(shards), key=lambda s: (-load[s], s))[: total % shards]:
        quota[s] += 1
    over, gaps = [0], [0]
    for s in range(shards):
        over.append(over[-1] + max(0, load[s] - quota[s]))
        gaps.append(gaps[-1] + max(0, quota[s] - load[s]))
    numbered = placed.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("group", "doc_id")) - 1)
    ranked = numbered.join(before, ["shard", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))
    spare = F.col("rank") - _pick(quota, F.col("shard"))
    queue = _pick(over, F.col("shard")) + spare
    target = sum((F.when(queue >= g, 1).otherwise(0) for g in gaps[1:]), F.lit(0))
    there = F.when(spare >= 0, F.least(target, F.lit(shards - 1))).otherwise(F.col("shard"))
    filled = _pick([min(n, q) for n, q in zip(load, quota)], F.col("there")) + queue - _pick(gaps, F.col("there"))
    return ranked.withColumn("there", there.cast("int")).select("doc_id", "size", "text_crc32", "group", F.col("there").alias("shard"), F.when(spare >= 0, filled).otherwise(F.col("rank")).cast("long").alias("slot"))


def place(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """``docs`` plus shard and slot; columns of these names are replaced.

    Rows of one id and text share their slots out among themselves; only such repeats meet in one task.
    """
    docs = docs.drop("shard", "slot")
    key = lambda i, g: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("-")), F.coalesce(g, F.lit("-")))
    slots = shard(docs, doc_id, text, shards).groupBy(key(F.col("doc_id"), F.col("group")).alias("_key")).agg(F.collect_list(F.struct("shard", "slot")).alias("_slots"))
    joined = docs.select(F.struct(*docs.columns).alias("_doc"), key(F.col(doc_id), F.sha2(F.col(text).cast("binary"), 256)).alias("_key")).join(slots, "_key")
    one = F.element_at("_slots", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    return joined.select("_doc", one.alias("_slot")).select("_doc.*", "_slot.shard", "_slot.slot")
