"""SimHash near-duplicates by the generalised pigeonhole principle.

With partition thresholds t_1..t_m and sum(t_i + 1) = radius + 1, two fingerprints within the radius lie within t_i in
some partition i. Correlated bits share a partition, and dynamic programming over estimated candidate counts gives the
partitions unequal thresholds (-1: not probed). Fingerprints are probed under all signatures within their partition's
threshold; candidates are verified by their whole Hamming distance. A bucket yields a spanning forest of its links, so
a group of any size yields fewer edges than it has members, and no link between different components is lost.

The more fingerprints there are, the fewer and wider partitions pay: their number is what costs least by the estimate.
A large bucket is cut up by the pigeonhole principle once more, over the bits outside its partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from commweave.llm.common import cut, shingle_digests, trimmed
from commweave.llm.graph import connected_components

BITS, SEED, SHINGLE, RADIUS = 64, 42, 4, 4
#: Numbers of partitions that are weighed against each other; each has 64 / parts bits.
PARTS = (2, 3, 4)
#: Fingerprints by whose distances candidates are estimated, which changes the work but not the result.
SAMPLE = 4096
#: Rows of a bucket that are compared as they are; of larger ones, parts of RADIUS + 1 times 64 / (RADIUS + 1) bits
#: make keys, and where these have more rows too, pairs of blocks.
BLOCK = 16_384
#: Relative costs of comparing a pair and of shuffling a signature, for the allocation.
PAIR_COST, PROBE_COST = 1.0, 400.0


def fingerprint(text: bytes | None) -> int:
    """Signed 64-bit SimHash: a bit is set if it is in over half of the shingles' XXH64; no words: 0."""
    return of_digests(shingle_digests(text, SHINGLE, SEED))


def of_digests(digests: Iterable[bytes]) -> int:
    """fingerprint() of shingles' XXH64, in pieces of many."""
    counts, n = np.zeros(BITS, np.int64), 0
    for hashes in digests:
        bits = np.unpackbits(np.frombuffer(hashes, np.uint8)).reshape(-1, BITS)
        counts += np.add.reduce(bits, axis=0, dtype=np.int32)
        n += len(bits)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big", signed=True) if n else 0


@F.arrow_udf(LongType())
def _fingerprints(text: pa.Array) -> pa.Array:
    return pa.array(map(fingerprint, text.to_pylist()), pa.int64())


def _co_occurrence(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros((BITS, BITS))
    for b in batches:
        x = _bits(b["fp"].to_numpy())
        total += x.T @ x
    yield pd.DataFrame({"k": np.arange(BITS * BITS), "n": total.ravel()})


def _bits(fp: np.ndarray) -> np.ndarray:
    """Rows of 64 zeros and ones; column i is the bit of value 2**i."""
    return np.unpackbits(np.ascontiguousarray(fp.astype("<i8")).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float64)


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of equal width: each starts at the free bit most correlated with the others and takes on the free bit most correlated with it."""
    p = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    r = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(r, 0)
    free, groups = set(range(BITS)), []
    for k in range(parts):
        width = len(free) // (parts - k)
        rest = sorted(free)
        group = [max(rest, key=lambda b: (r[b, rest].sum(), -b))]
        while len(group) < width:
            rest = sorted(free - set(group))
            group.append(max(rest, key=lambda b: (r[b, group].sum(), -b)))
        groups.append(sorted(group))
        free -= set(group)
    return groups


def candidate_counts(sample: np.ndarray, bits: list[int], n: int, most: int) -> list[float]:
    """Pairs of n fingerprints within 0..most differing bits of a partition, estimated from a sample's pairs.

    Not below what evenly spread values give: a sample can't show what happens once in 2**32 pairs.
    """
    mask = np.uint64(sum(1 << b for b in bits))
    counts = np.zeros(len(bits) + 1)
    own = sample.view(np.uint64) & mask
    for a in range(0, len(own), 512):
        counts += np.bincount(np.bitwise_count(own[a : a + 512, None] ^ own[None]).ravel(), minlength=len(bits) + 1)[: len(bits) + 1]
    counts[0] -= len(own)
    share = np.cumsum(counts) / max(len(own) * (len(own) - 1), 1)
    even = np.cumsum([math.comb(len(bits), t) for t in range(most + 1)]) / 2.0 ** len(bits)
    return [float(n) * n * max(share[t], even[t]) for t in range(most + 1)]


def allocate(costs: list[list[float]], radius: int = RADIUS) -> list[int]:
    """Thresholds with sum(t + 1) = radius + 1 of least total cost; costs[i][t + 1] is the cost of t in partition i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for options in costs:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (cost, chosen) in best.items():
            for steps, more in enumerate(options):
                if used + steps <= radius + 1 and (used + steps not in after or cost + more < after[used + steps][0]):
                    after[used + steps] = (cost + more, [*chosen, steps - 1])
        best = after
    return best[radius + 1][1]


def _signature(bits: list[int]):
    """The partition's bits as an integer, by built-in functions."""
    return sum((F.shiftleft(F.shiftrightunsigned(F.col("fp"), b).bitwiseAND(F.lit(1)), i) for i, b in enumerate(bits)), F.lit(0).cast("long"))


def _forest(radius: int):
    def forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted rows (key, fp, own) to the links of a spanning forest of each key's fingerprints."""
        kept: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            key = b["key"].to_numpy()
            cut_at = int(np.searchsorted(key, key[-1]))
            if kept and (cut_at or kept[0]["key"].iloc[0] != key[-1]):
                yield _links(pd.concat([*kept, b.iloc[:cut_at]], ignore_index=True), radius)
                kept = []
            elif cut_at:
                yield _links(b.iloc[:cut_at], radius)
            kept.append(b.iloc[cut_at:])
        if kept:
            yield _links(pd.concat(kept, ignore_index=True), radius)

    return forest


def _links(rows: pd.DataFrame, radius: int = RADIUS) -> pd.DataFrame:
    """Links of a spanning forest of each key's fingerprints; two that are both probes needn't be compared."""
    key, fp, own = rows["key"].to_numpy(), rows["fp"].to_numpy().view(np.uint64), rows["own"].to_numpy()
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[starts[1:], len(key)]
    src, dst = [], []
    for a, z in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist()):
        # What is reached is taken out, so that a group of near copies costs its size and not its pairs.
        mine, probes = fp[a:z][own[a:z]], fp[a:z][~own[a:z]]
        while len(mine) and len(mine) + len(probes) > 1:
            reached, mine = [(mine[0], True)], mine[1:]
            while reached and (len(mine) or len(probes)):
                x, whole = reached.pop()
                near = np.bitwise_count(mine ^ x) <= radius
                if near.any():
                    found = mine[near]
                    src.append(np.full(len(found), x))
                    dst.append(found)
                    reached += [(y, True) for y in found]
                    mine = mine[~near]
                if whole and len(probes):
                    near = np.bitwise_count(probes ^ x) <= radius
                    if near.any():
                        found = probes[near]
                        src.append(np.full(len(found), x))
                        dst.append(found)
                        reached += [(y, False) for y in found]
                        probes = probes[~near]
    src, dst = (np.concatenate([np.zeros(0, np.uint64), *x]) for x in (src, dst))
    return pd.DataFrame({"src": src[src != dst].view(np.int64), "dst": dst[src != dst].view(np.int64)})


def plan(together: np.ndarray, sample: np.ndarray, n: int, parts=PARTS, radius: int = RADIUS) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost."""
    best = None
    for k in parts:
        groups, costs = group_bits(together, n, k), []
        for bits in groups:
            width = len(bits)
            most = max(1, radius // 2)
            pairs, probes = candidate_counts(sample, bits, n, most), np.cumsum([math.comb(width, t) for t in range(most + 1)])
            costs.append([0.0] + [PAIR_COST * c + PROBE_COST * n * p for c, p in zip(pairs, probes)])
        thresholds = allocate(costs, radius)
        cost = sum(c[t + 1] for c, t in zip(costs, thresholds))
        if best is None or cost < best[0]:
            best = (cost, groups, thresholds)
    return best[1], best[2]


def links(distinct: DataFrame, parts=PARTS, block: int = BLOCK, radius: int = RADIUS) -> DataFrame:
    """Distinct fingerprints (fp) to links (src, dst) that join exactly those within the radius, transitively."""
    together = np.zeros(BITS * BITS)
    for r in distinct.select("fp").mapInPandas(trimmed(_co_occurrence), "k int, n double").groupBy("k").agg(F.sum("n").alias("n")).collect():
        together[r["k"]] = r["n"]
    n = distinct.count()
    sample = np.array([r["fp"] for r in distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).collect()], np.int64)
    groups, thresholds = plan(together.reshape(BITS, BITS), sample, n, parts, radius)
    signed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("part"), _signature(g).alias("sig")) for i, g in enumerate(groups)])).alias("s")).select("fp", "s.part", "s.sig")
    masks = [[m for t in range(limit + 1) for m in (sum(1 << b for b in c) for c in combinations(range(len(g)), t))] for limit, g in zip(thresholds, groups)]
    flips = distinct.sparkSession.createDataFrame([(i, m) for i, of in enumerate(masks) for m in of], "part int, mask long")  # some hundred rows by parts and radius
    probed = signed.join(F.broadcast(flips), "part").select("part", F.xxhash64("part", F.col("sig").bitwiseXOR(F.col("mask"))).alias("key"), "fp", (F.col("mask") == 0).alias("own"))
    large = cut(probed.groupBy("key").count().where(F.col("count") > block).select("key"))
    if large.isEmpty():
        keyed = probed.select("key", "fp", "own")
    else:
        # Two fingerprints within the radius agree in one of radius + 1 parts of whatever bits are left.
        finer = F.lit(None).cast("array<bigint>")
        for i, g in enumerate(groups):
            rest = [b for b in range(BITS) if b not in g]
            pieces = [rest[j :: radius + 1] for j in range(radius + 1)]
            finer = F.when(F.col("part") == i, F.array(*[F.xxhash64("key", F.lit(j), _signature(piece)) for j, piece in enumerate(pieces)])).otherwise(finer)
        parted = cut(probed.join(large, "key", "left_semi").select(F.explode(finer).alias("key"), "fp", "own"))
        sizes = parted.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
        sized = parted.join(sizes, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        paired = sized.select("key", "fp", "own", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        key = F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))  # keys that fall together are only compared in vain
        keyed = probed.join(large, "key", "left_anti").select("key", "fp", "own").unionByName(paired.select(key.alias("key"), "fp", "own"))
    found = keyed.repartition("key").sortWithinPartitions("key").mapInPandas(trimmed(_forest(radius)), "src long, dst long")
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id) of every row; other columns of ``docs`` are left out.

    component_id: the smallest doc_id that a chain of links reaches. A null text has no words and fingerprint 0, as
    has an empty one; a null doc_id is in its group but never names it (null only where the group has no other).
    Repeated rows come back as often as they are given; an empty table gives an empty one.
    """
    marked = cut(docs.select(F.col(doc_id).alias("doc_id"), _fingerprints(F.col(text).cast("binary")).alias("fp")))
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    labels = connected_components(links(distinct))
    named = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return marked.join(named.select("fp", "component").join(smallest, "component").drop("component"), "fp").select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group of near copies (nearcopies: SimHash, five words, similarity 0.8) stays; all columns are kept.

    It is the one with the smallest id that isn't null, of several the one whose text has the smallest hash. Of rows
    alike in id and text one stays, that with the smallest hash of all columns. Only the ids and text hashes of what
    goes are joined to the documents.
    """
    from commweave.llm.nearcopies import near_copies, sent  # which finds its candidates by the links above

    marked = near_copies(docs, doc_id, text)
    gone = sent(cut(marked.where(~F.col("keep")).select(F.col("doc_id").alias("_i"), F.col("body").alias("_b")).distinct()))
    held = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(doc_id).alias("_id"), F.xxhash64(F.col(text).cast("binary")).alias("_body"))
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_body") == F.col("_b"))
    left = held.join(gone, same, "left_anti")
    twice = marked.where("keep").groupBy(F.col("doc_id").alias("_i"), F.col("body").alias("_b")).count().where("count > 1").select("_i", "_b")
    if twice.isEmpty():
        return left.select("_doc.*")
    first = left.join(twice, same, "left_semi").groupBy("_id", "_body").agg(F.min_by("_doc", F.xxhash64("_doc")).alias("_doc"))
    return left.join(twice, same, "left_anti").select("_doc").unionByName(first.select("_doc")).select("_doc.*")
