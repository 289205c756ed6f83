"""Benchmark decontamination with built-in functions only.

Each benchmark item has a SimHash of its five-word shingles. A document's windows of an item's size are looked up in a
multi-index: the 64 bits are cut into blocks, and a fingerprint within the radius of an item's differs in some block by
at most radius // blocks bits, so probing every block under all such changes finds all of them. Candidates are verified
by the exact weighted Jaccard similarity of their shingle counts.

Only windows that can be similar enough are hashed: a window with similarity s shares at least s / (1 + s) of both
shingle counts with the item: 2 s / (1 + s) of its own where it is as large, s of the item's where the document is shorter. Of the windows with the same first shared shingle the one that
starts there shares the most, so windows start at shared shingles that have enough others in reach.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commweave.llm.common import SPACES, cut

SHINGLE, SIMILARITY = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 8, 23
#: Shared shingles of a benchmark up to which its shingle table is sent to all tasks; beyond, it is joined by shuffle.
BROADCAST_SHINGLES = 2_000_000
#: Window starts up to which they are sent to the documents; beyond, documents and starts are joined by shuffle.
BROADCAST_STARTS = 1_000_000


def bound(value: Column, body) -> Column:
    """body(value) with the value computed once for each row: an expression used in a lambda is else computed for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Words in lower case, letters beyond A-Z included; no words for null."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Hash of every five-word shingle in order; of fewer words the hash of all of them; none for no words."""

    def each(w: Column) -> Column:
        hashed = F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - SHINGLE, F.lit(0))), lambda i: F.xxhash64(F.slice(w, i + 1, SHINGLE)))
        return F.when(F.size(w) > 0, hashed).otherwise(F.array().cast("array<bigint>"))

    return bound(words, each)


def simhash(hashes: Column) -> Column:
    """A bit is set if it is in over half of the hashes."""

    def of(hs: Column) -> Column:
        bit = lambda b: F.when(2 * F.size(F.filter(hs, lambda h: F.call_function("getbit", h, b) == 1)) > F.size(hs), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))
        return F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), bit), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))

    return bound(hashes, of)


def weighted_jaccard(a: Column, b: Column) -> Column:
    """Sum of the lesser by the sum of the greater counts over all shingles."""
    count = lambda x, h: F.size(F.filter(x, lambda y: y == h))
    shared = F.aggregate(F.array_distinct(a), F.lit(0), lambda n, h: n + F.least(count(a, h), count(b, h)))
    return bound(shared, lambda n: n / (F.size(a) + F.size(b) - n))


def _blocks(fp: Column) -> Column:
    width = BITS // BLOCKS
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1)).cast("int").alias("value")) for i in range(BLOCKS)])


def _changes() -> list[int]:
    width = BITS // BLOCKS
    return [sum(1 << b for b in c) for n in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), n)]


def _key(doc_id: str, text: str) -> tuple[Column, Column]:
    """128 bits of id and text name a row, so that null and repeated ids are told apart and rows alike in both are one."""
    i, t = F.col(doc_id).cast("string"), F.col(text)
    return F.xxhash64(i.isNull(), i, t.isNull(), t), F.xxhash64(t, t.isNull(), i, i.isNull(), F.lit(1))


def _found(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, broadcast_shingles: int, broadcast_starts: int) -> DataFrame:
    """(a, b, doc_id, item_id, similarity, start), a and b naming the row."""
    items = benchmark.select(F.col(item_id).alias("item_id"), shingles_of(words_of(F.col(item_text))).alias("item")).where(F.size("item") > 0)
    items = cut(items.select(F.xxhash64("item_id", "item").alias("no"), "item_id", "item").distinct())
    # A shingle of many items would repeat a document's position for each; hits meet items by size, and their item only when counted.
    shared = cut(items.select("no", F.size("item").alias("m"), F.explode(F.array_distinct("item")).alias("h")))
    small = shared.count() <= broadcast_shingles  # of 20 bytes
    a, b = _key(doc_id, text)
    given = docs.select(a.alias("a"), b.alias("b"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    known = shared.select("h").distinct()
    hashed = given.select("a", "b", shingles_of(words_of(F.col("text"))).alias("hashes"))
    spots = hashed.select("a", "b", F.size("hashes").alias("length"), F.posexplode("hashes").alias("pos", "h"))
    spots = cut(spots.join(F.broadcast(known) if small else known, "h", "left_semi").distinct())
    need = F.ceil(F.lit(SIMILARITY / (1 + SIMILARITY)) * (F.least("length", "m") + F.col("m")) - F.lit(1e-9))
    hits = spots.join(F.broadcast(shared) if small else shared, "h").withColumn("need", need.cast("int"))
    # Enough shared shingles from here on: the hit that makes the count up is at most m - 1 behind the first.
    span = Window.partitionBy("a", "b", "no").orderBy("pos")
    numbered = hits.withColumn("n", F.row_number().over(span))
    last = numbered.select("a", "b", "no", (F.col("n") - F.col("need") + 1).alias("n"), F.col("pos").alias("reach"))
    reached = numbered.join(last, ["a", "b", "no", "n"]).where(F.col("reach") - F.col("pos") < F.col("m"))
    starts = cut(reached.select("a", "b", "m", F.greatest(F.least("pos", F.col("length") - F.col("m")), F.lit(0)).alias("start")).distinct())
    # Windows are cut out of the few documents that have starts; only their texts are split and hashed again.
    chosen = starts.groupBy("a", "b").agg(F.collect_set(F.struct("m", "start")).alias("starts"))
    few = starts.count() <= broadcast_starts  # of 24 bytes
    again = given.join(F.broadcast(chosen) if few else chosen, ["a", "b"]).dropDuplicates(["a", "b"])
    windows = again.select("a", "b", "doc_id", shingles_of(words_of(F.col("text"))).alias("hashes"), "starts").select("a", "b", "doc_id", "hashes", F.explode("starts").alias("s"))
    windows = windows.select("a", "b", "doc_id", "s.m", "s.start", F.slice("hashes", F.col("s.start") + 1, F.col("s.m")).alias("window"))
    windows = cut(windows.withColumn("fp", simhash(F.col("window"))))
    width = BITS // BLOCKS
    changed = F.explode(F.array(*[F.lit(c) for c in _changes()]))
    # Index and probes hold numbers only; windows and items join the candidates.
    index = items.select("no", F.size("item").alias("m"), simhash(F.col("item")).alias("item_fp"))
    index = index.select("*", F.explode(_blocks(F.col("item_fp"))).alias("of")).select("*", changed.alias("change")).select("no", "m", "item_fp", "of.block", F.col("of.value").bitwiseXOR(F.col("change")).alias("value"))
    probes = windows.select("a", "b", "m", "start", "fp", F.explode(_blocks(F.col("fp"))).alias("of")).select("a", "b", "m", "start", "fp", "of.block", "of.value")
    near = probes.join(index, ["m", "block", "value"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS)
    # A pair found in several blocks counts in its first.
    first = F.array_min(F.filter(F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda i: F.when(F.bit_count(F.call_function("shiftrightunsigned", F.col("fp").bitwiseXOR(F.col("item_fp")), i * width).bitwiseAND(F.lit((1 << width) - 1))) <= RADIUS // BLOCKS, i)), lambda i: i.isNotNull()))
    pairs = near.where(F.col("block") == first).select("a", "b", "m", "start", "no")
    pairs = pairs.join(windows.drop("fp"), ["a", "b", "m", "start"]).join(items, "no").withColumn("similarity", weighted_jaccard(F.col("window"), F.col("item")))
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"))).alias("best")
    found = pairs.where(F.col("similarity") >= SIMILARITY - 1e-9).groupBy("a", "b", "no").agg(F.max("doc_id").alias("doc_id"), F.max("item_id").alias("item_id"), best)
    return found.select("a", "b", "doc_id", "item_id", "best.similarity", (-F.col("best.before")).alias("start"))


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_shingles: int = BROADCAST_SHINGLES, broadcast_starts: int = BROADCAST_STARTS) -> DataFrame:
    """(doc_id, item_id, similarity, start) of the best window of every contaminated document and item.

    start: 0-based shingle at which the window starts; of equally similar windows the first. Documents shorter than an
    item are one window. An item of fewer than five words is one shingle, which only a document of just these words
    has. Items and documents without words match nothing. Rows alike in id and text give one row; rows of one id with
    different texts give one each; null ids, of documents or items, are ids like any other. Very long texts are read
    whole. Empty tables give an empty one.
    """
    return _found(docs, benchmark, doc_id, text, item_id, item_text, broadcast_shingles, broadcast_starts).drop("a", "b")


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows without a leak, all columns kept; rows with a null id go by their text like any other."""
    named = cut(_found(docs, benchmark, doc_id, text, "item_id", "text", BROADCAST_SHINGLES, BROADCAST_STARTS).select("a", "b").distinct())
    a, b = _key(doc_id, text)
    held = docs.select(F.struct(*docs.columns).alias("_doc"), a.alias("_a"), b.alias("_b"))
    return held.join(named, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left_anti").select("_doc.*")
