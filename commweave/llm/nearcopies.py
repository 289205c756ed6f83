"""Near copies by SimHash and the exact Jaccard similarity of word shingles.

SimHash (simhash.links, generalised pigeonhole) finds texts whose fingerprints of these shingles lie within a radius; its
links are verified on the whole sets of shingles and make components. What the radius misses is completed between
components by prefix filtering: two sets of n shingles or more with similarity s share at least s * n of them, so they
share one of their first n - ceil(s * n) + 1 shingles in any order that is the same for all texts: no pair is lost.
Frequent shingles come last in the order; which are frequent is estimated on a sample, which changes the work but not
the result. At the first shingle that two sets share, at places i and j, they can share min(n - i, m - j) at most.
Candidates must agree in size, in these places and in a parity bitmap (two bitmaps differ in no more bits than the sets
in shingles) and are verified on the whole sets.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from commweave.llm.common import Cut, batch_udf, shingle_digests
from commweave.llm.graph import connected_components
from commweave.llm.simhash import links, of_digests

SEED, SHINGLE, SIMILARITY = 42, 5, 0.8
#: One text in SAMPLE is read to find shingles of so many texts that they come last; at most FREQUENT are sent to the tasks.
SAMPLE, FREQUENT = 8, 1 << 20
#: Bits of a parity bitmap, and of its folded form.
PARITY, FOLDED = 1024, 256
#: Differing bits of 64 up to which SimHash looks for near copies; it changes the work but not the result.
RADIUS = 6
#: Rows of two numbers that are sent to all tasks at most; more are shuffled, and the texts with them.
SENT = 1 << 20


def sent(rows: DataFrame) -> DataFrame:
    """Rows of two numbers for a join, broadcast if they are few enough; they are counted, so they should lie in storage."""
    return F.broadcast(rows) if rows.count() <= SENT else rows


def _set_of(digests: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(x, np.int64) for x in digests]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)


def shingle_set(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; of fewer words the hash of all of them; none for no words."""
    return _set_of(list(shingle_digests(text, shingle, SEED)))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int64), *arrays])))


def _sets(shingle: int):
    def sets(text: pa.Array) -> pa.Array:
        return _lists([shingle_set(x, shingle) for x in text.to_pylist()])

    return batch_udf(sets, "array<bigint>")


def _marks(shingle: int, similarity: float, frequent: np.ndarray, rank: np.ndarray):
    """sig: hash of the set; n: its size; fp: SimHash; bits: its parity bitmap; prefix: its first shingles, frequent ones last."""

    def marks(text: pa.Array) -> pa.Array:
        sig, n, fp, bits, prefix = [], [], [], [], []
        for x in text.to_pylist():
            digests = list(shingle_digests(x, shingle, SEED))
            s = _set_of(digests)
            fp.append(of_digests(digests))
            first = len(s) - int(np.ceil(similarity * len(s) - 1e-9)) + 1 if len(s) else 0
            late = np.zeros(len(s), np.int64)
            if len(frequent) and len(s):
                at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                late = np.where(frequent[at] == s, rank[at], 0)
            sig.append(int.from_bytes(xxhash.xxh64_digest(s.tobytes(), SEED), "big", signed=True))
            n.append(len(s))
            bits.append(np.packbits((np.bincount(s & (PARITY - 1), minlength=PARITY) & 1).astype(np.uint8)).view(np.int64))
            prefix.append(s[np.lexsort((s, late))[:first]])
        return pa.StructArray.from_arrays([pa.array(sig, pa.int64()), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), _lists(bits), _lists(prefix)], ["sig", "n", "fp", "bits", "prefix"])

    return batch_udf(marks, "struct<sig: bigint, n: int, fp: bigint, bits: array<bigint>, prefix: array<bigint>>")


def _frequent(docs: DataFrame, text: Column, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several sampled texts, sorted, and their places in the order of frequency, from 1."""
    sampled = docs.where(F.pmod(F.xxhash64(text), F.lit(SAMPLE)) == 0).select(F.explode(_sets(shingle)(text)).alias("h"))
    rows = sampled.groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(FREQUENT).toArrow()
    h, n = (rows[c].to_numpy().astype(np.int64) for c in ("h", "n"))
    rank = np.empty(len(h), np.int64)
    rank[np.lexsort((h, n))] = np.arange(1, len(h) + 1)
    order = np.argsort(h)
    return h[order], rank[order]


def _may(a: str, b: str, similarity: float) -> Column:
    """Whether sizes, places of a shared shingle and folded bitmaps of two sets allow the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))) for i in range(FOLDED // 64)])
    shared = F.least(n - F.col(f"{a}.i"), m - F.col(f"{b}.i"))
    sizes = (F.least(n, m) >= similarity * F.greatest(n, m) - 1e-9) & (shared * (1 + similarity) >= similarity * (n + m) - 1e-9)
    return sizes & (apart <= (1 - similarity) / (1 + similarity) * (n + m) + 1e-9)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """(doc_id, component_id, body, keep) of every row; texts are linked if their sets of shingles have the similarity or more.

    body: XXH64 of the text, 42 for null. keep: whether the row's id and body are those that stand for its group, the
    smallest with an id that isn't null. component_id: the smallest doc_id that a chain of links reaches. Texts without words are copies of each other; a null
    doc_id is in its group but never names it (null only where the group has no other). Repeated rows come back as often
    as they are given; an empty table gives an empty one.
    """
    body = F.col(text).cast("binary")
    marks = _marks(shingle, similarity, *_frequent(docs, body, shingle))
    marked = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(body).alias("body"), marks(body).alias("m"))
    marked = Cut(marked.select("doc_id", "body", "m.*"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), "body")).alias("first")
    same = [first, F.min("body").alias("body"), *[F.first(c).alias(c) for c in ("n", "fp", "bits", "prefix")]]
    whole = Cut(marked.df.groupBy("sig").agg(*same))
    slim = Cut(marked.df.select("doc_id", "body", "sig"))
    marked.drop()
    # Shingles that the same sets have first are one spot: a set stands there with its least place.
    of = Window.partitionBy("h")
    spots = whole.df.select("sig", "n", F.posexplode("prefix").alias("i", "h"))
    spots = spots.select("sig", "n", "i", F.count("*").over(of).alias("k"), F.bit_xor(F.xxhash64("sig")).over(of).alias("spot")).where("k > 1")
    spots = Cut(spots.groupBy("spot", "sig").agg(F.min("n").alias("n"), F.min("i").alias("i")))
    kept = Cut(whole.df.drop("prefix"))
    whole.drop()
    distinct = kept.df

    def verified(pairs: DataFrame) -> Cut:
        """Distinct pairs (src, dst) of sets to those that are similar; only texts of candidates are read again."""
        for end in ("src", "dst"):
            pairs = pairs.join(distinct.select(F.col("sig").alias(end), F.struct("n", "bits").alias(f"_{end}")), end)
        apart = F.aggregate(F.zip_with("_src.bits", "_dst.bits", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda a, x: a + x)
        likely = Cut(pairs.where(apart <= (1 - similarity) / (1 + similarity) * (F.col("_src.n") + F.col("_dst.n")) + 1e-9).select("src", "dst"))
        asked = likely.df.select(F.explode(F.array("src", "dst")).alias("sig")).distinct()
        wanted = Cut(distinct.join(asked, "sig", "left_semi").select("sig", "body"))
        once = docs.select(F.xxhash64(body).alias("body"), body.alias("_text")).join(sent(wanted.df), "body").select("sig", _sets(shingle)(F.col("_text")).alias("s"))
        sets = Cut(once.dropDuplicates(["sig"]))
        both = likely.df.join(sets.df.select(F.col("sig").alias("src"), F.col("s").alias("a")), "src").join(sets.df.select(F.col("sig").alias("dst"), F.col("s").alias("b")), "dst")
        shared = F.size(F.array_intersect("a", "b"))
        found = Cut(both.where(shared * (1 + similarity) >= similarity * (F.size("a") + F.size("b")) - 1e-9).select("src", "dst"))
        for done in (likely, wanted, sets):
            done.drop()
        return found

    prints = Cut(distinct.groupBy("fp").agg(F.min("sig").alias("to")))
    near = links(prints.df.select("fp"), radius=radius)
    for end in ("src", "dst"):
        near = near.join(prints.df.select(F.col("fp").alias(end), F.col("to").alias(f"_{end}")), end)
    alike = distinct.join(prints.df, "fp").where("sig <> to").select(F.col("to").alias("src"), F.col("sig").alias("dst"))
    by_print = verified(near.select(F.least("_src", "_dst").alias("src"), F.greatest("_src", "_dst").alias("dst")).distinct().unionByName(alike))
    labels = connected_components(by_print.df)
    placed = spots.df.join(labels.withColumnRenamed("node", "sig"), "sig", "left").withColumn("c", F.coalesce("component", "sig")).drop("component")
    open_ = placed.groupBy("spot").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("spot")
    folded = [reduce(lambda a, b: a.bitwiseXOR(b), [F.get("bits", F.lit(i)) for i in range(j, PARITY // 64, FOLDED // 64)]).alias(f"f{j}") for j in range(FOLDED // 64)]
    open_ = placed.join(open_, "spot", "left_semi").join(distinct.select("sig", *folded), "sig")
    left = Cut(open_.select("spot", F.struct("sig", "n", "i", "c", *[f"f{j}" for j in range(FOLDED // 64)]).alias("x")))
    spots.drop()
    others = left.df.select("spot", F.col("x").alias("y"))
    rest = left.df.join(others, "spot").where((F.col("x.c") != F.col("y.c")) & (F.col("x.sig") < F.col("y.sig")) & _may("x", "y", similarity))
    by_set = verified(rest.select(F.col("x.sig").alias("src"), F.col("y.sig").alias("dst")).distinct())
    labels = connected_components(by_print.df.unionByName(by_set.df)).withColumnRenamed("node", "sig")
    named = distinct.select("sig", "first").join(labels, "sig", "left").withColumn("component", F.coalesce("component", "sig"))
    smallest = named.groupBy("component").agg(F.min("first").alias("first"))
    keep = F.col("doc_id").eqNullSafe(F.col("first.id")) & (F.col("body") == F.col("first.body"))
    found = slim.df.join(named.select("sig", "component").join(smallest, "component").drop("component"), "sig")
    found = Cut(found.select("doc_id", F.col("first.id").alias("component_id"), "body", keep.alias("keep")))
    for done in (slim, kept, prints, by_print, left, by_set):
        done.drop()
    return found.df
