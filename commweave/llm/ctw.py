"""Context-tree weighting over bytes: a language model with the code length of every text.

A text is coded as its words in lower case, each with one space after it, and an end mark. Every byte is eight binary decisions;
a decision's counts under the last 0, 1, ..., DEPTH bytes, across words, give Krichevsky-Trofimov estimates, and the
weighted context tree mixes them over all depths. An event is a byte with its context; texts share events, so each
distinct event is weighed once and every text looks up all of its own.

An event's key holds the context's bytes, the last one highest, so that contexts with the same last bytes lie together
in sorted order. The tree is cut at ``cut_at`` bytes, so deep that every subtree below has few events: subtrees are
weighted in numpy, many at a time; the levels above are aggregations over contexts and nodes, of which there are 256 at
depth 0 and 65,536 at depth 1 at most, and these two are completed on the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from commweave.llm.common import Cut, cut, trimmed

DEPTH = 6
END = b"\n"
#: The shallowest cut, and distinct events that a subtree below the cut may have before the cut goes a byte deeper.
LEAST_CUT, GROUP = 3, 200_000
#: The most frequent events and tokens are sent to all tasks: HOT of 16 bytes, OFTEN of SHORT bytes, at most.
HOT, OFTEN, SHORT = 1 << 21, 1 << 16, 64
#: Distinct events or bytes of distinct tokens that a task gathers before it hands them on, and bytes of text that it counts at a time.
FLUSH_EVENTS, FLUSH_TOKENS, GATHERED = 3 << 19, 1 << 24, 1 << 21
#: Bytes of text and texts that are looked up together.
TOGETHER, TEXTS = 1 << 19, 256
#: Buckets in which counts of events are added up, by the last LEAST_CUT bytes of the context.
BUCKETS = 1024
LN2 = math.log(2)
_LEVELS = np.arange(8)


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0: Stirling's series from 8 on, recurrence below."""
    x = np.asarray(x, np.float64)
    shift, y = np.zeros_like(x), x.copy()
    while (low := y < 8).any():
        shift[low] += np.log(y[low])
        y[low] += 1
    z = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - shift


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov probability of a zeros and b ones."""
    return log_gamma(a + 0.5) + log_gamma(b + 0.5) - log_gamma(a + b + 1.0) - math.log(math.pi)


def spelled(text: bytes | None) -> bytes:
    """The bytes that stand for a text: its words in lower case (A-Z), a space after each, and the end mark."""
    words = (text or b"").lower().split()
    return b" ".join(words) + b" " + END if words else END


def tokens(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct tokens of spelled texts (words with their space, and the end mark), each token's place among them, and its text."""
    data = b"".join(texts)
    buffer = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((buffer == 32) | (buffer == END[0])) + 1
    encoded = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.r_[0, ends].astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
    mark = buffer[ends - 1] == END[0]
    return encoded.dictionary, encoded.indices.to_numpy(), np.cumsum(mark) - mark


def events(texts: list[bytes]) -> np.ndarray:
    """Keys of all bytes of spelled texts, in order. A text's first bytes have end marks for context."""
    buffer = np.frombuffer(END * DEPTH + (END * DEPTH).join(texts), np.uint8)
    n = len(buffer) - DEPTH
    key = buffer[DEPTH:].astype(np.uint64)
    before = np.empty(n, np.uint64)
    for i in range(1, DEPTH + 1):
        before[:] = buffer[DEPTH - i : DEPTH - i + n]
        before <<= np.uint64(8 * (DEPTH + 1 - i))
        key |= before
    del before
    inside = np.ones(n, bool)
    for at in np.cumsum([len(t) + DEPTH for t in texts[:-1]]).tolist():
        inside[at - DEPTH : at] = False
    return key[inside]


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an array that is sorted in place, and how often each occurs."""
    keys.sort()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.diff(np.r_[starts, len(keys)])


class Weights:
    """What one level makes of zeros, ones and the sum of the children's logpw (None: no children), for each (context, node)."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.seen, self.one = zeros + ones > 0, (ones + 0.5) / (zeros + ones + 1)
        own = log_kt(zeros, ones)
        self.logpw = own if below is None else np.where(self.seen, np.logaddexp(own, below) - LN2, 0.0)
        self.own = np.ones(len(own)) if below is None else 1 / (1 + np.exp(-np.clip(own - below, -500, 500)))

    def down(self, a, b, f) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the level above to this one: a decision's chance of a one is f if its path ends here, else a + b times what the levels below say.

        A path ends at the last context with training data: there the own estimate stands for all that lies below.
        """
        f = np.where(self.seen, a + b * self.one, f)
        return np.where(self.seen, a + b * self.own * self.one, a), np.where(self.seen, b * (1 - self.own), b), f


#: What lies above the root: without any training data every bit is 1/2 likely.
ABOVE = (0.0, 1.0, 0.5)


class Forest:
    """Whole subtrees of the contexts of ``cut_at`` to DEPTH bytes, of sorted distinct keys with training counts n.

    An entry is a context with a node of the byte's binary tree; up[DEPTH] leads from an event's eight decisions to
    entries, up[d] from the entries of depth d + 1 to those of depth d.
    """

    def __init__(self, keys: np.ndarray, n: np.ndarray, cut_at: int):
        byte = (keys & np.uint64(255)).astype(np.int64)
        self.bit = byte[:, None] >> (7 - _LEVELS) & 1
        node = (1 << _LEVELS) | (byte[:, None] >> (8 - _LEVELS))
        self.levels: dict[int, Weights] = {}
        self.up: dict[int, np.ndarray] = {}
        context, below = keys >> np.uint64(8), None
        for d in range(DEPTH, cut_at - 1, -1):
            starts = np.r_[True, context[1:] != context[:-1]]
            number, context = np.cumsum(starts) - 1, context[starts]
            if d == DEPTH:
                ids, up = np.unique((number[:, None] << 8 | node).ravel(), return_inverse=True)
                all_ = np.bincount(up, np.repeat(n.astype(np.float64), 8), len(ids))
                ones = np.bincount(up, (n[:, None] * self.bit).ravel().astype(np.float64), len(ids))
                zeros = all_ - ones
            else:
                ids, up = np.unique(number[at >> 8] << 8 | at & 255, return_inverse=True)  # noqa: F821
                zeros, ones, below = (np.bincount(up, x, len(ids)) for x in (zeros, ones, self.levels[d + 1].logpw))  # noqa: F821
            at, self.up[d], self.levels[d] = ids, up, Weights(zeros, ones, below)
            if d > cut_at:
                context = context >> np.uint64(8)
        self.context, self.node, self.zeros, self.ones = context[at >> 8], at & 255, zeros, ones
        self.logpw = self.levels[cut_at].logpw

    def log10(self, a, b, f) -> np.ndarray:
        """Each event's log10 probability, given what the levels above say to the entries at the cut."""
        for d in sorted(self.levels):
            if d != min(self.levels):
                a, b, f = (x[self.up[d - 1]] for x in (a, b, f))
            a, b, f = self.levels[d].down(a, b, f)
        p = f[self.up[DEPTH]].reshape(-1, 8)
        return np.log10(np.where(self.bit == 1, p, 1 - p)).sum(1)


class Top:
    """Depths 1 and 0 from the sums (context, node, zeros, ones, logpw) of depth 1's children; 65,536 entries at most."""

    def __init__(self, rows: pd.DataFrame):
        at = (rows["context"].to_numpy(np.int64) << 8) | rows["node"].to_numpy(np.int64)
        zeros, ones, below = (np.bincount(at, rows[x].to_numpy(np.float64), 1 << 16) for x in ("zeros", "ones", "logpw"))
        one = Weights(zeros, ones, below)
        root = Weights(*(x.reshape(256, 256).sum(0) for x in (zeros, ones, one.logpw)))
        state = root.down(*(np.full(256, x) for x in ABOVE))
        self.state = one.down(*(np.tile(x, 256) for x in state))

    def to(self, context: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """(a, b, f) for entries whose parents are contexts of one byte."""
        at = context.astype(np.int64) << 8 | node.astype(np.int64)
        return tuple(x[at] for x in self.state)


def _whole_groups(work: Callable[[pd.DataFrame], pd.DataFrame]):
    """Sorted batches to work() of whole groups (column g), some ten thousand rows at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: list[pd.DataFrame] = []
        size = 0
        for b in batches:
            kept.append(b)
            size += len(b)
            if size >= 50_000 and len(b) and kept[0]["g"].iloc[0] != b["g"].iloc[-1]:
                whole = pd.concat(kept, ignore_index=True)
                g = whole["g"].to_numpy()
                end = int(np.searchsorted(g, g[-1]))
                yield work(whole.iloc[:end])
                kept, size = [whole.iloc[end:]], len(whole) - end
        if size:
            yield work(pd.concat(kept, ignore_index=True))

    return run


def _count_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to partial counts (token, c in training texts, occurrences)."""
    kept: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

    def merged() -> tuple[pa.Array, np.ndarray, np.ndarray]:
        every = pa.concat_arrays([x for x, _, _ in kept]).dictionary_encode()
        place, n = every.indices.to_numpy(), len(every.dictionary)
        return every.dictionary, *(np.bincount(place, np.concatenate([x[i] for x in kept]), n).astype(np.int64) for i in (1, 2))

    def rows(distinct, c, total):
        for a in range(0, len(distinct), 50_000):
            yield pa.RecordBatch.from_arrays([distinct.slice(a, 50_000), pa.array(c[a : a + 50_000]), pa.array(total[a : a + 50_000])], ["token", "c", "total"])

    size = 0
    for texts, outs in _pieces(batches, GATHERED):
        for held in (False, True):
            some = [t for t, out in zip(texts, outs) if bool(out) == held]
            if some:
                distinct, place, _ = tokens(some)
                times = np.bincount(place, minlength=len(distinct))
                kept.append((distinct, np.zeros_like(times) if held else times, times))
                size += distinct.nbytes
        if size > FLUSH_TOKENS:
            kept = [merged()]
            size = kept[0][0].nbytes
            if size > FLUSH_TOKENS // 2:
                yield from rows(*kept[0])
                kept, size = [], 0
    if kept:
        yield from rows(*merged())


def _merged(kept: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys of several (keys, n, m), with sums."""
    keys = np.concatenate([np.zeros(0, np.uint64), *(k for k, _, _ in kept)])
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    sums = (np.add.reduceat(np.concatenate([x[i] for x in kept])[order], starts) if len(starts) else np.zeros(0, np.int64) for i in (1, 2))
    return keys[starts], *sums


def _packed(keys: np.ndarray, n: np.ndarray, m: np.ndarray) -> bytes:
    """Sorted keys as differences, and counts, byte plane by byte plane: shuffles compress planes of zeros."""
    planes = (np.diff(keys, prepend=np.uint64(0)), n.astype(np.uint32), m.astype(np.uint32))
    return b"".join(x.view(np.uint8).reshape(len(keys), -1).T.tobytes() for x in planes)


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    planes = np.frombuffer(blob, np.uint8).reshape(16, -1)
    keys = np.ascontiguousarray(planes[:8].T).view(np.uint64).reshape(-1)
    n, m = (np.ascontiguousarray(planes[a : a + 4].T).view(np.uint32).reshape(-1).astype(np.int64) for a in (8, 12))
    return np.cumsum(keys, dtype=np.uint64), n, m


def _count_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held_out, text) to partial counts (bucket, packed keys with their number in training texts and in all)."""
    kept: list[tuple[np.ndarray, ...]] = []

    def rows(keys, n, m):
        last = (keys >> np.uint64(8 * (DEPTH + 1 - LEAST_CUT))).astype(np.uint32)
        bucket = (last * np.uint32(0x9E3779B1) >> np.uint32(16)).astype(np.uint16) % np.uint16(BUCKETS)
        order = np.argsort(bucket, kind="stable")
        bucket, keys, n, m = bucket[order], keys[order], n[order], m[order]
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        ends = np.r_[starts[1:], len(bucket)]
        blobs = [_packed(keys[a:z], n[a:z], m[a:z]) for a, z in zip(starts, ends)]
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    size = 0
    for texts, outs in _pieces(batches, GATHERED):
        for held in (False, True):
            some = [t for t, out in zip(texts, outs) if bool(out) == held]
            if some:
                keys, times = _runs(events(some))
                kept.append((keys, np.zeros_like(times) if held else times, times))
                size += len(keys)
        if size > FLUSH_EVENTS:
            kept = [_merged(kept)]
            size = len(kept[0][0])
            if size > FLUSH_EVENTS // 2:
                yield from rows(*kept[0])
                kept, size = [], 0
    if kept:
        yield from rows(*_merged(kept))


def _add_events(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (bucket, blob) to whole counts (key, n, m)."""
    kept: list[tuple[np.ndarray, ...]] = []
    now, size = None, 0

    def rows():
        found = _merged(kept)
        for a in range(0, len(found[0]), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[0][a : a + 200_000].view(np.int64)), *(pa.array(x[a : a + 200_000]) for x in found[1:])], ["key", "n", "m"])

    for b in batches:
        for bucket, blob in zip(b.column(0).to_pylist(), b.column(1)):
            if bucket != now:
                if kept:
                    yield from rows()
                kept, now, size = [], bucket, 0
            kept.append(_unpacked(blob.as_py()))
            size += len(kept[-1][0])
            if size > 2 * FLUSH_EVENTS:
                kept = [_merged(kept)]
                size = len(kept[0][0]) // 2  # what is distinct already isn't merged again at once
    if kept:
        yield from rows()


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list[bytes], list]]:
    """Spelled texts and their marks of (held_out, text), ``most`` bytes at a time or one longer text."""
    texts, outs, size = [], [], 0
    for b in batches:
        for out, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            texts.append(spelled(text))
            outs.append(out)
            size += len(texts[-1])
            if size > most:
                yield texts, outs
                texts, outs, size = [], [], 0
    if texts:
        yield texts, outs


def vocabulary(given: DataFrame) -> DataFrame:
    """(token, c, total) of (held_out, text as binary): training count and count of every token; the empty one is the end mark."""
    return given.mapInArrow(trimmed(_count_tokens), "token binary, c long, total long").groupBy("token").agg(F.sum("c").alias("c"), F.sum("total").alias("total"))


def tree(given: DataFrame, cut_at: int | None = None, group: int = GROUP) -> DataFrame:
    """(key, m, lp): the log10 probability and number of every event of (held_out, text as binary), under the training texts' tree.

    cut_at: where the tree is cut, from 2 to DEPTH - 1; by default as deep as makes subtrees of ``group`` events at most.
    """
    parts = given.mapInArrow(trimmed(_count_events), "bucket int, blob binary").repartition("bucket").sortWithinPartitions("bucket")
    counts = cut(parts.mapInArrow(trimmed(_add_events), "key long, n long, m long"))
    last = lambda c: F.shiftrightunsigned("key", 8 * (DEPTH + 1 - c))
    if cut_at is None:
        for cut_at in range(LEAST_CUT, DEPTH):
            largest = counts.groupBy(last(cut_at).alias("g")).count().agg(F.max("count")).first()[0] or 0
            if largest <= group:
                break
    grouped = counts.withColumn("g", last(cut_at))
    columns = ["context", "node", "zeros", "ones", "logpw"]
    kinds = "context long, node long, zeros double, ones double, logpw double"

    def summary(e: pd.DataFrame) -> pd.DataFrame:
        f = Forest(e["key"].to_numpy().view(np.uint64), e["n"].to_numpy(), cut_at)
        return pd.DataFrame(dict(zip(columns, (f.context.view(np.int64), f.node, f.zeros, f.ones, f.logpw))))

    # Entries by depth, from the cut up to depth 2; each is the sum of its children below.
    entries = {cut_at: Cut(grouped.repartition("g").sortWithinPartitions("g", "key").mapInPandas(trimmed(_whole_groups(summary)), kinds))}

    def parents(d: int) -> DataFrame:
        by = F.shiftrightunsigned("context", 8).alias("context")
        return entries[d + 1].df.groupBy(by, "node").agg(*(F.sum(x).alias(x) for x in columns[2:]))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            w = Weights(b["zeros"].to_numpy(), b["ones"].to_numpy(), b["logpw"].to_numpy())
            yield b.assign(below=b["logpw"], logpw=w.logpw)

    for d in range(cut_at - 1, 1, -1):
        entries[d] = Cut(parents(d).select(columns).mapInPandas(weigh, f"{kinds}, below double"))
    top = Top(pd.DataFrame([tuple(r) for r in parents(1).select(columns).collect()], columns=columns).sort_values(["context", "node"]))  # 65,280 rows at most
    state = None
    for d in range(2, cut_at):
        own = entries[d].df
        if state is not None:
            own = own.withColumn("p", F.shiftrightunsigned("context", 8)).join(state.select(F.col("context").alias("p"), "node", "a", "b", "f"), ["p", "node"]).drop("p")

        def settle(batches: Iterator[pd.DataFrame], given=state is not None) -> Iterator[pd.DataFrame]:
            for b in batches:
                w = Weights(b["zeros"].to_numpy(), b["ones"].to_numpy(), b["below"].to_numpy())
                above = tuple(b[x].to_numpy() for x in "abf") if given else top.to(b["context"].to_numpy() >> 8, b["node"].to_numpy())
                yield pd.DataFrame(dict(zip(("context", "node", "a", "b", "f"), (b["context"], b["node"], *w.down(*above)))))

        state = own.mapInPandas(settle, "context long, node long, a double, b double, f double")
    # What the levels above say comes to a subtree's task as rows of their own; they sort before its events, in the order of its entries.
    asked = entries[cut_at].df.select(F.col("context").alias("g"), "node")
    if state is not None:
        asked = asked.withColumn("p", F.shiftrightunsigned("g", 8)).join(state.select(F.col("context").alias("p"), "node", "a", "b", "f"), ["p", "node"]).drop("p")
    else:
        asked = asked.withColumns({x: F.lit(None).cast("double") for x in "abf"})
    told = asked.select("g", (F.col("node") - 256).alias("key"), F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("m"), "a", "b", "f")
    both = grouped.select("g", "key", "n", "m", *(F.lit(None).cast("double").alias(x) for x in "abf")).unionByName(told)
    given_above = state is not None

    def score(e: pd.DataFrame) -> pd.DataFrame:
        is_event = e["key"].to_numpy() >= 0
        ev, up = e[is_event], e[~is_event]
        f = Forest(ev["key"].to_numpy().view(np.uint64), ev["n"].to_numpy(np.int64), cut_at)
        above = tuple(up[x].to_numpy() for x in "abf") if given_above else top.to(f.context.view(np.int64) >> 8, f.node)
        return pd.DataFrame({"key": ev["key"].to_numpy(), "m": ev["m"].to_numpy(np.int64), "lp": f.log10(*above)})

    return cut(both.repartition("g").sortWithinPartitions("g", "key").mapInPandas(trimmed(_whole_groups(score)), "key long, m long, lp double"))


def most_frequent(counts: DataFrame, column: str, most: int) -> DataFrame:
    """The rows with the highest counts, ``most`` at most: all from some count on."""
    step = F.floor(F.log2(column) * 8).cast("int")
    sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)  # 512 rows at most
    total, least = 0, 1 << 20
    for s, n in sizes:
        total += n
        if total > most:
            break
        least = s
    return counts.where(step >= least)


def score_texts(docs: DataFrame, held_out: str, doc_id: str = "doc_id", text: str = "text", cut_at: int | None = None, hot: int = HOT, often: int = OFTEN, group: int = GROUP) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    The model is learned from the rows where the boolean column ``held_out`` is not true. base_score is the smoothed unigram
    model's log10 probability, score the tree's, bits_per_byte its code length for each byte of the spelled text. Null and
    empty texts are an end mark; repeated rows are scored each; without training rows every bit is 1/2 likely; an empty
    table gives an empty one. Whole texts are read, some megabytes at a time, so a task holds the longest text of its rows
    and about 50 bytes for each of that text's bytes.
    """
    given = docs.select(F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    vocab = cut(vocabulary(given))
    totals = vocab.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    n, v = totals["n"] or 0, totals["v"] or 0
    scored = tree(given, cut_at, group)
    rows = most_frequent(scored, "m", hot).select("key", "lp").toArrow()
    hot_key, hot_lp = rows["key"].to_numpy().view(np.uint64), rows["lp"].to_numpy()
    order = np.argsort(hot_key)
    hot_key, hot_lp = hot_key[order], hot_lp[order]
    short = most_frequent(vocab.where(F.octet_length("token") <= SHORT), "total", often).select("token", "c").toArrow()
    often_token, often_c = short["token"].combine_chunks(), short["c"].to_numpy().astype(np.float64)
    # One entry more, for tokens that aren't among them.
    often_known, often_base = np.r_[often_c > 0, False].astype(np.float64), np.r_[np.log10((often_c + 1) / (n + v + 1)), 0.0]

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row of sums over frequent tokens and events for each text, and rows of its other tokens and events."""
        names = ["row", "doc_id", "held_out", "bytes", "token", "key", "tf", "known", "base", "score"]
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(3)), 0).to_pylist()
            at = 0
            while at < b.num_rows:
                end, size = at + 1, sizes[at]
                while end < b.num_rows and end - at < TEXTS and size + sizes[end] <= TOGETHER:
                    size += sizes[end]
                    end += 1
                some = b.slice(at, end - at)
                at = end
                row, bodies = some.column(0), [spelled(t) for t in some.column(3).to_pylist()]
                rows_, many = row.to_numpy(), len(bodies)
                distinct, place, owner = tokens(bodies)
                entry = pc.fill_null(pc.index_in(distinct, value_set=often_token), len(often_token)).to_numpy()[place]
                sums = [np.bincount(owner, w[entry], many) for w in (often_known, often_base)]
                rare, tf = _runs(owner[entry == len(often_token)] * np.int64(len(distinct)) + place[entry == len(often_token)])
                # Keys take 56 bits; the text's place among TEXTS rides below, so that plain values are sorted.
                lengths = np.array([len(t) for t in bodies])
                pairs = events(bodies)
                pairs <<= np.uint64(8)
                pairs |= np.repeat(np.arange(many, dtype=np.uint64), lengths)
                pairs.sort()
                key, whose = pairs >> np.uint64(8), (pairs & np.uint64(255)).view(np.int64)
                spot = np.searchsorted(hot_key, key)
                np.minimum(spot, max(len(hot_key) - 1, 0), out=spot)
                hit = hot_key[spot] == key if len(hot_key) else np.zeros(len(key), bool)
                score = np.bincount(whose[hit], hot_lp[spot[hit]] if len(hot_key) else None, many).astype(np.float64)
                pairs, times = _runs(pairs[~hit])
                left, whose = (pairs >> np.uint64(8)).view(np.int64), (pairs & np.uint64(255)).astype(np.int64)
                m, k = len(rare), len(left)
                blank = lambda x, of: pa.concat_arrays([x, pa.nulls(m + k, of)])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[rows_, rows_[rare // len(distinct)], rows_[whose]]),
                        blank(some.column(1), some.column(1).type),
                        blank(some.column(2), pa.bool_()),
                        blank(pa.array(lengths), pa.int64()),
                        pa.concat_arrays([pa.nulls(many, pa.binary()), distinct.take(pa.array(rare % len(distinct))), pa.nulls(k, pa.binary())]),
                        pa.concat_arrays([pa.nulls(many + m, pa.int64()), pa.array(left)]),
                        pa.array(np.r_[np.bincount(owner, minlength=many), tf, times]),
                        blank(pa.array(sums[0].astype(np.int64)), pa.int64()),
                        blank(pa.array(sums[1]), pa.float64()),
                        blank(pa.array(score), pa.float64()),
                    ],
                    names,
                )

    kind = docs.schema[doc_id].dataType.simpleString()
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(held_out), F.lit(False)).alias("held_out"), F.col(text).cast("binary").alias("text"))
    parts = cut(texts.mapInArrow(trimmed(split), f"row long, doc_id {kind}, held_out boolean, bytes long, token binary, key long, tf long, known long, base double, score double"))
    chance = F.log10((F.col("c") + 1) / F.lit(float(n + v + 1)))
    none = lambda of, name: F.lit(None).cast(of).alias(name)
    same = ["row", none(kind, "doc_id"), none("boolean", "held_out"), none("long", "bytes")]
    rare = parts.where("token is not null").select("row", "token", "tf").join(vocab.select("token", "c"), "token")
    rare = rare.select(*same, F.lit(0).cast("long").alias("tf"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).alias("known"), (F.col("tf") * chance).alias("base"), F.lit(0.0).alias("score"))
    left = parts.where("key is not null").select("row", "key", "tf").join(scored.select("key", "lp"), "key")
    left = left.select(*same, F.lit(0).cast("long").alias("tf"), F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("tf") * F.col("lp")).alias("score"))
    total = parts.where("token is null and key is null").drop("token", "key").unionByName(rare).unionByName(left).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("bytes").alias("bytes"), *(F.sum(x).alias(x) for x in ("tf", "known", "base", "score"))
    )
    return total.select("doc_id", "held_out", F.col("tf").alias("n_tokens"), F.col("known").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score", (-F.col("score") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"))
