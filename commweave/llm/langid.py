"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a text in both directions, gives every byte a distribution over the languages, and pools them over the
whole text. Long texts are read in segments that start and end between characters; each direction reads WARM bytes of
its neighbour first, so that its state is that of the text. Segments are run in blocks of a fixed shape, so that a text's
score doesn't depend on the texts around it. The network is trained here, in numpy, by backpropagation through time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from commweave.llm.common import trimmed

#: Units of each direction, bytes of a segment, bytes read before it, segments of a block, and bytes of texts that are pooled together.
UNITS, SEGMENT, WARM, LANES, TOGETHER = 12, 384, 32, 1024, 1 << 22
#: Training sample: about so many windows of so many characters for each language, drawn from the whole texts of all its documents.
PER_LANGUAGE, WINDOW = 3000, 96
STEPS, BATCH, RATE, SEED = 240, 128, 0.03, 7
UNKNOWN = "und"


class Network:
    """Weights of both directions (index 0: left to right): input tables (2, 256, 2 units), recurrences (2, units, 2 units), biases, and the output layer.

    Minimal gated units: h' = h + f (n - h) with the gate f = sigmoid(x_f + h U_f) and the candidate
    n = tanh(x_n + f (h U_n + c)); gate and candidate in that order.
    """

    def __init__(self, languages: list[str], rng: np.random.Generator):
        k, n = UNITS, len(languages)
        self.languages = languages
        self.p = {
            "x": rng.normal(0, 0.3, (2, 256, 2 * k)),
            "u": rng.normal(0, 0.5 / np.sqrt(k), (2, k, 2 * k)),
            "c": np.zeros((2, k)),
            "v": rng.normal(0, 0.5 / np.sqrt(k), (2, k, n)),
            "b": np.zeros(n),
        }
        self.p["x"][:, :, :k] -= 1  # gates start half closed
        self.p = {name: w.astype(np.float32) for name, w in self.p.items()}

    def states(self, data: np.ndarray, way: int) -> list[tuple]:
        """data: time x segments. What each step computed, in the order of reading."""
        k, p = UNITS, self.p
        x, u, c = p["x"][way], p["u"][way], p["c"][way]
        h, steps = np.zeros((data.shape[1], k), np.float32), []
        for t in range(len(data)) if way == 0 else range(len(data) - 1, -1, -1):
            g, s = x[data[t]], h @ u
            f = 0.5 + 0.5 * np.tanh(0.5 * (g[:, :k] + s[:, :k]))
            hn = s[:, k:] + c
            n = np.tanh(g[:, k:] + f * hn)
            steps.append((t, h, f, hn, n))
            h = h + f * (n - h)
        steps.append((None, h))
        return steps

    def gradients(self, data: np.ndarray, mask: np.ndarray, label: np.ndarray) -> tuple[float, dict]:
        """Mean cross-entropy over all positions (time x segments, where mask) and its gradients through time."""
        k, p, total = UNITS, self.p, mask.sum()
        runs = [self.states(data, way) for way in (0, 1)]
        out = [np.stack([runs[0][i + 1][1] for i in range(len(data))]), np.stack([runs[1][i + 1][1] for i in range(len(data))])[::-1]]
        logits = out[0] @ p["v"][0] + out[1] @ p["v"][1] + p["b"]
        logits -= logits.max(2, keepdims=True)
        e = np.exp(logits)
        prob = e / e.sum(2, keepdims=True)
        right = prob[:, np.arange(data.shape[1]), label]
        loss = float(-(np.log(right + 1e-9) * mask).sum() / total)
        d = prob
        d[:, np.arange(data.shape[1]), label] -= 1
        d *= (mask / total)[:, :, None]
        grad = {name: np.zeros_like(w) for name, w in p.items()}
        grad["b"] = d.sum((0, 1))
        for way in (0, 1):
            grad["v"][way] = np.einsum("tsk,tsn->kn", out[way], d)
            above, dh = d @ p["v"][way].T, np.zeros((data.shape[1], k), np.float32)
            u = p["u"][way]
            for t, h, f, hn, n in reversed(runs[way][:-1]):
                dh = dh + above[t]
                dn = dh * f * (1 - n * n)
                df = (dh * (n - h) + dn * hn) * f * (1 - f)
                ds = np.concatenate([df, dn * f], axis=1)
                np.add.at(grad["x"][way], data[t], np.concatenate([df, dn], axis=1))
                grad["u"][way] += h.T @ ds
                grad["c"][way] += (dn * f).sum(0)
                dh = dh * (1 - f) + ds @ u.T
        return loss, grad

    def fit(self, texts: list[bytes], labels: np.ndarray, rng: np.random.Generator, steps: int = STEPS, rate: float = RATE) -> list[float]:
        """Adam on random batches of whole windows."""
        longest = max(map(len, texts))
        data = np.zeros((longest, len(texts)), np.uint8)
        mask = np.zeros((longest, len(texts)), np.float32)
        for i, t in enumerate(texts):
            data[: len(t), i] = np.frombuffer(t, np.uint8)
            mask[: len(t), i] = 1
        m = {name: np.zeros_like(w) for name, w in self.p.items()}
        v = {name: np.zeros_like(w) for name, w in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            some = rng.integers(0, len(texts), min(BATCH, len(texts)))
            used = int(mask[:, some].any(1).sum())
            loss, grad = self.gradients(data[:used, some], mask[:used, some], labels[some])
            losses.append(loss)
            for name, w in self.p.items():
                g = np.clip(grad[name], -1, 1)
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.99 * v[name] + 0.01 * g * g
                w -= rate * (1 - step / (steps + 1)) * (m[name] / (1 - 0.9**step) / (np.sqrt(v[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return losses

    def run(self, data: np.ndarray) -> np.ndarray:
        """time x segments of bytes to position probabilities, time x languages x segments; both directions at once, in buffers that are used again."""
        k, p = UNITS, self.p
        time, n = data.shape
        # Gates go through tanh as sigmoids do; f is half of 1 + tanh, and that half is in the recurrence of the candidate.
        half = np.r_[np.full(k, 0.5), np.ones(k)].astype(np.float32)
        table = np.ascontiguousarray((p["x"] * half).transpose(0, 2, 1))
        u, c = np.ascontiguousarray((p["u"] * np.float32(0.5)).transpose(0, 2, 1)), p["c"][:, :, None] * np.float32(0.5)
        h = np.zeros((2, k, n), np.float32)
        out = np.empty((2, time, k, n), np.float32)
        g, s = np.empty((2, 2 * k, n), np.float32), np.empty((2, 2 * k, n), np.float32)
        f, new = s[:, :k], s[:, k:]
        index = data.astype(np.intp)
        for i in range(time):
            np.take(table[0], index[i], axis=1, out=g[0], mode="clip")
            np.take(table[1], index[time - 1 - i], axis=1, out=g[1], mode="clip")
            np.matmul(u, h, out=s)
            f += g[:, :k]
            np.tanh(f, out=f)
            f += 1
            new += c
            new *= f
            new += g[:, k:]
            np.tanh(new, out=new)
            new -= h
            new *= f
            new *= 0.5
            h += new
            out[0, i] = h[0]
            out[1, time - 1 - i] = h[1]
        logits = np.matmul(p["v"][0].T, out[0])
        logits += np.matmul(p["v"][1].T, out[1])
        logits += p["b"][:, None]
        logits -= logits.max(1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(1, keepdims=True)
        return logits

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Mean of the position probabilities of each whole text; a row of zeros for an empty one.

        A text's segments depend on that text only, and LANES of them are run at a time, the last ones with empty ones.
        """
        lengths = np.array([len(t) for t in texts], np.int64)
        counts = -(-lengths // SEGMENT)
        owner = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner]
        pad = WARM + SEGMENT
        data = np.frombuffer(b"".join([b"\0" * pad, *texts, b"\0" * pad]), np.uint8)
        first = pad + np.cumsum(lengths) - lengths

        def bound(nth: np.ndarray) -> np.ndarray:
            at = first[owner] + lengths[owner] * nth // np.maximum(counts[owner], 1)
            for _ in range(3):  # back to the start of a character
                at = at - ((nth > 0) & (at < (first + lengths)[owner]) & (data[at] & 0xC0 == 0x80))
            return at

        start, stop = bound(number), bound(number + 1)
        low, high = np.maximum(start - WARM, first[owner]), np.minimum(stop + WARM, (first + lengths)[owner])
        time = SEGMENT + 8 + 2 * WARM
        sums = np.zeros((len(owner), len(self.languages)), np.float64)
        step = np.arange(time)[:, None]
        for a in range(0, len(owner), LANES):
            z = min(a + LANES, len(owner))
            at = np.full(LANES, 0)
            size, begin, end = np.zeros(LANES, np.int64), np.zeros(LANES, np.int64), np.zeros(LANES, np.int64)
            at[: z - a], size[: z - a], begin[: z - a], end[: z - a] = low[a:z], (high - low)[a:z], (start - low)[a:z], (stop - low)[a:z]
            # Both directions read bytes of zero around a short segment; its own bytes stand in the middle of nothing else.
            some = np.where(step < size, data[np.minimum(at + step, len(data) - 1)], 0).astype(np.uint8)
            prob = self.run(some)
            prob *= ((step >= begin) & (step < end))[:, None, :]
            sums[a:z] = prob.sum(0, dtype=np.float64)[:, : z - a].T
        total = np.stack([np.bincount(owner, sums[:, j], len(texts)) for j in range(len(self.languages))], axis=1) if len(owner) else np.zeros((len(texts), len(self.languages)))
        return total / np.maximum(lengths, 1)[:, None]


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Network | None:
    """A network fitted to about ``per_language`` windows of each non-null language; None if there is none.

    The windows are cut between characters and drawn by a hash from the whole texts of all documents with a letter, alike
    on every run; the sample holds per_language * languages windows of WINDOW characters, however long the texts are.
    """
    has = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    windows = F.ceil(F.length(text) / WINDOW)
    sizes = {r[lang]: r["n"] for r in has.groupBy(lang).agg(F.sum(windows).alias("n")).collect()}
    if not sizes:
        return None
    share = F.create_map(*[x for l, n in sorted(sizes.items()) for x in (F.lit(l), F.lit(min(1 << 30, (per_language << 30) // n + 1)))])[F.col(lang)]
    drawn = has.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(doc_id).alias("id"), share.alias("share"), F.explode(F.sequence(F.lit(0).cast("long"), windows - 1)).alias("i"))
    drawn = drawn.select("text", "lang", "i", F.pmod(F.xxhash64("id", F.length("text"), "i"), F.lit(1 << 30)).alias("draw"), "share").where("draw < share")
    chosen = drawn.select("lang", "draw", F.substring("text", (F.col("i") * WINDOW + 1).cast("int"), F.lit(WINDOW)).alias("window"))
    rows = sorted((r["lang"], r["draw"], r["window"]) for r in chosen.collect())
    if not rows:
        return None
    return train_on([(lang, window) for lang, _, window in rows])


def train_on(rows: list[tuple[str, str]]) -> Network:
    """A network fitted to (language, window) rows."""
    languages, rng = sorted({lang for lang, _ in rows}), np.random.default_rng(SEED)
    net = Network(languages, rng)
    net.fit([w.encode() for _, w in rows], np.array([languages.index(lang) for lang, _ in rows]), rng)
    return net


def predict(docs: DataFrame, net: Network | None, text: str = "text", lang_pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` plus the predicted language and its pooled probability.

    A null text or one without a letter is UNKNOWN with score 0, as is every text if there is no network. Ties go to
    the language that sorts first. Equal texts have equal scores in any batch. Columns named like the two new ones are
    replaced; repeated rows stay; an empty table stays empty. A task holds TOGETHER bytes of texts, or one longer text,
    with some 20 bytes of work space for each byte.
    """
    body = F.when(F.col(text).rlike(r"\p{L}"), F.col(text)).cast("binary")
    if net is None:
        return docs.withColumns({lang_pred: F.lit(UNKNOWN), score: F.lit(0.0)})
    kind = StructType([StructField("lang", StringType()), StructField("score", DoubleType())])

    @trimmed
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            langs, scores = [], []
            sizes = pc.fill_null(pc.binary_length(batch), 0).to_pylist()
            a = 0
            while a < len(batch):
                z, size = a + 1, sizes[a]
                while z < len(batch) and size + sizes[z] <= TOGETHER:
                    size, z = size + sizes[z], z + 1
                texts = batch.slice(a, z - a).to_pylist()
                a = z
                shares = net.pooled([t or b"" for t in texts])
                best = shares.argmax(1)
                langs += [net.languages[b] if t else UNKNOWN for b, t in zip(best.tolist(), texts)]
                scores += [float(min(1.0, s)) if t else 0.0 for s, t in zip(shares.max(1).tolist(), texts)]
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])

    @F.arrow_udf(kind)
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from told(batches)

    kept = [c for c in docs.columns if c not in (lang_pred, score)]
    found = docs.select(F.struct(*kept).alias("doc"), judged(body).alias("judged")) if kept else docs.select(judged(body).alias("judged"))
    return found.select(*(["doc.*"] if kept else []), F.col("judged.lang").alias(lang_pred), F.col("judged.score").alias(score))


def accept(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents in which some language is found with a pooled probability of ``least``; columns are kept."""
    told = predict(docs.select(F.struct(*docs.columns).alias("doc"), F.col("text")), train(docs))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select("doc.*")
