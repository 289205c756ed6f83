import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pytest

from commweave.llm import ctw


def kt(a, b):
    p = 1.0
    for n, (x, y) in enumerate([(i, 0) for i in range(a)] + [(a, i) for i in range(b)]):
        p *= ((x if n < a else y) + 0.5) / (n + 1)
    return p


def brute(train, texts):
    """log10 probability of each text from the textbook recursion, in plain floats."""
    counts = defaultdict(lambda: [0, 0])
    children = defaultdict(set)

    def decisions(text):
        s = [10] * ctw.DEPTH + list(b"".join(w + b" " for w in (text or "").encode().lower().split())) + [10]
        for i in range(ctw.DEPTH, len(s)):
            past = tuple(s[i - ctw.DEPTH : i])
            for level in range(8):
                yield past, (1 << level) | (s[i] >> (8 - level)), s[i] >> (7 - level) & 1

    for text in train:
        for past, node, bit in decisions(text):
            for d in range(ctw.DEPTH + 1):
                c = past[ctw.DEPTH - d :]
                counts[c, node][bit] += 1
                if d:
                    children[c[1:], node].add(c)

    def weighted(c, node):
        own = kt(*counts[c, node])
        if len(c) == ctw.DEPTH:
            return own
        return (own + math.prod(weighted(x, node) for x in children[c, node])) / 2

    def chance(past, node, bit):
        p = None
        for d in range(ctw.DEPTH, -1, -1):
            c = past[ctw.DEPTH - d :]
            if (c, node) not in counts:
                continue
            a, b = counts[c, node]
            own = ((b if bit else a) + 0.5) / (a + b + 1)
            if p is None:
                p = own
            else:
                below = math.prod(weighted(x, node) for x in children[c, node])
                w = kt(a, b) / (kt(a, b) + below)
                p = w * own + (1 - w) * p
        return 0.5 if p is None else p

    return [sum(math.log10(chance(*x)) for x in decisions(t)) for t in texts]


TRAIN = ["abab ba", "abc ab abc", "b", None, "Abcabcabc  b\nab", "la le la"]
OTHER = ["", "ab abc", "zzz b", "é ab", "abcabcabx", "ba abab", "abab ba"]


@pytest.mark.parametrize("cut_at", [2, 3, 4, 5])
def test_scores_match_the_recursion(docs_of, cut_at):
    rows = list(enumerate(TRAIN + OTHER))
    docs = docs_of(rows).selectExpr("*", f"doc_id >= {len(TRAIN)} as held_out")
    got = {r["doc_id"]: r for r in ctw.score_texts(docs, "held_out", cut_at=cut_at, hot=[0, 5, 100, ctw.HOT][cut_at - 2]).collect()}
    for (d, t), want in zip(rows, brute(TRAIN, TRAIN + OTHER)):
        assert got[d]["score"] == pytest.approx(want, rel=1e-9), t
        size = len(ctw.spelled((t or "").encode()))
        assert got[d]["bits_per_byte"] == pytest.approx(-want * math.log2(10) / size)
    assert got[len(rows) - 2]["score"] != pytest.approx(got[len(rows) - 1]["score"], rel=1e-6)  # word order counts


def test_keys_and_next_bytes():
    texts = [ctw.spelled(b"hello  Help"), ctw.spelled(None)]
    keys = ctw.events(texts)
    assert texts == [b"hello help \n", b"\n"] and len(keys) == 13
    s = b"\n" * ctw.DEPTH + texts[0]
    assert int(keys[8]) == int.from_bytes(s[8 : 8 + ctw.DEPTH][::-1] + s[8 + ctw.DEPTH : 9 + ctw.DEPTH], "big")
    next_bytes = (keys[8] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    ids, where = np.unique(np.r_[keys, next_bytes], return_inverse=True)
    f = ctw.Forest(ids, np.bincount(where[:13], minlength=len(ids)), 1)
    p = 10 ** f.log10(*(np.array([x] * len(f.node)) for x in ctw.ABOVE))
    assert p[where[13:]].sum() == pytest.approx(1)


def test_log_gamma():
    x = np.array([0.5, 1, 1.5, 7.9, 8, 100.5, 1e9])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_base_counts_and_small_groups(docs_of, prose, monkeypatch):
    monkeypatch.setattr(ctw, "FLUSH_EVENTS", 500)
    monkeypatch.setattr(ctw, "FLUSH_TOKENS", 2000)
    monkeypatch.setattr(ctw, "TOGETHER", 700)
    rows = [(i, prose(12, i)) for i in range(30)] + [(50, None), (51, ""), (52, "Unseen WORDS"), (52, "Unseen WORDS"), (53, "x" * 50_000), (None, "null id")]
    docs = docs_of(rows).selectExpr("*", "doc_id % 7 = 2 or doc_id = 52 as held_out")
    got = ctw.score_texts(docs, "held_out", often=4, hot=50, group=20).collect()
    whole = ctw.score_texts(docs, "held_out").collect()
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    out = lambda d: d is not None and (d % 7 == 2 or d == 52)
    train = Counter(w for d, t in rows if not out(d) for w in words(t))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(whole) == len(rows)
    by, other = {r["doc_id"]: r for r in got}, {r["doc_id"]: r for r in whole}
    for d, t in rows:
        w, r = words(t), by[d]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out(d), len(w), sum(x in train for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((train[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(other[d]["score"], rel=1e-9)


def test_no_rows_and_no_training_rows(docs_of):
    empty = docs_of([]).selectExpr("*", "false as held_out")
    assert ctw.score_texts(empty, "held_out").count() == 0
    r = ctw.score_texts(docs_of([(1, "ab")]).selectExpr("*", "true as held_out"), "held_out").first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 0, 0) and r["score"] == pytest.approx(-32 * math.log10(2))


def test_events_take_little_memory_for_each_byte():
    text = ctw.spelled(b"some words of a long text " * 40_000)
    tracemalloc.start()
    try:
        assert len(ctw.events([text])) == len(text)
        assert tracemalloc.get_traced_memory()[1] < 22 * len(text)  # 8 are the keys
    finally:
        tracemalloc.stop()
