import random

import numpy as np
import pytest
import xxhash

from commweave.llm import simhash
from commweave.llm.graph import connected_components


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(pairs):
    parent = {d: d for d, _ in pairs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, fa) in enumerate(pairs):
        for b, fb in pairs[:i]:
            if (fa ^ fb).bit_count() <= 4 and (x := find(a)) != (y := find(b)):
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d, _ in pairs}


def test_fingerprints_and_components_match_brute_force(docs_of, prose):
    base = [prose(60, s) for s in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    r = random.Random(1)
    for i in range(60):  # near copies, and near copies of these
        w = r.choice(rows)[1].split()
        w[r.randrange(len(w))] = "other"
        rows.append((100 + i, " ".join(w)))
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "One"), (205, base[3]), (206, base[3].upper()), (207, "é ü " * 5000)]
    got = {x["doc_id"]: (x["fp"] % 2**64, x["component_id"]) for x in simhash.near_duplicates(docs_of(rows)).collect()}
    prints = {d: brute_fingerprint(t) for d, t in rows}
    components = brute_components(list(prints.items()))
    assert got == {d: (prints[d], components[d]) for d, _ in rows}
    assert got[200] == got[201] == got[202] == (0, got[200][1])


@pytest.mark.parametrize(("parts", "block"), [((4,), 4), ((4,), 40), ((3,), 16), ((2,), 16)])
def test_partitions_and_large_buckets_find_all_links(spark, parts, block):
    r = random.Random(2)
    prints = [r.getrandbits(64) for _ in range(20)]
    for _ in range(150):
        prints.append(r.choice(prints) ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 4))))
    prints = sorted(set(prints))
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    links = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), parts, block)
    assert links.count() < 20 * len(prints)
    labels = {x["node"] % 2**64: x["component"] % 2**64 for x in connected_components(links).collect()}
    expected = brute_components([(p, p) for p in prints])
    groups = lambda f: {frozenset(p for p in prints if f(p) == c) for c in {f(p) for p in prints}}
    assert groups(lambda p: labels.get(p, p)) == groups(lambda p: expected[p])


def test_repeated_rows_null_ids_and_empty(docs_of):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (9, "a b c d e"), (None, "a b c d e"), (None, "zz yy")]
    got = sorted(((x["doc_id"], x["component_id"]) for x in simhash.near_duplicates(docs_of(rows)).collect()), key=str)
    assert got == sorted([(5, 5), (5, 5), (9, 5), (None, 5), (None, None)], key=str)
    kept = simhash.deduplicate(docs_of(rows))
    assert sorted((x["doc_id"] for x in kept.collect()), key=str) == [5, None]
    assert simhash.near_duplicates(docs_of([])).count() == 0
    assert simhash.deduplicate(docs_of([])).columns == docs_of([]).columns


def test_allocation_is_optimal_and_uneven():
    costs = [[0, 1, 50, 900], [0, 40, 90, 999], [0, 2, 3, 5], [0, 9, 9, 9]]
    from itertools import product

    best = min(sum(c[t + 1] for c, t in zip(costs, ts)) for ts in product(range(-1, 3), repeat=4) if sum(t + 1 for t in ts) == 5)
    chosen = simhash.allocate(costs)
    assert sum(t + 1 for t in chosen) == 5 and sum(c[t + 1] for c, t in zip(costs, chosen)) == best


def test_candidate_counts_are_the_samples():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 64, 200).astype(np.int64)
    near = np.bitwise_count(values[:, None] ^ values[None])
    got = simhash.candidate_counts(values, list(range(6)), 400, 2)
    even = [400 * 400 * n / 64 for n in (1, 7, 22)]
    assert got == [pytest.approx(max(e, ((near <= t).sum() - 200) * 400 * 400 / (200 * 199))) for t, e in zip(range(3), even)]


def test_wider_partitions_for_more_fingerprints():
    rng = np.random.default_rng(1)
    sample = rng.integers(-(2**63), 2**63 - 1, 500)
    bits = simhash._bits(sample)
    widths = [max(map(len, simhash.plan(bits.T @ bits * n / 500, sample, n)[0])) for n in (10**5, 10**9, 10**13)]
    assert widths == [16, 22, 32]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (7, 7), (201, 200)], "src long, dst long")
    got = {x["node"]: x["component"] for x in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(61)} | {200: 200, 201: 200}


@pytest.mark.parametrize("shingle", [1, 4, 5])
def test_shingles_of_pieces_are_those_of_the_whole(shingle):
    from commweave.llm.common import shingle_digests

    r = random.Random(3)
    for n in (0, 1, 3, 4, 5, 6, 200):
        w = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))).encode() for _ in range(n)]
        text = b" \n" + b"".join(x + r.choice([b" ", b"  ", b"\t\n"]) for x in w)
        want = [b" ".join(w[i : i + shingle]) for i in range(max(1, n - shingle + 1))] if n else []
        for piece in (1, 7, 50, 10_000):
            got = b"".join(shingle_digests(text.upper(), shingle, 42, piece))
            assert got == b"".join(xxhash.xxh64_digest(x, 42) for x in want)
