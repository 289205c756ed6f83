import random

import pytest
from commweave.llm import nearcopies
from commweave.llm.simhash import deduplicate, fingerprint


def shingles(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets, parent = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) * 10 >= 8 * len(a | b):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("sample", [1, 16])
def test_components_match_brute_force(docs_of, prose, monkeypatch, sample):
    monkeypatch.setattr(nearcopies, "SAMPLE", sample)
    r, line = random.Random(5), prose(15, 77)
    rows = [(i, prose(r.randint(3, 120), i) + (" " + line if i % 2 else "")) for i in range(40)]
    for i in range(120):
        w = r.choice(rows)[1].split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = r.choice(["zz", "yy"])
        rows.append((100 + i, " ".join(w[r.randint(0, 2) :])))
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one two"), (304, "One  two")]
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(docs_of(rows)).collect()}
    assert got == brute(rows)


def test_deduplicate_takes_five_words_and_similarity(docs_of, prose):
    rows = []
    for i in range(30):
        w = prose(100, i).split()
        near, far = [*w], [*w]
        near[50] = "zz"  # 91 of 101 shingles are shared
        far[20] = far[50] = far[80] = "zz"  # 81 of 111
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(near)), (3 * i + 2, " ".join(far))]
    bits = [(fingerprint(a.encode()) ^ fingerprint(b.encode())) % 2**64 for (_, a), (_, b) in zip(rows[::3], rows[1::3])]
    assert max(x.bit_count() for x in bits) > 4
    assert {x["doc_id"] for x in deduplicate(docs_of(rows)).collect()} == {d for d, c in brute(rows).items() if d == c}
    assert not {d for d, c in brute(rows).items() if d == c} & set(range(1, 90, 3))


@pytest.mark.parametrize("radius", [0, 3, 10])
def test_simhash_makes_components_and_prefixes_complete_them(docs_of, prose, monkeypatch, radius):
    r, rows, found = random.Random(9), [], []
    links = nearcopies.links
    monkeypatch.setattr(nearcopies, "links", lambda prints, **k: found.append((k["radius"], links(prints, **k).count())) or links(prints, **k))
    for g in range(4):  # each copy of a text is edited in places of its own
        w = prose(150, g).split()
        for i in range(25):
            x = [*w]
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = f"z{r.randrange(99)}"
            rows.append((len(rows), " ".join(x)))
    got = {x["doc_id"]: x["component_id"] for x in nearcopies.near_copies(docs_of(rows), radius=radius).collect()}
    assert got == brute(rows)
    assert found[0][0] == radius and (found[0][1] >= 40 or radius < 10)
