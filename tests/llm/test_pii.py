import re

from commweave.llm import pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(text):
    found = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email") or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 12 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15):
                found.append((m.start(), k, m.end()))
    return sorted(found)


TEXTS = [
    "mail a.b+c%d@x-y.example.com, then z@b.c%q@e.f and @no.where or x@y",
    "é😀 ip 1.2.3.4 at 256.1.1.1, 1.2.3.4.5.6.7.8 and 001.02.3.0255 v1.2.3",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111  1111 and 0000 0000 0000",
    "call +1 (555) 010-9999 or +49.30.1234567890123456 or +12 34) +1+23456789",
    "4111111111111111@x.com 10.0.0.1@host.org +1 2 3 4 5 6 7 8 9 0",
    "1 " * 30_000,
    "a" * 60_000 + " " + "b." * 5_000 + "@x",
    "a@" + "b." * 6_000 + "c",
    "1." * 9_000,
    "+1" * 9_000,
    "",
    None,
]


def test_base_spans_match_plain_patterns(docs_of):
    rows = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (None, TEXTS[1])]
    got = pii.spans(docs_of(rows)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: [tuple(x) for x in r["base"]] for r in got}
    for d, t in rows:
        assert by[d] == base(t), d
    assert all(set(map(tuple, r["base"])) <= set(map(tuple, r["spans"])) for r in got)


def test_random_strings_match_plain_patterns(docs_of):
    import random

    r = random.Random(5)
    rows = [(i, "".join(r.choice("ab1234590.@+-() é") for _ in range(80))) for i in range(300)]
    got = {x["doc_id"]: [tuple(s) for s in x["base"]] for x in pii.spans(docs_of(rows)).collect()}
    assert got == {d: base(t) for d, t in rows}


def planted():
    """Texts with data that plain patterns miss, and texts with numbers that are none: (doc_id, text, kind or None)."""
    import random

    r = random.Random(11)
    rows, n = [], 1000

    def card():
        digits = "4" + "".join(r.choice("0123456789") for _ in range(14))
        return next(digits + c for c in "0123456789" if luhn(digits + c))

    for i in range(40):
        a, b, c = card(), card(), f"{r.randrange(200, 999)}"
        rows += [
            (n, f"Please write an email to jane{i} [at] mail{i % 7} [dot] com for details.", 0),
            (n + 1, f"contact bob{i} at host{i % 5} dot org now", 0),
            (n + 2, f"the server 10[.]2[.]{i}[.]{i + 1} was seen, host 2001:db8:{i + 1}:0:0:8a2e:370:7334 too", 1),
            (n + 3, f"paid with card {a} {b} today", 2),
            (n + 4, f"visa {a[:4]}/{a[4:8]}/{a[8:12]}/{a[12:]} was used", 2),
            (n + 5, f"phone ({c}) 555-{1000 + i} or call {c}.555.{2000 + i} please", 3),
            (n + 6, f"order {r.randrange(10**15, 10**16 - 1) // 10}{(int(a[-1]) + 1) % 10}", None),
            (n + 7, f"version {i}.{i}.{i} of build 12:{i + 10}:45, section {i}-{i + 3}, sha {a[:9]}abc{b[:9]}", None),
            (n + 8, f"part {c}/{c}-{i} and id={a}", None),
        ]
        n += 9
    return rows


def test_recall_and_precision_of_what_the_method_adds(docs_of):
    """With ordinary data around; the figures are in the README."""
    rows = [(i, f"Please call +1 (555) 010-{1000 + i} or mail user{i}@mail.example.com now, host 10.1.2.{i} up, card 4111 1111 1111 1111.") for i in range(60)]
    rows += [(100 + i, f"order {i}.300.2.9999 of section 9.{i}.700.1 and id 4111 1111 1111 {1000 + i}") for i in range(40)]
    plan = planted()
    docs = docs_of(rows + [(d, t) for d, t, _ in plan])
    got = {r["doc_id"]: r for r in pii.spans(docs).collect()}
    extra = {d: [tuple(x) for x in r["spans"] if x not in r["base"]] for d, r in got.items()}
    found = [d for d, t, kind in plan if kind is not None and any(k == kind for _, k, _ in extra[d])]
    wrong = sum(len(extra[d]) for d, _, kind in plan if kind is None) + sum(len(extra[d]) for d, _ in rows)
    right = sum(k == kind for d, _, kind in plan if kind is not None for _, k, _ in extra[d])
    recall, precision = len(found) / sum(k is not None for *_, k in plan), right / (right + wrong)
    print(f"recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.8 and precision >= 0.95
    without = {r["doc_id"]: r for r in pii.spans(docs, least=1 - 1e-12).collect()}
    assert any(len(without[d]["spans"]) < len(r["spans"]) for d, r in got.items())
    text = pii.redact(docs).where("doc_id = 0").first()["text"]
    assert text == "Please call <phone> or mail <email> now, host <ip> up, card <card>."


def test_labelers_and_places(docs_of):
    text = "é Please call (555) 010-1234, card 4111/1111/1111/1111; mail joe [at] mail [dot] com; 4111111111111111 4111111111111112"
    rows = docs_of([(1, text)])
    from pyspark.sql import functions as F

    items = {(k, loose): rows.select(pii._matches(F.col("text"), k, loose).alias("x")).first()["x"] for k in range(4) for loose in (False, True)}
    at = {key: [text[x["start"] : x["end"]] for x in v] for key, v in items.items()}
    assert at[0, True] == ["joe [at] mail [dot] com"] and at[3, True] == ["(555) 010-1234"]
    assert at[2, True] == ["4111/1111/1111/1111", "4111111111111111", "4111111111111112"] and at[2, False][-1] == "4111111111111111 4111111111111112"
    assert [x["check"] for x in items[2, True]] == [1, 1, -1] and items[2, True][0]["context"] == 1
    assert all(x["ok"] == 0 for (_, loose), v in items.items() if loose for x in v)


def test_many_matches_in_one_text(docs_of):
    import time

    text = "x 4111111111111111, a@b.cd " * 16_000
    began = time.time()
    (r,) = pii.spans(docs_of([(1, text)])).collect()
    assert len(r["base"]) == 32_000 and [tuple(x) for x in r["base"][-2:]] == [(431_975, 2, 431_991), (431_993, 0, 431_999)]
    assert time.time() - began < 60


def test_reliabilities_find_the_better_labeler():
    rows = []
    for y in (0, 1):
        for a in (0, 1):
            for b in (0, 1):
                good, poor = (0.95 if a == y else 0.05), (0.6 if b == y else 0.4)
                rows.append({"kind": 0, "check": 2 * a - 1, "gazetteer": 2 * b - 1, "context": 0, "edge": 0, "shape": 2 * a - 1, "n": round(1000 * good * poor)})
    q, table = pii.reliabilities(rows)
    assert table["check"][1][2] - table["check"][0][2] > table["gazetteer"][1][2] - table["gazetteer"][0][2]
    assert all(0 <= x <= 1 for x in q) and pii.reliabilities([]) == ([], {})


def test_no_rows(docs_of):
    assert pii.spans(docs_of([])).count() == 0 and pii.redact(docs_of([])).count() == 0
    assert pii.redact(docs_of([(1, None)])).first()["text"] is None
