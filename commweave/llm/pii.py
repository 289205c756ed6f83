"""Personal data by weak supervision, with built-in functions only.

Candidates are the matches of strict and of looser patterns; looser ones are spelled-out or obfuscated forms, and numbers
inside strict matches that fail as a whole. Five labelers (check digits and ranges, gazetteer, context words, edges,
shape) look at different things and vote yes, no or nothing on each. Expectation-maximisation over the counts of vote
patterns estimates how reliable the labelers are, and its posteriors train a logistic span classifier. Both see only
counts by pattern, whose number doesn't depend on the data's size. Strict matches that pass their check always stay; the
classifier alone decides on all other candidates.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from commweave.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns. Possessive loops and starts at the edge of a run (or where the last match ended) give the same
#: matches as plain ones in linear time and without recursion.
STRICT = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: Looser patterns of the same kinds: spelled-out addresses; IPv6 and defanged IPv4; card numbers with other separators or
#: next to other digits; national numbers, international ones without a plus, numbers next to other digits.
LOOSE = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:\x20?(?:\[at\]|\(at\))\x20?[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?(?:\[dot\]|\(dot\))\x20?)[A-Za-z0-9-]{1,63}+){1,8}+|\x20at\x20[A-Za-z0-9-]{1,63}+(?:\x20dot\x20[A-Za-z0-9-]{1,63}+){1,4}+)",
    r"(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}+:){7}[0-9A-Fa-f]{1,4}+|(?:[0-9A-Fa-f]{1,4}+:){1,6}(?::[0-9A-Fa-f]{1,4}+){1,6}|[0-9]{1,3}+(?:(?:\[\.\]|\(\.\)|\x20?\[dot\]\x20?)[0-9]{1,3}+){3})(?![0-9A-Za-z:])",
    r"(?<![0-9])(?:[0-9]{4}([\x20._/-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{12,19}+)(?![0-9])",
    r"(?<![0-9+.(-])(?:(?:\+?1[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}|00[1-9][0-9]{0,2}+(?:[\x20.-][0-9]{2,4}+){2,5}+)(?![0-9]|-[0-9])",
)
#: Cheap conditions without which a pattern has no match.
NEEDS = (
    ("@", r"[0-9]\.[0-9]", r"[0-9][\x20-]?[0-9]", r"\+[0-9]"),
    (r"[\[(]at[\])]|\x20at\x20[A-Za-z0-9-]++\x20dot\x20", r":[0-9A-Fa-f]{0,4}:|[0-9][\[(\x20]", r"[0-9]{4}[\x20._/-]?[0-9]{4}[\x20._/-]?[0-9]{4}", r"[0-9]{3}[.-][0-9]{4}|00[1-9]"),
)
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Gazetteers: top-level domains, issuer prefixes, country codes.
DOMAINS = r"(?i)[.\x20)\]](com|net|org|edu|gov|info|io|biz|de|fr|es|it|nl|uk|eu|ch|at|us|ca|mx)$"
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|6011|65|35|30|36|38)"
COUNTRIES = r"^\+(1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
FOR = r"(?i)\b(e-?mail|mail|contact|write|tel|telefon|phone|mobile|call|fax|card|visa|credit|ip|host|server|address|adresse|kontakt|correo|reach)\b[^A-Za-z]*$"
AGAINST = r"(?i)(\b(version|ver|isbn|order|invoice|total|section|build|part|sha|md5|id)\b[^A-Za-z]*|[=#/])$"
BEFORE, AFTER = 24, 4
#: A candidate beyond the base is taken from this probability on.
LEAST = 0.8


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, r"[^0-9]", "")


def _checked(kind: int, match: Column) -> Column:
    """The strict kind's check of a match."""
    digits = _digits(match)
    n = F.length(digits)
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return match.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
    if kind == 2:
        return n.between(12, 19) & F.when(n <= 19, F.call_function("luhn_check", digits)).otherwise(False)
    return n.between(9, 15)


def _vote(c: Column) -> Column:
    return F.when(c, 1).otherwise(-1)


def _check(kind: int, match: Column) -> Column:
    """Check digits, ranges and numbers of digits; an email address and IPv6 have none."""
    if kind == 0:
        return F.lit(0)
    if kind == 1:
        return F.when(match.contains(":"), 0).otherwise(_vote(_checked(1, F.regexp_replace(match, r"[^0-9]+", "."))))
    return _vote(_checked(kind, match))


def _gazetteer(kind: int, match: Column) -> Column:
    """Known domains, first octets that are handed out, issuers, countries."""
    if kind == 0:
        return _vote(match.rlike(DOMAINS))
    if kind == 1:
        return _vote(match.rlike(r"^0*(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])[^0-9A-Za-z:]") | match.rlike(r"^(?i)(?:2[0-9a-f]{3}|3[0-9a-f]{3}|f[cde][0-9a-f]{2}):"))
    if kind == 2:
        return _vote(_digits(match).rlike(ISSUERS))
    return F.when(match.rlike(r"^(\+|00)"), _vote(F.regexp_replace(match, r"^(\+|00)", "+").rlike(COUNTRIES))).otherwise(0)


def _shape(kind: int, match: Column) -> Column:
    """How the match is put together: letters in an address, no leading zeros, one kind of separator, brackets in pairs."""
    if kind == 0:
        return _vote(match.rlike(r"[A-Za-z]") & match.rlike(r"[A-Za-z]{2,24}$"))
    if kind == 1:
        return _vote(~match.rlike(r"(^|[^0-9A-Fa-f])0[0-9]"))
    if kind == 2:
        between = F.regexp_replace(match, r"[0-9]+", "")
        return _vote(between == F.repeat(F.left(between, F.lit(1)), F.length(between)))
    return _vote(match.rlike(r"^[^()]*(\([0-9]+\)[^()]*)?$") & ~match.rlike(r"[\x20.-]{2}"))


_ITEM = "struct<kind:int,start:int,end:int,loose:int,ok:int,check:int,gazetteer:int,context:int,edge:int,shape:int,size:int>"
#: Matches whose places are added up one by one; the places of blocks of them come before.
BLOCK = 256


def _within(value: Column, body) -> Column:
    """body(value) with the value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _matches(text: Column, kind: int, loose: bool) -> Column:
    """Every match as a candidate with its votes, in time proportional to the text.

    Pieces between matches give positions, in code points, and context: lengths are summed by blocks of matches, then
    inside each block.
    """
    pattern = F.lit((LOOSE if loose else STRICT)[kind])
    none = F.array().cast(f"array<{_ITEM}>")

    def walk(x: Column) -> Column:
        pieces, matches = x["pieces"], x["matches"]
        blocks = F.sequence(F.lit(0), F.floor((F.size(matches) - 1) / BLOCK).cast("int"))
        inside = lambda b: F.sequence(b * BLOCK, F.least(F.size(matches), (b + 1) * BLOCK) - 1)
        length = lambda i: F.length(F.get(pieces, i)) + F.length(F.get(matches, i))
        sums = F.transform(blocks, lambda b: F.aggregate(inside(b), F.lit(0), lambda n, i: n + length(i)))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))

        def item(start: Column, i: Column) -> Column:
            match = F.get(matches, i)
            before, after = F.right(F.get(pieces, i), F.lit(BEFORE)), F.left(F.get(pieces, i + 1), F.lit(AFTER))
            ok = F.lit(0) if loose else _checked(kind, match).cast("int")
            context = F.when(before.rlike(FOR), 1).when(before.rlike(AGAINST), -1).otherwise(0)
            edge = F.when(before.rlike(r"[\p{L}0-9_=/@.-]$") | after.rlike(r"^[\p{L}0-9_=/@]"), -1).otherwise(1)
            size = F.least(F.lit(3), F.floor(F.length(match) / 8)).cast("int")
            return F.struct(F.lit(kind), start, start + F.length(match), F.lit(int(loose)), ok, _check(kind, match), _gazetteer(kind, match), context, edge, _shape(kind, match), size).cast(_ITEM)

        def block(at: Column, b: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                start = state["at"] + F.length(F.get(pieces, i))
                return F.struct((start + F.length(F.get(matches, i))).alias("at"), F.concat(state["out"], F.array(item(start, i))).alias("out"))

            return F.aggregate(inside(b), F.struct(at.alias("at"), none.alias("out")), step, lambda s: s["out"])

        found = _within(starts, lambda s: F.flatten(F.transform(blocks, lambda b: block(F.get(s, b), b))))
        return F.when(F.size(matches) > 0, found).otherwise(none)

    need = NEEDS[loose][kind]
    some = text.contains(need) if need == "@" else text.rlike(need)
    cutting = F.struct(F.split(text, (LOOSE if loose else STRICT)[kind], -1).alias("pieces"), F.regexp_extract_all(text, pattern, F.lit(0)).alias("matches"))
    return F.when(some, _within(cutting, walk)).otherwise(none)


FEATURES = ("kind", "loose", "check", "gazetteer", "context", "edge", "shape", "size")
LABELERS = ("check", "gazetteer", "context", "edge", "shape")


def reliabilities(rows: list[dict], rounds: int = 60) -> tuple[list[float], dict[str, dict[int, list[float]]]]:
    """Posterior of each vote pattern, and each labeler's chance of a vote (-1, 0, 1) given no and yes, by EM.

    rows: counts ``n`` by kind and votes. A kind has its own share of true candidates; it starts from the votes' majority.
    """
    if not rows:
        return [], {}
    votes = np.array([[r[x] for x in LABELERS] for r in rows])
    n, kind = np.array([r["n"] for r in rows], float), np.array([r["kind"] for r in rows])
    q = 1 / (1 + np.exp(-votes.sum(1).astype(float)))
    table: dict = {}
    for _ in range(rounds):
        logs = []
        for y, weight in ((0, n * (1 - q)), (1, n * q)):
            log = np.zeros(len(rows))
            for k in range(len(KINDS)):
                mine = kind == k
                log[mine] += math.log((weight[mine].sum() + 1) / (n[mine].sum() + 2))
            for j, name in enumerate(LABELERS):
                sums = np.array([weight[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + 1
                table.setdefault(name, {})[y] = (sums / sums.sum()).tolist()
                log += np.log(sums / sums.sum())[votes[:, j] + 1]
            logs.append(log)
        q = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
    return q.tolist(), table


def _design(rows: list[dict]) -> np.ndarray:
    cells = [[1.0] + [float(r["kind"] == k) for k in range(len(KINDS))] + [float(r[x]) for x in ("loose", *LABELERS)] + [float(r["size"] == s) for s in range(4)] for r in rows]
    return np.array(cells).reshape(len(rows), 1 + len(KINDS) + 1 + len(LABELERS) + 4)


def classifier(rows: list[dict], posterior: list[float], ridge: float = 0.5) -> list[float]:
    """Weights of a logistic regression on the posteriors, by Newton's method over the patterns' counts."""
    x, y = _design(rows), np.array(posterior)
    n, w = np.log1p(np.array([r["n"] for r in rows], float)), np.zeros(x.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (n * (y - p)) - ridge * w
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w + np.linalg.solve(bend, slope)
    return w.tolist()


def _logit(item: Column, w: list[float]) -> Column:
    k, total = len(KINDS), F.lit(w[0])
    for i in range(k):
        total = total + F.when(item["kind"] == i, w[1 + i]).otherwise(0.0)
    for i, name in enumerate(("loose", *LABELERS)):
        total = total + item[name] * w[1 + k + i]
    for s in range(4):
        total = total + F.when(item["size"] == s, w[1 + k + 1 + len(LABELERS) + s]).otherwise(0.0)
    return total


def spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """(doc_id, base, spans) of every row: arrays of (start, kind, end), sorted, in code points with the end exclusive.

    base: strict matches that pass their check. spans: base and the other candidates, strict or loose, to which the
    classifier gives a probability of ``least`` or more and that meet no base span; of overlapping ones the first in
    (start, kind) stays. Null and empty texts have none; repeated rows are treated alike; an empty table gives an empty
    one. The time for a very long text is proportional to its length and, for the added spans, to their number times
    that of base spans.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    every = [(k, loose) for k in range(len(KINDS)) for loose in (False, True)]
    found = docs.select(F.col(doc_id).alias("doc_id"), *(_matches(body, k, loose).alias(f"_{k}{int(loose)}") for k, loose in every))
    found = cut(found.select("doc_id", F.concat(*(F.col(f"_{k}{int(loose)}") for k, loose in every)).alias("items")))
    counts = found.select(F.explode("items").alias("i")).select("i.*").groupBy(*FEATURES).agg(F.count("*").alias("n"))
    rows = sorted((r.asDict() for r in counts.collect()), key=lambda r: [r[x] for x in FEATURES])  # 4 * 2 * 3**5 * 4 rows at most
    posterior, _ = reliabilities(rows)
    weights = classifier(rows, posterior) if rows else [0.0] * (6 + len(KINDS) + len(LABELERS))
    of = lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))
    found = found.withColumn("base", F.array_sort(F.transform(F.filter("items", lambda x: x["ok"] == 1), of)))
    limit = math.log(least / (1 - least))
    taken = F.filter("items", lambda x: (x["ok"] == 0) & (_logit(x, weights) >= limit))
    # Loose matches of what base has already are many and go by hash; the rest is compared.
    found = found.withColumn("more", F.array_except(F.transform(taken, of), F.col("base")))
    found = found.withColumn("more", F.array_sort(F.filter("more", lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1)["end"]).otherwise(F.lit(-1))
    apart = F.aggregate("more", none, lambda a, x: F.when(x["start"] >= last(a), F.concat(a, F.array(x))).otherwise(a))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", apart)).alias("spans"))


def listed(items: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    name = lambda x: F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1)
    return F.array_join(F.transform(items, lambda x: F.concat_ws(":", name(x), x["start"], x["end"])), ",")


def redact(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) of every row with each span replaced by its kind in angle brackets; overlapping spans share one replacement.

    The text's characters between spans are kept. A null text stays null.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keyed = cut(keyed)
    named = spans(keyed, "_row", "text").select(F.col("doc_id").alias("_row"), "spans")
    tag = lambda x: F.concat(F.lit("<"), F.element_at(F.array(*[F.lit(k) for k in KINDS]), x["kind"] + 1), F.lit(">"))

    def step(s: Column, x: Column) -> Column:
        gap = F.substring(F.col("text"), s["at"] + 1, F.greatest(x["start"] - s["at"], F.lit(0)))
        grown = F.when(x["start"] >= s["at"], F.concat(s["out"], gap, tag(x))).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], x["end"]).alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate("spans", start, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.greatest(F.length("text") - s["at"], F.lit(0)))))
    return keyed.join(named, "_row").select("doc_id", F.when(F.col("text").isNotNull(), whole).alias("text"))
