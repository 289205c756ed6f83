import random
from itertools import product

import pytest

from commweave.llm import chat


def brute(roles):
    """Cheapest cost over all ways to merge or relabel each turn and to insert empty ones."""
    best = None

    def close(s, cost):
        nonlocal best
        cost += chat.closing(s)[0]
        best = cost if best is None or cost < best else best

    def walk(i, s, cost):
        if best is not None and cost >= best:
            return
        if i == len(roles):
            return close(s, cost)
        for t in (1, 2, 3):
            relabel = 0 if roles[i] == t else chat.RELABEL
            if s == t:
                walk(i + 1, t, cost + relabel + chat.MERGE)
            for n in range(3):
                for way in product((1, 2, 3), repeat=n):
                    x, fine = s, True
                    for r in way:
                        fine, x = fine and r in chat.LEGAL[x], r
                    if fine and t in chat.LEGAL[x]:
                        walk(i + 1, t, cost + relabel + n * chat.INSERT)

    walk(0, 0, 0)
    return best


@pytest.mark.parametrize("n", range(1, 5))
def test_costs_match_brute_force(n):
    for roles in product(range(4), repeat=n):
        assert chat.route([chat.costs(list(roles))])[1] == brute(roles), roles


def legal(rendered):
    roles = [chat.ROLES.index(p.split("\n", 1)[0]) + 1 for p in rendered.split(chat.OPEN)[1:]]
    s = 0
    for r in roles:
        assert r in chat.LEGAL[s]
        s = r
    assert s in chat.ACCEPTING and rendered.endswith(chat.CLOSE) and rendered.count(chat.CLOSE) == len(roles)
    return roles


SCHEMA = "conv_id long, turn long, role string, text string, cost string, block string, m string, a string"


def make(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA)


def test_conversations(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "a"),
        (2, 0, "user", "one"), (2, 1, "user", "two"),
        (3, 0, "assistant", "hi"),
        (4, 0, "system", None),
        (5, 0, "Human", "q"), (5, 1, "GPT", "a"), (5, 2, "tool", "?"),
        (6, 5, "user", "late"), (6, 9, "assistant", "last"), (6, 3, "system", "first"),
        (None, 0, "user", "<|im_end|>"),
        (7, 0, "user", "same"), (7, 0, "user", "same"),
        (8, 5, "user", "late"), (8, None, "assistant", "last"), (8, -3, "system", "first"),
    ]
    rows += [(9, 1023, "user", "q"), (9, 1024, "assistant", "a"), (10, 1_700_000_000, "user", "x" * 300_000), (10, 1_800_000_000, "assistant", "a")]
    parts = chat.repair(make(spark, rows)).collect()
    got = {r["conv_id"]: r for r in parts}
    assert len(got) == 11 and len(parts) == 11
    assert legal(got[8]["rendered"]) == [1, 2, 3] and legal(got[9]["rendered"]) == legal(got[10]["rendered"]) == [2, 3]
    assert got[1]["rendered"] == "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n" and got[1]["cost"] == 0
    assert got[2]["ops"] == "keep,merge" and "one\ntwo" in got[2]["rendered"] and got[2]["cost"] == 1
    assert got[3]["ops"] == "insert:user,keep" and got[3]["n_messages"] == 2
    assert got[4]["ops"] == "keep,insert:user"
    assert got[5]["cost"] == 3 and got[5]["ops"] == "keep,keep,relabel:user"
    assert got[6]["ops"] == "keep,keep,keep" and got[6]["rendered"].index("late") < got[6]["rendered"].index("last")
    assert got[None]["rendered"].count("<|") == 2
    assert got[7]["n_turns"] == 2
    for r in got.values():
        legal(r["rendered"])
    assert chat.repair(make(spark, [])).count() == 0


def test_blocks_give_the_whole_conversations_repair(spark):
    r = random.Random(8)
    rows = [(c, i, r.choice(["system", "user", "assistant", "odd", None]), f"t{i}") for c in range(6) for i in range(40)]
    parts = sorted(chat.repair(make(spark, rows), block=7).collect(), key=lambda x: (x["conv_id"], x["segment"]))
    for c in range(6):
        mine = [p for p in parts if p["conv_id"] == c]
        assert len(mine) == 6 and sum(p["n_turns"] for p in mine) == 40
        whole = "".join(p["rendered"] for p in mine)
        assert len(legal(whole)) == sum(p["n_messages"] for p in mine)
        roles = [chat.code(x[2]) for x in rows if x[0] == c]
        assert mine[0]["cost"] == chat.route([chat.costs(roles)])[1]
        done = sum({"keep": 0, "merge": 1, "insert": 2, "relabel": 3}[o.split(":")[0]] + 3 * (o.startswith("merge:")) for p in mine for o in p["ops"].split(",") if o)
        assert done == mine[0]["cost"]
