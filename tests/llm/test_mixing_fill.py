import random

import pyarrow as pa
from pyspark.sql import functions as F

from commweave.llm.common import word_count
from commweave.llm.mixing import _fill, mix


def test_fill_takes_what_a_walk_over_single_documents_takes():
    r = random.Random(8)
    for _ in range(50):
        rows = [(r.randint(-5, 5), r.randint(0, 6), r.randint(1, 4)) for _ in range(12)]
        rows = sorted({(o, s): n for o, s, n in rows}.items())
        left = room = r.randint(0, 40)
        want = {}
        for (o, s), n in rows:
            for _ in range(n):
                if 0 < s <= left:
                    left -= s
                    want[o, s] = want.get((o, s), 0) + 1
        r.shuffle(rows)
        got = _fill(pa.table({"_cell": ["x"] * len(rows), "_order": [k[0] for k, _ in rows], "_size": [k[1] for k, _ in rows], "n": [n for _, n in rows], "_left": [room] * len(rows)}))
        assert {(x["_order"], x["_size"]): x["_taken"] for x in got.to_pylist()} == want


def test_rows_alike_are_taken_as_often_as_they_fit_and_texts_stay_out_of_python(docs_of):
    """a's ten rows of two words share 11 words out: five of them are taken."""
    rows = [(1, "one two", "en", "a")] * 10 + [(2, None, "en", "a")]
    docs = docs_of(rows)
    found = mix(docs, F.col("doc_id"), F.col("source"), word_count(F.col("text")), None, {"a": 11})
    assert sorted((r["doc_id"], r["_repeats"]) for r in found.collect()) == [(1, 0)] * 5 + [(1, 1)] * 5 + [(2, 0)]
    assert found.columns == [*(c for c in docs.columns if c != "_repeats"), "_repeats"] and dict(found.dtypes)["_repeats"] == "int"
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "FlatMapGroupsInPandas" not in plan
