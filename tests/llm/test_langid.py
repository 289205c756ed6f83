import numpy as np

from commweave.llm import langid


def rows_of(n=120):
    import random

    r, sets = random.Random(1), {"aa": "ba ke lo mi".split(), "bb": "wux zyr qov hix".split(), "cc": "ñe éa ßu öi".split()}
    return [(i, " ".join("".join(r.choice(s) for _ in range(r.randint(1, 3))) for _ in range(r.randint(6, 60))), lang) for i in range(n) for lang, s in [list(sets.items())[i % 3]]]


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = langid.Network(["a", "b"], rng)
    net.p = {k: w.astype(np.float64) for k, w in net.p.items()}
    data, mask, label = rng.integers(97, 100, (5, 3)).astype(np.uint8), np.ones((5, 3)), np.array([0, 1, 1])
    mask[3:, 1] = 0
    _, grad = net.gradients(data, mask, label)
    for name, at in (("x", (0, 97, 2)), ("x", (1, 98, 11)), ("x", (0, 99, 20)), ("u", (0, 1, 3)), ("u", (1, 2, 13)), ("u", (1, 0, 19)), ("c", (0, 4)), ("v", (1, 3, 1)), ("b", (0,))):
        losses = []
        for e in (1e-3, -1e-3):
            net.p[name][at] += e
            losses.append(net.gradients(data, mask, label)[0])
            net.p[name][at] -= e
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[name][at]) < 1e-4, name


def test_fast_run_matches_the_training_states():
    rng = np.random.default_rng(1)
    net = langid.Network(["a", "b", "c"], rng)
    data = rng.integers(0, 256, (9, 4)).astype(np.uint8)
    runs = [net.states(data, w) for w in (0, 1)]
    out = [np.stack([runs[0][i + 1][1] for i in range(9)]), np.stack([runs[1][i + 1][1] for i in range(9)])[::-1]]
    logits = out[0] @ net.p["v"][0] + out[1] @ net.p["v"][1] + net.p["b"]
    prob = np.exp(logits) / np.exp(logits).sum(2, keepdims=True)
    assert np.abs(net.run(data).transpose(0, 2, 1) - prob).max() < 1e-4


def test_held_out_accuracy_and_odd_rows(docs_of):
    rows = rows_of()
    docs = docs_of(rows)
    net = langid.train(docs.where("doc_id % 4 <> 2"))
    odd = [(1000, None), (1001, ""), (1002, "12 + 34"), (1003, rows[0][1] * 300, "aa"), (1004, rows[1][1]), (1004, rows[1][1])]
    got = langid.predict(docs_of([r for r in rows if r[0] % 4 == 2] + odd), net).collect()
    right = {r[0]: r[2] for r in rows}
    held = [g for g in got if g["doc_id"] < 1000]
    assert np.mean([g["lang_pred"] == right[g["doc_id"]] for g in held]) >= 0.95
    by = {g["doc_id"]: (g["lang_pred"], g["score"]) for g in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0)
    assert by[1003][0] == "aa" and len(got) == len(held) + 6 and all(0 <= g["score"] <= 1 for g in got)
    kept = langid.accept(docs_of(rows + odd))
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} | {1003, 1004}
    assert kept.columns == docs.columns


def test_nothing_to_learn_from(docs_of):
    docs = docs_of([(1, "text", None)])
    net = langid.train(docs)
    assert net is None and langid.predict(docs, net).first()["lang_pred"] == "und"
    assert langid.predict(docs_of([]), None).count() == 0 and langid.accept(docs_of([])).count() == 0


def test_segments_pool_to_whole_texts_whatever_is_around():
    net = langid.Network(["a", "b"], np.random.default_rng(2))
    n = langid.SEGMENT
    texts = [b"x" * k for k in (1, n - 1, n, n + 1, 5000)] + [b"", ("aé€😀" * 700).encode()]
    shares = net.pooled(texts)
    assert np.abs(shares[[0, 1, 2, 3, 4, 6]].sum(1) - 1).max() < 1e-4 and shares[5].sum() == 0
    for i, t in enumerate(texts):
        assert (net.pooled([t])[0] == shares[i]).all()
        assert (net.pooled([b"other text"] * 1500 + [t] + texts)[1500] == shares[i]).all()


def test_segments_carry_the_state_of_the_text():
    """Positions next to a border say almost what they say in one run over the whole text."""
    net = langid.train_on([(l, t) for _, t, l in rows_of(300)])
    text = " ".join(t for _, t, l in rows_of(60) if l == "cc").encode()[:1500]
    whole = net.run(np.frombuffer(text, np.uint8)[:, None]).mean(0)[:, 0]
    assert np.abs(net.pooled([text])[0] - whole).max() < 2e-3


def test_scores_do_not_depend_on_partitions(docs_of):
    docs = docs_of(rows_of(90))
    net = langid.train(docs)
    one, many = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(docs.repartition(n), net).collect()} for n in (1, 13))
    assert one == many and len(one) == 90
