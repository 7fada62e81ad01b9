import random

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import toxicity as tx


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    out, labels = [], []
    for k in range(n):
        own = [rng.choice(words) for _ in range(rng.choice((5, 30, 200)))]
        label = k % 4 == 0
        if label:
            for _ in range(2):
                own.insert(rng.randrange(len(own)), rng.choice(("Nasty!", "vile", "grim,", "bad" + rng.choice(words))))
        out.append(" ".join(own))
        labels.append(label)
    return out, np.array(labels, np.float32)


@pytest.fixture(scope="module")
def net():
    return tx.train(*texts(400, 1))


def test_held_out_accuracy(net):
    found, labels = texts(200, 2)
    scores = tx.Scorer(net).scores(found)
    assert ((scores >= tx.THRESHOLD) == labels).mean() > 0.95


def test_windows_overlap_and_cover_all():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        starts = tx.spans(n)
        covered = {k for s in starts for k in range(s, min(s + tx.WINDOW, n))}
        assert covered == set(range(n))
        assert all(b - a < tx.WINDOW for a, b in zip(starts, starts[1:]))


def test_scoring_pass_equals_training_pass(net):
    words = ["w1", "vile", "bad", "", "é", "x" * 50]
    table = net.table(net.inputs(*net.features(words)))
    at = np.random.default_rng(0).integers(1, 7, (5, 12))
    at[2, 6:] = 0
    np.testing.assert_allclose(net.rate(table, at), net.forward(table, at), rtol=1e-4, atol=1e-5)
    cut = net.rate(table, at[2:3, :6])
    np.testing.assert_allclose(net.rate(table, at[2:3]), cut, rtol=1e-4, atol=1e-5)


def test_gradients_match_differences(net):
    words = net.features(["w1", "vile", "grim", "unseen"])
    at, y = np.array([[1, 2, 3], [4, 1, 0]]), np.array([1.0, 0.0], np.float32)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    kept, net.p = net.p, p

    def loss():
        s = 1 / (1 + np.exp(-net.forward(net.table(net.inputs(*words)), at).astype(float)))
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    try:
        grads = net.gradients(at, y, words)
        for name in p:
            place = np.unravel_index(np.abs(grads[name]).argmax(), p[name].shape)
            was = p[name][place]
            p[name][place] = was + 1e-2
            up = loss()
            p[name][place] = was - 1e-2
            down = loss()
            p[name][place] = was
            assert abs((up - down) / 2e-2 - grads[name][place]) < 2e-3 + 0.05 * abs(grads[name][place]), name
    finally:
        net.p = kept


def plain_logit(net, words):
    """The network word by word in plain loops, for one window."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, h = {k: v.astype(float) for k, v in net.p.items()}, tx.HIDDEN
    gates = []
    for word in words:
        runs = [sum(p["char"][int(x) % tx.RUNS] for x in column) for column in tx.grams([word])[0]]
        own = p["word"][net.vocabulary[word]] if word in net.vocabulary else np.zeros(tx.EMBED)
        gates.append(np.concatenate([own, sum(runs) / len(runs) ** 0.5]) @ p["in"] + p["bias"])
    ways = []
    for way, order in ((0, range(len(words))), (1, range(len(words) - 1, -1, -1))):
        state, states = np.zeros(h), [None] * len(words)
        for t in order:
            g, r = gates[t][way * 3 * h : (way + 1) * 3 * h], state @ p["back"][way]
            reset, update = sigmoid(g[:h] + r[:h]), sigmoid(g[h : 2 * h] + r[h : 2 * h])
            new = np.tanh(g[2 * h :] + reset * r[2 * h :])
            state = states[t] = (1 - update) * new + update * state
        ways.append(states)
    both = [np.concatenate([ways[0][t], ways[1][t]]) for t in range(len(words))]
    look = np.array([s @ p["look"] for s in both])
    weight = np.exp(look - look.max())
    return sum(w * (s @ p["out"]) for w, s in zip(weight / weight.sum(), both)) + p["base"][0]


def test_scores_equal_plain_loops_over_all_windows_of_whole_texts(net):
    found = texts(12, 9)[0] + [" ".join(texts(3, 11)[0]), "vile", "?!  Nasty", "   "]
    got = tx.Scorer(net).logits(found)
    for text, logit in zip(found, got, strict=True):
        words = [tx.normal(w) for w in text.lower().split()]
        starts = {s for s in range(0, max(len(words) - tx.WINDOW, 1), tx.STRIDE)} | {max(len(words) - tx.WINDOW, 0)}
        want = max(plain_logit(net, words[s : s + tx.WINDOW]) for s in starts) if words else -np.inf
        np.testing.assert_allclose(logit, want, rtol=2e-3, atol=2e-3)


def test_whole_texts_count_and_edges(spark, net):
    long = " ".join(["w1"] * 5000 + ["vile", "nasty"] + ["w2"] * 30)
    rows = [(1, long, 7), (2, None, 7), (3, "", 7), (None, "vile nasty vile", 7), (1, long, 7), (4, "w1 w2", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {r.doc_id: r.score for r in tx.score(docs, net).collect()}
    assert got[1] >= tx.THRESHOLD and got[None] >= tx.THRESHOLD and got[2] == got[3] == 0 and got[4] < tx.THRESHOLD
    assert sorted(r.doc_id for r in tx.reject(docs, net).collect()) == [2, 3, 4]
    assert tx.reject(docs, net).columns == docs.columns
    assert tx.score(docs.limit(0), net).count() == 0
    report = tx.report(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert report.columns == ["doc_id", "held_out", "score", "predicted"] and report.count() == 0


def test_learns_no_held_out_label(spark):
    found, labels = texts(80, 3)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(found)], "doc_id long, text string")
    rows = [(k, int(y)) for k, y in enumerate(labels)] + [(None, 1), (3, None)]
    import zlib

    flipped = [(k, 1 - y if k is not None and y is not None and zlib.crc32(str(k).encode()) % 4 == 2 else y) for k, y in rows]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, toxic int")
    a, b = (sorted((r.doc_id, r.held_out, r.score) for r in tx.report(docs, frame(r)).collect()) for r in (rows, flipped))
    assert a == b
