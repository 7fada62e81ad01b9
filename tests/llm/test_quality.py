import random

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import quality as ql


def texts(n, seed):
    rng = random.Random(seed)
    out, labels = [], []
    for k in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 200))]
        kind = k % 4
        if kind == 1:
            words = [w + "###" for w in words]
        if kind == 2 and k % 8 == 2:
            words = words[:1] * len(words)
        out.append(" ".join(words) + ".")
        labels.append(kind != 1 and not (kind == 2 and k % 8 == 2))
    return out, np.array(labels, float)


def test_held_out_accuracy_and_pairs():
    found, labels = texts(400, 1)
    model = ql.AdditiveModel(ql.matrix(found), labels)
    found, labels = texts(200, 2)
    assert ((model.scores(ql.matrix(found)) >= ql.THRESHOLD) == labels).mean() > 0.97


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = ql.AdditiveModel(x, y)
    assert (0, 1) in model.pairs
    assert ((model.scores(x) > 0.5) == y).mean() > 0.85


def test_scores_are_sums_of_lookups():
    found, labels = texts(120, 3)
    x = ql.matrix(found)
    model = ql.AdditiveModel(x, labels)
    for row, got in zip(x[:20], model.scores(x[:20])):
        f = model.base
        for k, (cuts, table) in enumerate(zip(model.cuts, model.tables)):
            f += table[sum(c <= row[k] for c in cuts)]
        for (a, b), grid in zip(model.pairs, model.grids):
            f += grid[sum(c <= row[a] for c in model.coarse[a]), sum(c <= row[b] for c in model.coarse[b])]
        assert abs(1 / (1 + np.exp(-f)) - got) < 1e-9


def test_edges(spark):
    found, labels = texts(60, 4)
    rows = [(k, t) for k, t in enumerate(found)] + [(None, "x"), (5, found[5]), (900, None), (901, ""), (902, "é" * 30000)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, label string")
    marks = spark.createDataFrame([(k, int(y), 1) for k, y in enumerate(labels)] + [(None, 1, 1), (3, None, 1)], "doc_id long, quality int, text int")
    got = ql.report(docs, marks).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by = {r.doc_id: r.score for r in got}
    assert by[900] == by[901]
    assert ql.report(docs.limit(0), marks).count() == 0
    assert {r.score for r in ql.report(docs, marks.limit(0)).collect()} == {0.5}
