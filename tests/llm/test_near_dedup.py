import random
import re

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import near_dedup as nd
from factloom.llm.components import components


def brute(rows, width, percent):
    def items(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) < width:
            return {tuple(words)} if words else set()
        return {tuple(words[k : k + width]) for k in range(len(words) - width + 1)}

    sets = {i: items(t) for i, t in rows}
    least = {i: i for i in sets}
    ids = sorted(sets)
    for _ in range(len(ids)):
        before = dict(least)
        for x in ids:
            for y in ids:
                both = len(sets[x] & sets[y])
                if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                    least[x] = least[y] = min(least[x], least[y])
        if before == least:
            break
    return {i: (len(sets[i]), least[i], least[i] == i) for i in ids}


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(30, 120))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 9)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append("  ".join(copy).upper() if rng.random() < 0.2 else "\n".join(copy))
    rows += ["", "  \t", "one", "one", "one two", "ONE", "é É"]
    return list(enumerate(rows))


def got(spark, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in nd.near_duplicates(df, **more).collect()}


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
def test_matches_brute_force(spark, width, percent):
    rows = corpus()
    assert got(spark, rows, width=width, percent=percent) == brute(rows, width, percent)


@pytest.mark.parametrize("block", [1, 2, 4])
def test_blocks_of_a_large_bucket(spark, monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rows = corpus(5)
    assert got(spark, rows, width=3, percent=85) == brute(rows, 3, 85)


def test_nulls_repeats_and_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9), (1, "a b c d e f", 9), (None, "a b c d e f", 9), (2, None, 9), (None, None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id long")
    out = sorted(map(tuple, nd.near_duplicates(df).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, 1, True), (2, 0, 2, True), (None, 0, None, True)], key=str)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert nd.near_duplicates(df).count() == 0


def test_registers_merge_and_estimate():
    rng = np.random.default_rng(0)
    items = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    a, b = items[:2000], items[500:]
    ra, rb = nd.registers(a), nd.registers(b)
    assert (nd.merge(ra, rb) == nd.registers(items)).all()
    est = nd.likelihood_jaccard(np.array([(ra < rb).sum()]), np.array([(ra > rb).sum()]), np.array([2000.0]), np.array([2500.0]))[0]
    assert abs(est - 0.5) < 0.1


def test_labels_of_nodes_that_are_elsewhere():
    parent = {5: 3, 6: 3, 7: 2}
    assert [nd._root(parent, x) for x in (5, 6, 7, 8)] == [3, 3, 2, 8]
    parent[nd._root(parent, 5)] = nd._root(parent, 7)
    assert {nd._root(parent, x) for x in (5, 6, 7, 3)} == {2}
    chain = {k: k + 1 for k in range(9)}
    assert {nd._root(chain, k) for k in (0, 4, 2, 1, 0, 8)} == {9}


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    assert {r.node: r.label for r in components(edges).collect()} == {**{k: 0 for k in range(61)}, 100: 100, 101: 100}
