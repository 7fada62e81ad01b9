import hashlib
import random
import re

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import substring_dedup as sd


def brute(rows, width=13):
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in words:
        if i is not None:
            for k in range(len(w) - width + 1):
                key = tuple(w[k : k + width])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - width + 1):
            if i is not None and first[tuple(w[k : k + width])] < i:
                gone.update(range(k, k + width))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["é", "Ω"]
    pick = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [pick(rng.randint(11, 50)) for _ in range(6)]
    rows = []
    for i in range(80):
        w = pick(rng.randint(0, 40))
        for _ in range(rng.randint(0, 3)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = "edit"
            w += p + pick(rng.randint(0, 9))
        rows.append((i, (" " if rng.random() < 0.8 else "\n\t").join(w)))
    rows += [(200 + k, " ".join(["a"] * (10 + 5 * k))) for k in range(4)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,stream", [(1, 200_000), (2, 40)])
def test_matches_brute_force(spark, monkeypatch, seed, stream):
    monkeypatch.setattr(sd, "STREAM_WORDS", stream)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, sd.digest(sd.remove_repeats(df)).collect()), key=str) == brute(rows)


def test_nulls_repeats_and_clashing_columns(spark):
    same = " ".join(f"x{k}" for k in range(20))
    rows = [(1, same), (1, same), (1, same + " y"), (None, same), (2, None), (3, same), (3, ""), (3, same)]
    df = spark.createDataFrame([(*r, 7, "k") for r in rows], "doc_id long, text string, n long, key string")
    assert sorted(map(tuple, sd.digest(sd.remove_repeats(df)).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert sd.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton():
    a = sd.SuffixAutomaton("abcbcad")
    assert a.longest("xbcaabcbz").tolist() == [0, 1, 2, 3, 1, 2, 3, 4, 0]
