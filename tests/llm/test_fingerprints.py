import hashlib
import random

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import fingerprints as fp
from factloom.llm.common import WordHashes, shingles


def corpus():
    rng = random.Random(9)
    rows = [(k * 3, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 60)))) for k in range(57)]
    rows += [(500 + k, rows[k][1] + " tail") for k in range(0, 20)] + [(700, None), (701, "")]
    rng.shuffle(rows)
    return rows


def test_edited_texts_match_a_plain_loop(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r for r in fp.edited_fingerprints(df).collect()}
    ordered = [(i, t or "") for i, t in sorted(rows)]
    assert len(got) == len(rows)
    for k, (i, text) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        assert got[i].n_chars == len(text)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        own, other, following = (fp.signature(shingles(t, fp.WIDTH, WordHashes())) for t in (text, edited, after))
        assert got[i].fingerprint == own.astype(">u4").tobytes().hex()
        assert got[i].edited_fingerprint == other.astype(">u4").tobytes().hex()
        assert got[i].near_edited == (own == other).mean() and got[i].near_next == (own == following).mean()


def test_likeness_estimates_jaccard():
    words = [f"w{k}" for k in range(1000)]
    a, b = (set(shingles(" ".join(w), 5, WordHashes()).tolist()) for w in (words[:800], words[200:]))
    import numpy as np

    est = fp.likeness(*(fp.signature(np.array(sorted(x), np.uint64)) for x in (a, b)))
    assert abs(est - len(a & b) / len(a | b)) < 0.2


def test_like_pairs_are_verified(spark):
    rng = random.Random(1)
    base = [rng.choice("abcdefghijklmnop") for _ in range(300)]
    near = list(base)
    near[7] = "edit"
    rows = [(1, " ".join(base)), (2, " ".join(near)), (3, " ".join(rng.choice("qrstuvwxyz") for _ in range(300))), (4, None), (None, " ".join(base))]
    got = fp.like_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.representative, r.doc_id) for r in got] == [(1, 2)] and 0.9 < got[0].jaccard < 1


def test_one_row_nulls_repeats_and_no_rows(spark):
    one = fp.edited_fingerprints(spark.createDataFrame([(5, "abcd", 1)], "doc_id long, text string, n_chars long")).first()
    assert (one.n_chars, one.edited_sha256) == (4, hashlib.sha256(b"abab").hexdigest())
    df = spark.createDataFrame([(None, None), (1, "x y"), (1, "x y"), (2, "")], "doc_id long, text string")
    assert fp.edited_fingerprints(df).count() == 4
    assert fp.edited_fingerprints(df.limit(0)).count() == 0


def test_like_pairs_behind_siblings_and_shared_ids(spark):
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 99)) for _ in range(300)]
    rows = []
    for k in range(60):
        words = list(base)
        for p in range(k % 30, 300, 30):
            words[p] = f"s{k}"
        rows.append((k, " ".join(words)))
    near = list(base)
    near[7] = "edit"
    rows += [(100, " ".join(base)), (101, " ".join(near)), (102, " ".join(base).upper()), (103, "one text of this id here"), (103, " ".join(near) + " end")]
    got = {(r.representative, r.doc_id): r.jaccard for r in fp.like_pairs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (100, 101) in got and got[100, 102] == 1.0 and any(103 in pair for pair in got)
    sets = {i: set(shingles(t, fp.WIDTH, WordHashes()).tolist()) for i, t in rows}
    assert all(len(sets[a] & sets[b]) == pytest.approx(j * len(sets[a] | sets[b])) and j >= 0.8 for (a, b), j in got.items())
