import random
import re
import zlib
from collections import Counter

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import spelling


def brute_counts(rows, every=199):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if every and h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            out[run] += 1
    return out


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows, every=199):
    n = {w: c for w, c in brute_counts(rows, every).items() if len(w) >= 6 and c >= 5}
    links = {w: [v for v in n if v != w and abs(len(v) - len(w)) < 2 and near(w, v)] for w in n}
    form = {}
    for w, vs in links.items():
        if vs:
            v = min(vs, key=lambda v: (-n[v], v))
            if n[v] >= 5 * n[w]:
                form[w] = v

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, form.get(w), root(w), n[w], len(links[w]), n.get(form.get(w))) for w in n)


def listed(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def corpus():
    rng = random.Random(2)
    stems = ["colour", "garden", "straße", "naïvely", "Écoles", "letters", "aabbab", "permit", "÷×÷×÷×"]
    words = {}
    for stem in stems:
        word, count = stem, 4000
        for _ in range(6):
            words[word] = max(count, rng.randint(3, 7))
            at, count = rng.randrange(len(word)), count // rng.choice((2, 5, 6))
            word = rng.choice((word[:at] + word[at + 1 :], word[:at] + rng.choice("abcéÿz") + word[at:], word[:at] + rng.choice("abcéÿz") + word[at + 1 :]))
    for perm in ("".join(rng.sample("abcdefg", 7)) for _ in range(400)):
        words[perm] = 5 + rng.randrange(40)
    every = [w for w, c in words.items() for _ in range(c)]
    rng.shuffle(every)
    rows = [(k // 50, rng.choice((" ", "_", "7")).join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in every[k : k + 50])) for k in range(0, len(every), 50)]
    return [*rows, (None, "colour colour gardens"), (7, None), (8, ""), (9, "ü" * 300_000), *[(10, "q" * 5_000 + " " + "q" * 4_999)] * 5]


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, word string")
    want = brute(rows)
    assert listed(spelling.variants(df)) == want
    assert any(f is not None and f != r for _, f, r, *_ in want)
    assert max(r[4] for r in want) > 3


@pytest.mark.parametrize("hot", [1, 10, 1_000_000])
def test_busy_keys_give_the_same(spark, hot):
    rng = random.Random(hot)
    # a third of all words are one anagram class
    words = {"".join(rng.sample("abcdefgh", 8)) for _ in range(500)} | {"".join(rng.choice("abcde") for _ in range(rng.randint(6, 9))) for _ in range(1_000)}
    rows = [(k, " ".join(words)) for k in range(5)]
    got = listed(spelling.variants(spark.createDataFrame(rows, "doc_id long, text string"), every=None, hot=hot))
    assert got == brute(rows, None)


def test_counts_are_summed_over_full_tables(spark, monkeypatch):
    rows = corpus()[:200]
    monkeypatch.setattr(spelling, "TABLE", 3)
    got = {r.word: r.n for r in spelling.word_counts(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {w: c for w, c in brute_counts(rows).items() if len(w) >= 6}


def test_no_rows(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0
