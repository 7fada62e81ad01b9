import random
import re

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import license_rules, licenses

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def within(a, b):
    return b[0] <= a[0] and a[1] <= b[1]


def brute(text):
    """Every rule without keywords, over the joined words; suppression by comparing all pairs in order of strength."""
    ws = words(text)
    joined, kinds = " ".join(ws), list(license_rules.KINDS)
    found = []
    for rule in licenses.rules():
        pattern = rule.find.pattern.decode()
        found += [(kinds.index(rule.kind), -(m.end() - m.start()), rule.number, m.start(), m.end(), rule) for m in re.finditer(pattern, joined)]
    kept = []
    for d in sorted(found, key=lambda d: d[:3]):
        if not any(within(d[3:5], k[3:5]) and d[0] >= k[0] for k in kept) or d[5].kind == "base":
            kept.append(d)
    base = [(i, label) for _, label, phrase in license_rules.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in base]
    every = sorted({d[5].label for d in kept})
    score = max((license_rules.KINDS[d[5].kind] for d in kept), default=0.0)
    return len(ws), len(base), min(at, default=None), max(at, default=None), ",".join(sorted({label for _, label in base})), ",".join(every), score


def draw(pattern, rng):
    """A text that a rule should find: the pattern with its choices taken at random."""
    while m := re.search(r"\((?:\?:)?([^()]*)\)(\?)?", pattern):
        pattern = pattern[: m.start()] + ("" if m[2] and rng.random() < 0.5 else rng.choice(m[1].split("|"))) + pattern[m.end() :]
    pattern = re.sub(r"\[(.)[^]]*\]", r"\1", pattern)
    return re.sub(r"(.)\?", lambda m: m[1] if rng.random() < 0.5 else "", pattern.replace(" ~ ", rng.choice((" ", " Some Name, Inc. "))))


def samples(seed=4):
    rng = random.Random(seed)
    return [draw(pattern, rng) for _, _, _, pattern in license_rules.RULES]


def corpus():
    rng, parts = random.Random(9), samples()
    texts = [None, "", "...", "\0", "GNU General Public License", "xgnu general public license", "gnu general public licenses", "CC-BY/MIT-License, mit\nlicense", "Émit license", "mit licenseé"]
    texts += parts + [f"SPDX-License-Identifier: {t}" for t in license_rules.TAGGED]
    for _ in range(150):
        words = [rng.choice([rng.choice(parts), "and", "Copyright (c) 2020", "the MIT License", "cc by", "ünder", "--"]) for _ in range(rng.randint(1, 12))]
        texts.append(rng.choice([" ", "\n", ", "]).join(words))
    return list(enumerate(texts))


def test_matches_brute_force(spark):
    rows = [*corpus(), (None, "mit license"), (3, "...")]
    got = licenses.report(spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, rule int, detections string")).collect()
    assert [tuple(r) for r in got] == [(d, *brute(t)) for d, t in rows]


def test_every_rule_fires_and_gates_are_words_of_its_matches():
    own = licenses.rules()[len(license_rules.BASE) + len(license_rules.TAGGED) :]
    for seed in range(20):
        for rule, text in zip(own, samples(seed), strict=True):
            joined, met = licenses.words_joined(text.encode())
            assert rule.find.search(joined), (rule.number, rule.find.pattern, joined)
            assert rule.keywords <= met, (rule.keywords, joined)
    assert len({rule.label for rule in own}) > 80 and len(licenses.rules()) > 300


def test_slices_do_not_change_words():
    for _, text in corpus():
        raw = (text or "").encode()
        assert licenses.words_joined(raw, 5)[0] == licenses.words_joined(raw)[0] == " ".join(words(text)).encode()


def test_many_detections_in_one_text_and_no_rows(spark):
    text = "the mit license, " * 100_000 + "gnu general public license " + "é" * 300_000
    n, found = licenses.detections(text.encode())
    assert n == 300_005 and sum(d[5] for d in found) == 100_001 and found[-1][3] == 300_000
    assert licenses.report(spark.createDataFrame([], "doc_id long, text string")).count() == 0
