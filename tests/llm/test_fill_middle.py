import hashlib
import random
import re

import pytest

pytest.importorskip("factloom.llm")
from factloom.llm import fill_middle
from factloom.llm.fill_middle import Checkpoints

UNIT = {"points": r"(?s).", "words": r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+$", "lines": r"[^\n]*\n|[^\n]+$"}


def corpus():
    rng = random.Random(5)
    rows = [(0, None), (1, ""), (2, "a"), (3, "x<P>y"), (4, "<S"), (5, "P><S><M"), (6, "é" * 30_000), (7, "𝄞 é\n" * 5_000), (8, "\0\0"), (None, "no id at all"), (2, "a")]
    for k in range(10, 300):
        rows.append((k, "".join(rng.choice("ab <>PSM é𝄞\ń") for _ in range(rng.choice((1, 3, 40, 700))))))
    return rows


@pytest.mark.parametrize("unit", UNIT)
def test_cuts_at_every_unit(unit):
    for _, text in corpus():
        text = text or ""
        units = re.findall(UNIT[unit], text, re.A)
        raw = text.encode()
        for step, chunk in ((1, 7), (3, 64), (512, 1 << 20)):
            index = Checkpoints(raw, unit, step, chunk)
            assert (index.n, index.points) == (len(units), len(text))
            assert len(index.bytes) == -(-len(units) // step)
            for u in {0, 1, len(units) // 3, len(units) // 2, len(units) - 1, len(units)} - {-1}:
                before = "".join(units[:u])
                assert index.cut(u) == (len(before.encode()), len(before)), (text, u)


def brute(doc_id, text):
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 90:
        form, out, sizes = "plain", text, (None, None)
    else:
        p, m, s, sizes = "<P>" + text[:a], "<M>" + text[a:b], "<S>" + text[b:], (a, b - a)
        form, out = ("spm", s + p + m) if h[3] % 100 < 20 else ("psm", p + s + m)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return doc_id, n, form, *sizes, sha(out), sha(text)


def test_matches_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, output string, n int")
    got = [tuple(r) for r in fill_middle.digests(fill_middle.rearrange(df)).collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[5])
    want = sorted((brute(*r) for r in rows), key=key)
    assert sorted(got, key=key) == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}


def test_whole_words_and_round_trip(spark):
    rows = [(k, "one two  three\nfour five six ") for k in range(60)]
    found = fill_middle.rearrange(spark.createDataFrame(rows, "doc_id long, text string"), unit="words")
    back = found.select("*", fill_middle.restored(found["form"], found["output"]).alias("back")).collect()
    assert all(r.back == rows[0][1] and r.n == 7 for r in back)
    assert {r.prefix_chars for r in back} <= {None, 0, 3, 7, 14, 19, 24, 28, 29}


def test_no_rows_and_long_text(spark):
    assert fill_middle.rearrange(spark.createDataFrame([], "doc_id int, text string")).count() == 0
    text = "é𝄞a " * 1_000_000
    row = fill_middle.digests(fill_middle.rearrange(spark.createDataFrame([(11, text)], "doc_id int, text string"))).collect()[0]
    assert tuple(row) == brute(11, text)
