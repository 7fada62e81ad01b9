import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import pytest

pytest.importorskip("factloom.llm")
from pyspark.sql import functions as F

from factloom.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def strong(w):
    if any(re.search(p, w) for p in secrets.ALLOWED):
        return False
    kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", w) else "upper" if re.fullmatch("[0-9A-Z_=+/-]+|[0-9a-z_=+/-]+", w) else "mixed"
    best = max(-sum(n / 20 * math.log2(n / 20) for n in Counter(w[k : k + 20]).values()) for k in range(len(w) - 19))
    return best >= secrets.BITS[kind] - 1e-9


def spans(text):
    found = base(text)
    inside = {k for a, _, b, _ in found for k in range(a, b)}
    out = list(found)
    for m in re.finditer(r"[A-Za-z0-9+/_=-]{20,}", text):
        # "#" stands in no candidate: what base spans cover parts its pieces
        left = "".join("#" if k in inside else text[k] for k in range(m.start(), m.end()))
        for p in re.finditer("[^#]{20,}", left):
            if strong(p[0]):
                whole = p[0] == m[0]
                out.append((m.start() + p.start(), 3 if whole else 4, m.start() + p.end(), "entropy" if whole else "rest"))
    return sorted(out)


def corpus():
    rng = random.Random(8)
    parts = ["password: hunter22", 'API_KEY="abc.def/123"', "token:token:abcdef", "secret=short", "apikey = x", "PassWd'='zzzzzz", "AKIA" + "Q7" * 9, "AKIAAKIA12", "🙂é", "\n"]
    rows = [None, "", "plain words only", "AKIA", "x" * 5000, "9f" * 3000, "ſecret=abcdefg", "toKen=abcdefg"]
    for _ in range(150):
        out = []
        for _ in range(rng.randint(0, 6)):
            k = rng.randint(0, 9)
            out.append(rng.choice(parts) if k < 5 else "".join(rng.choice(rng.choice(["0123456789abcdef", string.ascii_letters + string.digits + "+/", string.ascii_lowercase])) for _ in range(rng.randint(3, 60))))
        rows.append(rng.choice([" ", "", ", "]).join(out))
    return list(enumerate(rows))


def listed(found):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in found)


def test_matches_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: r for r in secrets.report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        own, count = base(text or ""), Counter(s[3] for s in base(text or ""))
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == (count["assign"], count["access"], count["hex"]), text
        assert got[i].base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest()
        assert got[i].spans == listed(spans(text or ""))


def test_incremental_entropy(spark):
    words = ["ab" * 15, "aB3dE5gH7jK9mN1pQ4sT6vW8", "z" * 40, "0123456789abcdef0123"]
    got = [r.h for r in spark.createDataFrame([(w,) for w in words], "w string").select(secrets.highest_entropy(F.col("w")).alias("h")).collect()]
    want = [max(-sum(n / 20 * math.log2(n / 20) for n in Counter(w[k : k + 20]).values()) for k in range(len(w) - 19)) for w in words]
    assert got == pytest.approx(want)


def test_redaction(spark):
    rows = [(1, "a password=abcdefgh z"), (2, "nothing"), (3, None), (None, "token: 0123456789abcdef0123456789abcdef é")]
    out = [r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert out == ["a [SECRET] z", "nothing", "", "[SECRET] é"]


def test_no_rows_and_clashing_columns(spark):
    df = spark.createDataFrame([], "doc_id long, text string, spans string, base int")
    assert secrets.report(df).count() == 0


def test_secrets_beside_base_spans_and_named_examples(spark):
    rng = random.Random(3)
    secret = lambda n: "".join(rng.sample(string.ascii_letters + string.digits, n))
    key, one, two = "AKIA" + "Q7R2W9E4T6Y1U3I8", secret(40), secret(40)
    texts = [f"a {key}/{one} b", f"a {one}_token=abcdef b", f"a Z{one}-{'9f' * 12}-{two}Z b", f"a example/{one} b", f"a {'x1Y2' * 2}/example/{'x1Y2' * 2} b", f"a example-{secret(12)} b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r.text for r in secrets.redact(df).orderBy("doc_id").collect()]
    assert not any(one in t or two in t for t in clean)
    assert clean[4:] == texts[4:]
    got = [r.spans.count("rest:") for r in secrets.report(df).orderBy("doc_id").collect()]
    assert got == [1, 1, 2, 0, 0, 0]


def cut(text):
    out, at = [], 0
    for a, _, b, _ in spans(text):
        out.append("" if a < at else text[at:a] + "[SECRET]")
        at = max(at, b)
    return "".join(out) + text[at:]


def test_redaction_matches_brute_force(spark, monkeypatch):
    rows = corpus()
    for block in (7, 4096):
        monkeypatch.setattr(secrets, "TEXT_BLOCK", block)
        got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == {i: cut(t or "") for i, t in rows}


def test_long_strings_and_many_spans_end(spark, tmp_path):
    """A megabyte of base64, a path of 100,000 folders, 30,000 digests in one text: from Parquet, in seconds."""
    rng = random.Random(1)
    letters = string.ascii_letters + string.digits + "+/"
    noise = "".join(rng.choices(letters, k=1_000_000))
    # no window of it is strong, so all of them are looked at
    dull = "aB1aB2" * 50_000
    digests = [f"{rng.getrandbits(256):064x}" for _ in range(30_000)]
    texts = [f"data:{noise}", dull, "a/b" * 100_000 + "/", "\n".join(digests), " ".join(f"token={d[:9]}/{d[:30].upper()}x" for d in digests)]
    path = str(tmp_path / "texts")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(path)
    began = time.time()
    docs = spark.read.parquet(path)
    got = {r.doc_id: r for r in secrets.report(docs).collect()}
    clean = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert time.time() - began < 120
    assert got[0].spans == f"entropy:5:{5 + len(noise)}" and clean[0] == "data:[SECRET]"
    assert got[1].spans == got[2].spans == "" and clean[1] == dull and clean[2] == texts[2]
    assert got[3].n_hex == 30_000 and clean[3] == "\n".join(["[SECRET]"] * 30_000)
    assert got[4].n_assign == 30_000 and clean[4] == " ".join(["[SECRET]"] * 30_000)
