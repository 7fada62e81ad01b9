import hashlib
import random

import numpy as np
import pytest

pytest.importorskip("factloom.llm")
import public_tokenizers as P
from tokenizers import Tokenizer

from factloom.llm import tokens

TEXTS = [
    "", None, "the the  THE\n\nThe", "don't we'll 12 345 a1b2", "<|endoftext|> tail", "İstanbul ΣΑΣ ß ǅ", "a b c\x1cd", "é é 日本語 🙂🙂",
    "x" * 3000, "  lead and trail  ", "\t\r\n mixed \n", "!!'s ''re $$$", "½²x", "<|startoftext|>a",
]


def corpus():
    rng = random.Random(4)
    plain = "abcdeéßñ ABC  '.,!?12\n\t&%-_"
    kinds = [plain, plain, plain + "’Ωи日́"]
    return list(enumerate(TEXTS + ["".join(rng.choice(kinds[k % 3]) for _ in range(rng.randint(0, 200))) for k in range(300)]))


def test_counts_match_the_library(spark, tmp_path):
    rows, path, cache = corpus(), P.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    library = Tokenizer.from_file(path)
    expected = {i: (len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for _ in range(2):  # the second time from the cache alone
        got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.token_counts(df, path, cache).collect()}
        assert got == expected
        stored = spark.read.parquet(cache)
        assert stored.count() == len({t or "" for _, t in rows})


def test_encoding_and_decoding_match_the_library(spark):
    rows, path = corpus(), P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    expected = {}
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        expected[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in tokens.encode_digests(df, path).collect()}
    assert got == expected
    stored = tokens.encode(df, path)
    assert {(r.doc_id, r.text) for r in tokens.decode(stored, path).collect()} == {(r.doc_id, r.text) for r in tokens.encode(df, path, decoded=True).collect()}
    for size in (1, 2000):  # a block for every document, or for a few
        got = {r.doc_id: hashlib.sha256(bytes(r.ids)).hexdigest() for r in tokens.encode(df, path, size=size).collect()}
        assert got == {i: e[1] for i, e in expected.items()}


def test_words_of_any_length(spark):
    """A word of more ids than 16 bits count, and words after it."""
    rng = random.Random(6)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=300_000))
    rows, path = [(1, f"the cat {long} sat on the mat zebra"), (2, "zebra mat"), (3, long[:1000] + "\0 " + long)], P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    want = {i: np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for i, t in rows}
    assert len(want[1]) > 4 * 65_535
    assert {r.doc_id: bytes(r.ids) for r in tokens.encode(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()} == want
    table = tokens._Table(lambda: None)
    with pytest.raises(ValueError):
        table.add(b"one\0two", np.array([1, 2], "<u4").tobytes(), b"\0" * 8)


def test_each_distinct_word_is_listed_once_a_block(spark):
    df = spark.createDataFrame([(k, "one two three ONE'S " + "four " * k) for k in range(50)], "doc_id long, text string").repartition(4)
    path = P.path("word_bpe_49k.json")
    for size in (10, 10_000_000):
        rows = tokens.word_lists(df, path, size=size).selectExpr("block", "explode(words) as word")
        assert {r.word for r in rows.collect()} == {"one", "'s", "two", "three", "four"}
        assert rows.groupBy("block", "word").count().where("count > 1").count() == 0
        assert rows.select("block").distinct().count() == (50 if size == 10 else 4)
    coded = tokens.encoded_words(tokens.word_lists(df, path, size=10), path).collect()
    assert sum(len(r.words.decode().split("\0")) for r in coded) == tokens.word_lists(df, path, size=10).selectExpr("explode(words)").count()


@pytest.mark.parametrize("name, pattern, lower", [("word_bpe_49k.json", tokens.WORD_PATTERN, True), ("byte_bpe_50k.json", tokens.BYTE_PATTERN, False)])
def test_what_is_forgotten_is_encoded_again(name, pattern, lower, monkeypatch):
    monkeypatch.setattr(tokens, "PIECES", 6)
    monkeypatch.setattr(tokens, "UNITS", 8)
    known, library = tokens.Encoder(P.path(name), pattern, lower), Tokenizer.from_file(P.path(name))
    for _, text in [*corpus(), (0, "one two three four five"), (0, "two six one\nseven one  eight nine\n\nten two")]:
        want = np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        assert known.encode(text or "") == want


def test_repeats_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b", 5), (1, "a b", 5), (None, "a b", 5), (None, None, 5)], "doc_id long, text string, n_bytes long")
    got = sorted(map(tuple, tokens.token_counts(df, P.path("byte_bpe_50k.json"), limit=1).collect()), key=str)
    assert got == sorted([(1, 3, 2, True), (1, 3, 2, True), (None, 3, 2, True), (None, 0, 0, False)], key=str)
    none = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.token_counts(none, P.path("byte_bpe_50k.json")).count() == 0
    assert tokens.encode_digests(none, P.path("word_bpe_49k.json")).count() == 0
    extra = spark.createDataFrame([(1, "a b", b"x", "w"), (1, "a b", b"y", "w"), (None, "a b", None, "w"), (None, None, None, None)], "doc_id long, text string, ids binary, word string")
    got = sorted(((r.doc_id, r.n_tokens) for r in tokens.encode_digests(extra, P.path("word_bpe_49k.json")).collect()), key=str)
    assert got == sorted([(1, 2), (1, 2), (None, 2), (None, 0)], key=str)
