"""Operator 11: spelling variants by anagram hashing.

A word's key is the sum of a power of each letter's code, so it says which letters the word
has but not their order.  Taking one letter's value from a key and adding another's gives the
keys of all words one removal, addition or exchange away: words meet on their own keys and on
their keys less each of their letters (an exchange is a removal on both sides), and the order
of the letters is verified.  Keys under which many words meet are refined by what is left of
the word once the letter is taken out of its place, so no group is compared in all pairs.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, materialise, tidy

#: Maximal runs of A-Z, a-z and U+00C0 to U+00FF in UTF-8, once A-Z are folded.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: Distinct words a task counts before it passes them on.
TABLE = 200_000
#: Rows of a key from which its words are compared by what is left of them.
HOT = 64
#: Letter's code -> its value: a power high enough that different letters rarely have one sum.
VALUES = [c**5 for c in range(256)]
MASK = (1 << 63) - 1


def thinned(run: bytes, h: int, every: int | None) -> bytes:
    """The run, without one of its code points where `every` divides the digest of its document and itself."""
    if not every or h % every:
        return run
    text = run.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def word_counts(docs: DataFrame, shortest: int = 6, every: int | None = 199) -> DataFrame:
    """(word, n): words of at least `shortest` code points and how often they stand in all texts, summed up in each task first.  Null texts have none."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table: dict[bytes, int] = {}

        def rows() -> pd.DataFrame:
            return pd.DataFrame({"word": pd.Series(list(table), dtype=object), "n": pd.Series(list(table.values()), dtype="int64")})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                begin = zlib.crc32(b":" if pd.isna(doc_id) else b"%d:" % int(doc_id))
                for word, n in Counter(_RUN.findall(text.lower())).items():
                    if len(word) >= shortest:
                        found = thinned(word, zlib.crc32(word, begin), every)
                        if len(found) >= shortest and (found.isascii() or len(found.decode()) >= shortest):
                            table[found] = table.get(found, 0) + n
                if len(table) >= TABLE:
                    yield rows()
                    table.clear()
        if table:
            yield rows()

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    counted = texts.mapInPandas(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.select(F.col("word").cast("string").alias("word"), "n")


def letter_keys(words: DataFrame) -> DataFrame:
    """(key, letter, word, n): a word's own key, with no letter, and its key less the value of each of its letters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for word, n in zip(batch["word"], batch["n"], strict=True):
                codes = word.encode("latin-1")
                key = sum(map(VALUES.__getitem__, codes))
                out.append((key & MASK, None, word, n))
                out += [((key - VALUES[c]) & MASK, c, word, n) for c in sorted(set(codes))]
            rows = pd.DataFrame(out, columns=["key", "letter", "word", "n"])
            yield rows.astype({"letter": "Int32"})

    return words.mapInPandas(tidy(run), "key long, letter int, word string, n long")


def remainders(keys: DataFrame) -> DataFrame:
    """The rows of `letter_keys` with `rest`, a digest of the word without its letter in one of the letter's places: a row for each different one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for key, letter, word, n in zip(batch["key"], batch["letter"], batch["word"], batch["n"], strict=True):
                if pd.isna(letter):
                    rests = {word}
                else:
                    # within a run of one letter, it does not matter which is taken
                    rests = {word[: m.start()] + word[m.start() + 1 :] for m in re.finditer(f"{re.escape(chr(int(letter)))}+", word)}
                out += [(key, letter, word, n, xxhash.xxh3_64_intdigest(rest.encode()) & MASK) for rest in rests]
            yield pd.DataFrame(out, columns=["key", "letter", "word", "n", "rest"]).astype({"letter": "Int32"})

    return keys.mapInPandas(tidy(run), "key long, letter int, word string, n long, rest long")


def _met(rows: DataFrame, on: list[str]) -> DataFrame:
    """(a, a_n, b, b_n): different words that meet on `on` by a removal or an exchange and differ in one code point."""
    one = rows.select(*on, F.col("letter").alias("a_letter"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    two = rows.where("letter is not null").select(*on, F.col("letter").alias("b_letter"), F.col("word").alias("b"), F.col("n").alias("b_n"))
    pairs = one.join(two, on).where("a_letter is null or a_letter < b_letter")
    return pairs.where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def near_pairs(words: DataFrame, hot: int | None = None) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words that differ by one inserted, deleted or replaced code point, once each."""
    keys = materialise(letter_keys(words), "letter-keys")
    busy = materialise(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > (hot or HOT)).select("key"), "busy-keys")
    few = _met(keys.join(busy, "key", "left_anti"), ["key"])
    many = _met(remainders(keys.join(busy, "key", "left_semi")), ["key", "rest"]).distinct()
    return few.unionByName(many)


def roots(forms: DataFrame, steps: int) -> DataFrame:
    """(word, root) of (word, form): where following forms ends, at most `steps` on; each round doubles how far a row has come."""
    found = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(steps, 1)))):
        ahead = found.select(F.col("word").alias("root"), F.col("root").alias("next"))
        found = materialise(found.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return found


def variants(docs: DataFrame, shortest: int = 6, least: int = 5, factor: int = 5, every: int | None = 199, hot: int | None = None) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of at least `shortest` code points and `least` occurrences.

    A word's form is its near word with most occurrences (ties: the smallest), if it has `factor` (2 at least) times the word's own;
    its root is the last of the forms that follow one another.  Null and empty texts have no words, null ids count as empty
    ones, equal rows count each; other columns are not read; an empty table gives no rows.
    """
    counted = word_counts(docs, shortest, every).where(F.col("n") >= least)
    words = materialise(counted, "words")
    pairs = materialise(near_pairs(words, hot), "near-words")
    links = pairs.select(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n"))
    links = links.unionByName(pairs.select(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n")))
    best = links.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    near = materialise(best.select("word", "n_near", F.when(-F.col("best")["less"] >= factor * F.col("n"), F.col("best")).alias("best")), "best-words")
    forms = near.where("best is not null").select("word", F.col("best")["near"].alias("form"), (-F.col("best")["less"]).alias("form_n"))
    # each form has `factor` times the occurrences of what it is the form of, which bounds how many can follow one another
    most = words.agg(F.max("n")).first()[0] or least
    ends = roots(forms, math.ceil(math.log(max(most / least, 1), factor)))
    out = words.join(near.select("word", "n_near"), "word", "left").join(forms, "word", "left").join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
