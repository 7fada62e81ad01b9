"""Operator 4: benchmark decontamination by canonical templates.

Words become template tokens: numbers, units after a number, and names (capitalised
words within a sentence) turn into typed placeholders, everything else is folded to
lower-case letters and digits.  Windows of WINDOW template tokens with enough literal
words are hash-joined between documents and benchmark items, and so are all windows of
the case-folded words themselves, without placeholders, so a copy in other letter case
or one dense in numbers and names is found.  Windows of one document and item at one
offset form an alignment; it counts where each slot value of the item stands for one
value of the document throughout, and the other way round.  Where some values don't,
the windows without such values count, if they cover COVER tokens by themselves.  So a
question with other numbers or names is found, and chance agreement is not.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, bounded_broadcast, materialise, tidy, windows

WINDOW = 8
#: Literal tokens that a window must hold at least.
LITERALS = 5
#: An alignment counts when its windows cover this many tokens, or this share of the item.
COVER, SHARE = 20, 0.5
#: Items of fewer tokens than a window, but so many, are looked for as a whole; shorter ones can't be told from chance.
SHORT = 4
#: Template windows of the benchmark that are sent to every task (8 bytes each); more are joined by shuffle alone.
BROADCAST_WINDOWS = 4_000_000
#: Rows of the benchmark's windows that are joined by broadcast (some 100 bytes each).
BROADCAST_ITEMS = 250_000
#: Distinct words a task remembers, and words judged at a time.
WORDS, CHUNK = 400_000, 60_000
# Unit words.
UNITS = frozenset(
    "mm cm m km g kg mg t l ml cl s ms h min hr hrs sec mi ft yd lb lbs oz gal mph kph kmh hz khz mhz ghz w kw mw v a mb gb tb kb usd eur gbp "
    "percent pct degrees degree second seconds minute minutes hour hours day days week weeks month months year years meter meters metre metres "
    "kilometer kilometers kilometre kilometres mile miles foot feet inch inches yard yards gram grams kilogram kilograms pound pounds ounce ounces "
    "liter liters litre litres gallon gallons dollar dollars cent cents euro euros".split()
)
LITERAL, NUMBER, NAME = 0, 1, 2
_NUMBER = re.compile(r"[^\w]*[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th)?[^\w]*$")
_ATTACHED = re.compile(r"[^\w]*[$€£]?[+-]?(\d[\d.,]*)([A-Za-z]+|%)[^\w]*$")
_SQUASH = re.compile(r"[^\w]+")
_MARK = {kind: np.uint64(xxhash.xxh3_64_intdigest(f"<{kind}>")) for kind in ("num", "name", "unit")}


class Lexicon(dict):
    """Raw word -> row of (template hash within a sentence, at its start, kind within, kind at start, unit?, ends a sentence?, empty?, hash of the folded word)."""

    def __init__(self) -> None:
        super().__init__()
        self.columns = [np.zeros(1024, kind) for kind in (np.uint64, np.uint64, np.int8, np.int8, bool, bool, bool, np.uint64)]

    def __missing__(self, word: str) -> int:
        bare = _SQUASH.sub("", word.lower())
        ends = word.rstrip("\"'”’)»")[-1:] in (".", "!", "?", ":", "")
        literal = xxhash.xxh3_64_intdigest(bare)
        attached = _ATTACHED.match(word)
        if _NUMBER.match(word) or (attached and (attached[2] == "%" or attached[2].lower() in UNITS)):
            row = (_MARK["num"], _MARK["num"], NUMBER, NUMBER, False, ends, False)
        elif bare and word.lstrip("\"'“‘(«")[:1].isupper():
            row = (_MARK["name"], literal, NAME, LITERAL, bare in UNITS, ends, False)
        else:
            row = (literal, literal, LITERAL, LITERAL, bare in UNITS, ends, not bare)
        at = self[word] = len(self)
        if at == len(self.columns[0]):
            self.columns = [np.concatenate([c, np.zeros_like(c)]) for c in self.columns]
        for column, value in zip(self.columns, (*row, literal), strict=True):
            column[at] = value
        return at


class Templates:
    """Template hashes, hashes of the folded words, kinds and words of several texts, one after another; `text` says whose a word is.

    Words without letters and digits are left out.  A text begins a sentence, and its first word follows no number.
    """

    def __init__(self, lexicon: Lexicon, texts: list[list[str]]) -> None:
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        words = list(chain.from_iterable(texts))
        at = np.fromiter(map(lexicon.__getitem__, words), np.int64, len(words))
        inside, first, kind_in, kind_first, unit, ends, empty, folded = (c[at] for c in lexicon.columns)
        text = np.repeat(np.arange(len(texts)), sizes)
        opens = np.diff(text, prepend=-1) != 0
        start = np.concatenate([[True], ends[:-1]])[: len(words)] | opens
        h, kind = np.where(start, first, inside), np.where(start, kind_first, kind_in)
        is_unit = unit & np.concatenate([[False], kind[:-1] == NUMBER])[: len(words)] & ~opens
        h = np.where(is_unit, _MARK["unit"], h)
        kind = np.where(is_unit, LITERAL, kind).astype(np.int8)
        keep = np.flatnonzero(~empty)
        self.hashes, self.folded, self.kind, self.text = h[keep], folded[keep], kind[keep], text[keep]
        self.words, self.place = words, keep
        self.sizes = np.bincount(self.text, minlength=len(texts))
        self.first = np.cumsum(self.sizes) - self.sizes

    def within(self, width: int) -> np.ndarray:
        """Where runs of `width` words start that belong to one text."""
        return self.text[width - 1 :] == self.text[: len(self.text) - width + 1] if len(self.text) >= width else np.zeros(0, bool)

    def usable(self) -> np.ndarray:
        """Where windows start that hold LITERALS literal tokens."""
        literal = np.r_[0, np.cumsum(self.kind == LITERAL)]
        return self.within(WINDOW) & (literal[WINDOW:] - literal[:-WINDOW] >= LITERALS) if len(self.text) >= WINDOW else np.zeros(0, bool)

    def slots(self, start: int) -> list[str]:
        return [_SQUASH.sub("", self.words[self.place[k]].lower()) for k in range(start, start + WINDOW) if self.kind[k] != LITERAL]


def _sieve(known: np.ndarray) -> np.ndarray:
    """Marks of the low bits of sorted hashes, so that most others are told apart without a search."""
    bits = min(max(int(len(known) * 16).bit_length(), 16), 26)
    marks = np.zeros(1 << bits, bool)
    marks[known & np.uint64((1 << bits) - 1)] = True
    return marks


def _window_rows(identity: str, wanted=None, short: tuple[int, ...] | None = None):
    """Rows (id, mark, pos, n, window, template, exact, slots) of the usable template windows and the folded ones, those in `wanted` alone where it is given.

    A window that is the same both ways is one row; `exact` windows match by their words alone.  A text of fewer than WINDOW
    words, but SHORT at least, is one window; other texts have windows of these lengths too where `short` lists them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon()
        known = None if wanted is None else wanted.value
        marks = None if known is None else _sieve(known)

        def sought(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
            if known is None:
                return np.flatnonzero(at)
            if not len(known):
                return np.zeros(0, int)
            at = np.flatnonzero(at & marks[hashes & np.uint64(len(marks) - 1)])
            return at[known[np.minimum(np.searchsorted(known, hashes[at]), len(known) - 1)] == hashes[at]]

        def rows(held: list) -> pd.DataFrame | None:
            found = Templates(lexicon, [words for _, _, words in held])
            hashes, exact, within = windows(found.hashes, WINDOW), windows(found.folded, WINDOW), found.within(WINDOW)
            same = hashes == exact
            out = []

            def add(at: np.ndarray, h: np.ndarray, template: bool, exactly, slots) -> None:
                for k, value in zip(at.tolist(), h.view(np.int64)[at].tolist(), strict=True):
                    t = int(found.text[k])
                    out.append((*held[t][:2], int(k - found.first[t]), int(found.sizes[t]), value, template, bool(exactly(k)), slots(k)))

            add(sought(hashes, found.usable()), hashes, True, lambda k: same[k], found.slots)
            add(sought(exact, ~same & within), exact, False, lambda k: True, found.slots)
            for width in range(SHORT, WINDOW) if short is None else short:
                whole = windows(found.folded, width)
                here = found.within(width)
                if short is None:
                    here &= (found.sizes == width)[found.text[: len(here)]]
                add(sought(whole, here), whole, False, lambda k: True, lambda k: [])
            if not out:
                return None
            return pd.DataFrame(out, columns=[identity, "mark", "pos", "n", "window", "template", "exact", "slots"]).astype({identity: "Int64"})

        for batch in batches:
            held, total = [], 0
            for key, mark, text in zip(batch[identity], batch["mark"], batch["text"], strict=True):
                held.append((key, mark, text.split()))
                total += len(held[-1][2])
                if total >= CHUNK:
                    frame = rows(held)
                    if frame is not None:
                        yield frame
                    held, total = [], 0
                    if len(lexicon) > WORDS:
                        lexicon = Lexicon()
            frame = rows(held) if held else None
            if frame is not None:
                yield frame

    return run


def _covered(found: Column, n: Column) -> Column:
    """Tokens that an alignment's windows cover, null where it doesn't count."""
    pairs = F.array_distinct(F.flatten(F.transform(found, lambda w: w["pairs"])))
    distinct = lambda side: F.size(F.array_distinct(F.transform(pairs, lambda p: p[side])))
    consistent = (distinct("item") == F.size(pairs)) & (distinct("doc") == F.size(pairs))
    bad = F.filter(pairs, lambda p: F.exists(pairs, lambda q: (q["item"] == p["item"]) != (q["doc"] == p["doc"])))
    sound = F.filter(found, lambda w: ~F.arrays_overlap(w["pairs"], bad))
    tokens = lambda ws: F.size(F.array_distinct(F.flatten(F.transform(ws, lambda w: F.sequence(w["at"], w["at"] + WINDOW - 1)))))
    whole, part = F.least(tokens(found), n), tokens(sound)
    return F.when(consistent, F.when((whole >= COVER) | (whole >= SHARE * n), whole)).otherwise(F.when(part >= COVER, part))


def alignments(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, mark, item_id, covered): documents (mark is their text's xxhash64) and the items they hold, with the most tokens covered."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "{} long, mark long, pos int, n int, window long, template boolean, exact boolean, slots array<string>"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    items = materialise(items.mapInPandas(tidy(_window_rows("item_id")), schema.format("item_id")), "benchmark")
    items = items.select("item_id", F.col("pos").alias("item_pos"), "n", "window", F.col("template").alias("item_template"), F.col("slots").alias("item_slots"))
    kinds = items.select("window").distinct()
    count = kinds.count()
    short = tuple(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    wanted = None
    if count <= BROADCAST_WINDOWS:
        found = np.fromiter((r.window for r in kinds.toLocalIterator()), np.int64, count).view(np.uint64)
        wanted = spark.sparkContext.broadcast(np.sort(found))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))
    rows = rows.mapInPandas(tidy(_window_rows("doc_id", wanted, short)), schema.format("doc_id")).select("doc_id", "mark", "pos", "window", "template", "exact", "slots")
    hits = rows.distinct().join(bounded_broadcast(items, items.count(), BROADCAST_ITEMS), "window")
    hits = hits.withColumn("offset", F.col("pos") - F.col("item_pos"))
    by = ["doc_id", "mark", "item_id", "offset"]
    value = F.when(F.col("exact"), F.col("item_slots")).otherwise(F.col("slots"))
    window = F.struct(F.col("item_pos").alias("at"), (F.col("template") & F.col("item_template")).alias("template"), F.arrays_zip(F.col("item_slots").alias("item"), value.alias("doc")).alias("pairs"))
    whole = hits.groupBy(*by).agg(F.max("n").alias("n"), F.collect_list(window).alias("found"))
    # Words kept where others were replaced must not spoil what the templates alone make consistent.
    covered = F.greatest(_covered(F.filter("found", lambda w: w["template"]), F.col("n")), _covered(F.col("found"), F.col("n")))
    counted = whole.withColumn("covered", covered).where("covered is not null")
    return counted.groupBy("doc_id", "mark", "item_id").agg(F.max("covered").alias("covered"))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, n_items and items (ids in order, comma-joined) of every input row.

    Null texts are empty and clean; items of fewer than SHORT tokens are not looked for; repeated rows are judged alike;
    without a benchmark all are clean.  An alignment of a document and an item has at most the item's windows, so its
    group is small; items of a hot document are grouped after that.
    """
    found = alignments(docs, benchmark).groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("item_id")).alias("list"))
    found = found.select(F.col("doc_id").alias("id"), F.col("mark").alias("found"), "list")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("mark"))
    out = rows.join(found, (F.col("mark") == F.col("found")) & F.expr("doc_id <=> id"), "left")
    items = F.coalesce(F.col("list"), F.array().cast("array<long>"))
    return out.select("doc_id", (F.size(items) > 0).alias("contaminated"), F.size(items).cast("long").alias("n_items"), F.array_join(items.cast("array<string>"), ",").alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, that hold no benchmark item."""
    found = materialise(alignments(docs, benchmark).select(F.col("doc_id").alias("bad_id"), F.col("mark").alias("bad_mark")).distinct(), "leaks")
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    side = bounded_broadcast(found, found.count(), 1_000_000)
    return docs.join(side, (mark == F.col("bad_mark")) & (F.col("doc_id").cast("long").eqNullSafe(F.col("bad_id"))), "left_anti")
