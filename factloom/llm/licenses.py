"""Operator 12: license scans by ordered signature rules.

A text is folded to its words, joined by one space.  Each rule of `license_rules` is a
regular expression over that, tried only where its keywords are words of the text.  Where
detections overlap, those of the stronger kind go first, then longer ones, then earlier
rules, and one whose interval lies within a kept one's is dropped.  The base phrases are
detections too, which nothing drops.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, tidy
from factloom.llm.license_rules import BASE, KINDS, RULES, TAGGED

#: Bytes that are split into words at a time.
SLICE = 1 << 20
#: What separates words is a space; capital letters are small ones.
_FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).replace(bytes(range(65, 91)), bytes(range(97, 123)))
_ORDER = {kind: k for k, kind in enumerate(KINDS)}
DETECTION = "label string, kind string, rule int, start long, end long, base boolean"


class Rule(NamedTuple):
    number: int
    label: str
    kind: str
    keywords: frozenset[bytes]
    find: re.Pattern[bytes]


def folded(text: str) -> str:
    """A phrase as the words that rules are written in."""
    return b" ".join(text.encode().translate(_FOLD).split()).decode()


def compiled(number: int, keywords: str, label: str, kind: str, pattern: str) -> Rule:
    gaps = pattern.replace(" ~ ", "(?: [^ ]+){0,6}? ")
    return Rule(number, label, kind, frozenset(keywords.encode().split()), re.compile(rb"(?<![^ ])(?:" + gaps.encode() + rb")(?![^ ])"))


@functools.lru_cache(maxsize=1)
def rules() -> list[Rule]:
    """The base phrases, the tags "SPDX-License-Identifier: ..." and the signature rules, in order."""
    base = ((word, label, "base", phrase) for word, label, phrase in BASE)
    # longer identifiers go first, so that one is not read as a shorter one at its start
    tags = (("spdx", name.lower(), "tag", f"spdx license identifier {folded(name)}") for name in sorted(TAGGED, key=lambda n: (-len(n), n)))
    return [compiled(k, *rule) for k, rule in enumerate(itertools.chain(base, tags, RULES))]


@functools.lru_cache(maxsize=1)
def by_keyword() -> dict[bytes, list[Rule]]:
    """One keyword of each rule (the longest) -> the rules to look at where it is met."""
    out: dict[bytes, list[Rule]] = {}
    for rule in rules():
        out.setdefault(max(rule.keywords, key=lambda w: (len(w), w)), []).append(rule)
    return out


def words_joined(text: bytes, size: int = SLICE) -> tuple[bytes, set[bytes]]:
    """The words of a text joined by one space, and which keywords are among them; `size` bytes or so are split at a time."""
    keywords, raw, parts, met, at = frozenset().union(*(r.keywords for r in rules())), text.translate(_FOLD), [], set(), 0
    while at < len(raw):
        stop = raw.find(b" ", at + size)
        stop = len(raw) if stop < 0 else stop
        found = raw[at:stop].split()
        if found:
            met |= keywords.intersection(found)
            parts.append(b" ".join(found))
        at = stop + 1
    return b" ".join(parts), met


class Kept:
    """Intervals, and whether one of them holds another."""

    def __init__(self) -> None:
        self.starts, self.ends = [], []

    def replace(self, intervals: list[tuple[int, int]]) -> None:
        ordered = sorted(intervals)
        self.starts = [a for a, _ in ordered]
        self.ends = list(itertools.accumulate((b for _, b in ordered), max))

    def holds(self, start: int, end: int) -> bool:
        k = bisect.bisect_right(self.starts, start) - 1
        return k >= 0 and self.ends[k] >= end


def resolved(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """The detections that lie within no kept one of a stronger kind, nor within a longer one (or the same interval of an earlier rule) of their own; base ones stay."""
    kept, intervals = [r for r in found if r[2].kind == "base"], []
    stronger = Kept()
    for _, group in itertools.groupby(sorted(found, key=lambda d: (_ORDER[d[2].kind], d[0], -d[1], d[2].number)), key=lambda d: _ORDER[d[2].kind]):
        furthest, own = -1, []
        for start, end, rule in group:
            # by start, longest first: what ends no later than an earlier one lies within it
            if end > furthest and not stronger.holds(start, end):
                own.append((start, end))
                furthest = end
                if rule.kind != "base":
                    kept.append((start, end, rule))
        intervals += own
        stronger.replace(intervals)
    return sorted(kept, key=lambda d: (d[0], d[1], d[2].number))


def detections(text: bytes) -> tuple[int, list[tuple]]:
    """(words, detections) of one text; starts and ends are in words, ends exclusive."""
    joined, met = words_joined(text)
    found = []
    for word in met & by_keyword().keys():
        for rule in by_keyword()[word]:
            if rule.keywords <= met:
                found += [(m.start(), m.end(), rule) for m in rule.find.finditer(joined)]
    out, at, passed = [], 0, 0
    for start, end, rule in resolved(found):
        passed, at = passed + joined.count(b" ", at, start), start
        out.append((rule.label, rule.kind, rule.number, passed, passed + joined.count(b" ", start, end) + 1, rule.kind == "base"))
    return joined.count(b" ") + 1 if joined else 0, out


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words and detections (array of label, kind, rule, start, end, base; places in words) of every row.

    Null texts are empty, with no words and no detections; null and repeated ids and equal rows give a row each; other
    columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in DETECTION.split(", ")]
        for batch in batches:
            found = [detections(t) for t in batch["text"]]
            rows = pd.Series([[dict(zip(names, d, strict=True)) for d in own] for _, own in found], dtype=object)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64").to_numpy(), "n_words": [n for n, _ in found], "detections": rows})

    as_struct = DETECTION.replace(" ", ":").replace(",:", ",")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(tidy(run), f"doc_id long, n_words long, detections array<struct<{as_struct}>>")


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Counts, first and last place and labels of the base phrases, labels of all detections, and the weight of the strongest kind as score (0 without any)."""
    weight = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    found = scan(docs).withColumn("base", F.filter("detections", lambda d: d["base"]))
    place = F.transform("base", lambda d: d["start"])
    score = F.array_max(F.transform("detections", lambda d: weight[d["kind"]]))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(place).alias("first_word"), F.array_max(place).alias("last_word"),
        _labels(F.col("base")).alias("base_labels"), _labels(F.col("detections")).alias("labels"), F.coalesce(score, F.lit(0.0)).alias("score"),
    )
