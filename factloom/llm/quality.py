"""Operator 10: quality by a generalised additive model with pairwise interactions.

Features of whole texts are cut into bins.  Shallow trees, boosted in cycles over
the features and then over pairs of features, add to one lookup table per feature
and pair; a score is a sum of looked-up values, taken by vectorised bin additions.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_documents, tidy
from factloom.llm.labelled import SAMPLE, held_out, sample

BINS, PAIR_BINS, PAIRS = 48, 8, 10
CYCLES, PATIENCE, RATE, RIDGE = 300, 30, 0.08, 2.0
THRESHOLD = 0.7
FEATURES = (
    "log_chars", "log_words", "word_length", "distinct_words", "top_word", "letters", "digits", "upper", "spaces", "stops", "symbols", "bangs", "bars",
    "non_ascii", "log_lines", "line_length", "repeated_lines", "ended_lines", "byte_entropy", "same_as_before", "bare_words", "log_longest_word",
    "short_lines", "packed", "one_letter_words", "marked_ends",
)
_CODES = np.arange(256)


def _is(chars: bytes) -> np.ndarray:
    return np.isin(_CODES, np.frombuffer(chars, np.uint8)).astype(float)


_CLASSES = np.stack(
    [
        ((_CODES | 32) >= 97) & ((_CODES | 32) <= 122) | (_CODES >= 128),
        _is(b"0123456789"),
        (_CODES >= 65) & (_CODES <= 90),
        _is(b" \t\n\r\v\f"),
        _is(b".,;:?"),
        _is(b"#$%&*|~^<>{}[]=+_@\\/"),
        _is(b"!"),
        _is(b"|"),
        _CODES >= 128,
    ],
    1,
).astype(float)


def features(text: str) -> list[float]:
    """FEATURES of a whole text; all are defined, mostly as 0, for an empty one."""
    raw = text.encode("utf-8", "surrogatepass")
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(len(raw), 1)
    share = count / n
    some = share[share > 0]
    words = text.split()
    n_words = max(len(words), 1)
    number = Counter(words)
    lines = [line for line in text.split("\n") if line.strip()]
    n_lines = max(len(lines), 1)
    letters, digits, upper, spaces, stops, symbols, bangs, bars, wide = share @ _CLASSES
    return [
        np.log1p(len(text)),
        np.log1p(len(words)),
        sum(map(len, words)) / n_words,
        len(number) / n_words,
        max(number.values(), default=0) / n_words,
        letters, digits, upper, spaces, stops, symbols, bangs, bars, wide,
        np.log1p(len(lines)),
        np.log1p(len(text) / n_lines),
        1 - len(set(lines)) / n_lines if lines else 0.0,
        sum(line.rstrip().endswith((".", "!", "?", ":", '"')) for line in lines) / n_lines,
        float(-(some * np.log2(some)).sum()),
        sum(a == b for a, b in pairwise(words)) / n_words,
        sum(c for w, c in number.items() if not any(map(str.isalnum, w))) / n_words,
        np.log1p(max(map(len, number), default=0)),
        sum(len(line) < 30 for line in lines) / n_lines,
        len(zlib.compress(raw, 1)) / n,
        sum(c for w, c in number.items() if len(w) == 1) / n_words,
        sum(c for w, c in number.items() if len(w) > 1 and not w[-1].isalnum() and w[-1] == w[-2]) / n_words,
    ]


def matrix(texts: list[str]) -> np.ndarray:
    return np.array([features(t) for t in texts], float).reshape(len(texts), len(FEATURES))


def _leaves(gradient: np.ndarray, weight: np.ndarray, leaves: int = 4) -> np.ndarray:
    """A tree of `leaves` leaves over ordered bins, split greedily, as its value in every bin."""
    g, w = np.r_[0, gradient.cumsum()], np.r_[0, weight.cumsum()]
    cuts = [0, len(gradient)]
    gain_of = lambda s, t: (g[t] - g[s]) ** 2 / (w[t] - w[s] + RIDGE)
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in pairwise(cuts):
            if b - a > 1:
                mid = np.arange(a + 1, b)
                gain = gain_of(a, mid) + gain_of(mid, b) - gain_of(a, b)
                best = max(best, (gain.max(), int(mid[gain.argmax()])), key=lambda x: x[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(gradient))
    for a, b in pairwise(cuts):
        out[a:b] = (g[b] - g[a]) / (w[b] - w[a] + RIDGE)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best tree of two crossing cuts over a grid of bins, and its gain."""
    g, w = np.zeros(np.add(gradient.shape, 1)), np.zeros(np.add(weight.shape, 1))
    g[1:, 1:], w[1:, 1:] = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    i, j = np.arange(1, gradient.shape[0])[:, None], np.arange(1, gradient.shape[1])[None, :]
    parts = lambda c: (c[i, j], c[i, -1] - c[i, j], c[-1, j] - c[i, j], c[-1, -1] - c[i, -1] - c[-1, j] + c[i, j])
    values = [a / (b + RIDGE) for a, b in zip(parts(g), parts(w), strict=True)]
    gain = sum(v * a for v, a in zip(values, parts(g), strict=True))
    at = np.unravel_index(gain.argmax(), gain.shape)
    out = np.zeros(gradient.shape)
    a, b = at[0] + 1, at[1] + 1
    out[:a, :b], out[:a, b:], out[a:, :b], out[a:, b:] = (v[at] for v in values)
    return out, float(gain[at])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class AdditiveModel:
    """Cut points, one table per feature and one per chosen pair of features."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
        self.base = float(np.log(share / (1 - share)))
        steps, coarse = np.linspace(0, 1, BINS + 1)[1:-1], np.linspace(0, 1, PAIR_BINS + 1)[1:-1]
        self.cuts = [np.unique(np.quantile(column, steps)) if len(y) else np.zeros(0) for column in x.T]
        self.coarse = [np.unique(np.quantile(column, coarse)) if len(y) else np.zeros(0) for column in x.T]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pairs: list[tuple[int, int]] = []
        self.grids: list[np.ndarray] = []
        if len(y) and y.min() != y.max():
            self._fit(x, y)

    def _bins(self, x: np.ndarray, cuts: list[np.ndarray]) -> list[np.ndarray]:
        return [np.searchsorted(c, column, side="right") for c, column in zip(cuts, x.T, strict=True)]

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        held = np.arange(len(y)) % 5 == 4
        learn = ~held
        f = np.full(len(y), self.base)

        def histogram(at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
            p = _sigmoid(f)
            return np.bincount(at[learn], (y - p)[learn], size), np.bincount(at[learn], (p * (1 - p))[learn], size)

        def cycle(tables: list[np.ndarray], places: list[np.ndarray], tree) -> None:
            nonlocal f
            best, since, kept = np.inf, 0, [t.copy() for t in tables]
            for _ in range(CYCLES):
                for table, at in zip(tables, places, strict=True):
                    change = RATE * tree(*histogram(at, table.size), table.shape)
                    table += change
                    f = f + change.ravel()[at]
                p = np.clip(_sigmoid(f[held]), 1e-9, 1 - 1e-9)
                loss = -(y[held] * np.log(p) + (1 - y[held]) * np.log(1 - p)).mean()
                since = 0 if loss < best - 1e-5 else since + 1
                if not since:
                    best, kept = loss, [t.copy() for t in tables]
                if since > PATIENCE:
                    break
            for table, was, at in zip(tables, kept, places, strict=True):
                f = f + (was - table).ravel()[at]
                table[:] = was

        cycle(self.tables, bins, lambda g, w, _: _leaves(g, w))
        sizes = [len(c) + 1 for c in self.coarse]
        place = lambda a, b: coarse[a] * sizes[b] + coarse[b]
        tried = []
        for a, b in combinations(range(x.shape[1]), 2):
            if sizes[a] > 1 and sizes[b] > 1:
                g, w = histogram(place(a, b), sizes[a] * sizes[b])
                tried.append((_quadrants(g.reshape(sizes[a], -1), w.reshape(sizes[a], -1))[1], a, b))
        self.pairs = [(a, b) for _, a, b in sorted(tried, reverse=True)[:PAIRS]]
        self.grids = [np.zeros((sizes[a], sizes[b])) for a, b in self.pairs]
        cycle(self.grids, [place(a, b) for a, b in self.pairs], lambda g, w, shape: _quadrants(g.reshape(shape), w.reshape(shape))[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins, coarse = self._bins(x, self.cuts), self._bins(x, self.coarse)
        f = np.full(len(x), self.base)
        for table, at in zip(self.tables, bins, strict=True):
            f += table[at]
        for (a, b), grid in zip(self.pairs, self.grids, strict=True):
            f += grid[coarse[a], coarse[b]]
        return _sigmoid(f)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> AdditiveModel:
    """A model learnt from about `rows` labelled documents that are not held out."""
    texts, y = sample(docs, labels, "quality", rows)
    return AdditiveModel(matrix(texts), y)


def score(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """(doc_id, score): the score of every whole text, one row per input row; null texts are empty and score as empty ones do."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": shared.value.scores(matrix(list(batch["text"])))})

    return as_documents(docs).mapInPandas(tidy(run), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null ids are not held out, repeated rows score alike, an empty
    table has no rows, and without usable labels every score is 1/2 or that of the one label there is."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
