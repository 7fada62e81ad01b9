"""Operator 2: toxicity by a bidirectional gated recurrent network over overlapping windows of words.

A word enters as a learnt embedding, its characters as the learnt embeddings of their runs
of 3 to 5; nothing is computed from the labels beside the network.  Two gated recurrent
layers read a window forwards and backwards, attention pools their states, and a text's
score is that of its highest window.  The network is trained in numpy on a bounded sample;
tasks score every window of every text, with the inputs of distinct words computed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_documents, bounded_batches, tidy
from factloom.llm.labelled import SAMPLE, held_out, sample

WINDOW, STRIDE = 64, 32
HIDDEN, EMBED = 8, 8
#: Words with an embedding of their own, the most frequent ones; others have their characters alone.
VOCABULARY = 20_000
LEAST_TEXTS = 5
#: Buckets of the character runs' embeddings.
RUNS = 1 << 15
#: Steps on any windows of the texts, and in all; texts in a step, rate, decay of embeddings and share of words without their own one.
FREE_STEPS, STEPS, BATCH, RATE, DECAY, DROP = 90, 160, 256, 0.01, 4.0, 0.7
#: Share of clean windows that are cut to any length: a part of a clean text is clean.
CROP = 0.5
#: Steps between choices of the texts' highest windows, and windows scored at a time.
AGAIN, CHUNK = 40, 2048
#: Distinct raw words a task remembers; a full table starts anew.
WORDS = 150_000
THRESHOLD = 0.3
# Characters that are not part of a word at its ends.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’‚…–—·"


def normal(word: str) -> str:
    """A lower-cased word without the marks around it."""
    return word.strip(MARKS)


def spans(n: int) -> np.ndarray:
    """Starts of the windows over n words: every STRIDE words, the last one flush with the end."""
    if n <= WINDOW:
        return np.zeros(min(n, 1), np.int64)
    return np.unique(np.r_[np.arange(0, n - WINDOW, STRIDE), n - WINDOW])


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the runs of 3, 4 and 5 characters of every padded word (one column each; a run beyond the word repeats the shorter one) and where each word's begin."""
    flat = np.frombuffer(("\x02" + "\x02".join(w or " " for w in words) + "\x02\x02\x02\x02").encode("utf-32-le", "surrogatepass"), np.uint32)
    edge = np.flatnonzero(flat == 2)[: len(words) + 1]
    sizes = np.diff(edge) - 1
    begin = np.r_[0, np.cumsum(sizes)]
    at = np.repeat(edge[:-1] - begin[:-1], sizes) + np.arange(begin[-1])
    last = np.repeat(edge[1:], sizes)
    with np.errstate(over="ignore"):
        h = ((flat[at] * np.uint32(0x9E3779B1) + flat[at + 1]) * np.uint32(0x85EBCA77) + flat[at + 2]) * np.uint32(0xC2B2AE3D)
        out = [h]
        for width in (4, 5):
            longer = (h ^ flat[np.minimum(at + width - 1, len(flat) - 1)]) * np.uint32(0x27D4EB2F) + np.uint32(width)
            h = np.where(at + width - 1 <= last, longer, h)
            out.append(h)
    out = np.stack(out, 1)
    return out ^ (out >> np.uint32(15)), begin


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Weights, forward pass and gradients.  Row 0 of every word table is padding: its update gate keeps the state."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 2) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.vocabulary = vocabulary
        self.p = {
            "word": draw(len(vocabulary) + 1, EMBED, scale=0.05),
            "char": draw(RUNS, EMBED, scale=0.05),
            "in": draw(2 * EMBED, 6 * HIDDEN, scale=0.3),
            "bias": np.zeros(6 * HIDDEN, np.float32),
            "back": draw(2, HIDDEN, 3 * HIDDEN, scale=0.3),
            "look": draw(2 * HIDDEN, scale=0.3),
            "out": draw(2 * HIDDEN, scale=0.3),
            "base": np.array([-2.0], np.float32),
        }

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vocabulary ids, buckets of character runs (one column a width) and where each word's begin, of normalised words."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        runs, cut = grams(words)
        return ids, runs % RUNS, cut

    def inputs(self, ids: np.ndarray, buckets: np.ndarray, cut: np.ndarray) -> np.ndarray:
        """The word's embedding beside the sum of its runs' over the root of their number."""
        runs = self.p["char"][buckets[:, 0]] + self.p["char"][buckets[:, 1]] + self.p["char"][buckets[:, 2]]
        runs = np.add.reduceat(runs, cut[:-1], axis=0) / np.sqrt(np.diff(cut))[:, None] if len(ids) else np.zeros((0, EMBED))
        own = np.where(ids[:, None] > 0, self.p["word"][ids], 0)
        return np.concatenate([own, runs], 1).astype(np.float32)

    def table(self, x: np.ndarray) -> np.ndarray:
        """Gate inputs of words for both directions, after the padding row."""
        pad = np.zeros((1, 6 * HIDDEN), np.float32)
        pad[:, HIDDEN : 2 * HIDDEN] = pad[:, 4 * HIDDEN : 5 * HIDDEN] = 40
        return np.concatenate([pad, x @ self.p["in"] + self.p["bias"]])

    def forward(self, table: np.ndarray, at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Logits of windows of rows of `table`; `keep` receives what the gradients need."""
        n, length = at.shape
        states = np.empty((length, n, 2 * HIDDEN), np.float32)
        for way in (0, 1):
            h = np.zeros((n, HIDDEN), np.float32)
            part, back = np.ascontiguousarray(table[:, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN]), self.p["back"][way]
            steps = []
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                g, r = part[at[:, t]], h @ back
                gates = _sigmoid(g[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
                new = np.tanh(g[:, 2 * HIDDEN :] + reset * r[:, 2 * HIDDEN :])
                if keep is not None:
                    steps.append((t, h, reset, update, new, r[:, 2 * HIDDEN :]))
                h = new + update * (h - new)
                states[t, :, way * HIDDEN : (way + 1) * HIDDEN] = h
            if keep is not None:
                keep.append(steps)
        score = np.where(at.T > 0, states @ self.p["look"], np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        if keep is not None:
            keep += [states, weight, pooled]
        return pooled @ self.p["out"] + self.p["base"][0]

    def rate(self, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The logits of `forward`, for scoring: states are laid out by unit, and sums are done in place."""
        n, length = at.shape
        turned = np.ascontiguousarray(at.T)
        states = np.empty((length, 2 * HIDDEN, n), np.float32)
        for way in (0, 1):
            h = np.zeros((HIDDEN, n), np.float32)
            part, back = np.ascontiguousarray(table[:, way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN]), np.ascontiguousarray(self.p["back"][way].T)
            for t in range(length) if way == 0 else range(length - 1, -1, -1):
                g, r = np.ascontiguousarray(part[turned[t]].T), back @ h
                gates, new = g[: 2 * HIDDEN], r[2 * HIDDEN :]
                gates += r[: 2 * HIDDEN]
                np.negative(gates, out=gates)
                np.exp(gates, out=gates)
                gates += 1
                np.reciprocal(gates, out=gates)
                new *= gates[:HIDDEN]
                new += g[2 * HIDDEN :]
                np.tanh(new, out=new)
                h = h - new
                h *= gates[HIDDEN:]
                h += new
                states[t, way * HIDDEN : (way + 1) * HIDDEN] = h
        score = np.where(turned > 0, np.einsum("tjn,j->tn", states, self.p["look"]), np.float32(-1e9))
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        return np.einsum("tn,tn->n", weight, np.einsum("tjn,j->tn", states, self.p["out"])) + self.p["base"][0]

    def gradients(self, at: np.ndarray, labels: np.ndarray, words: tuple) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss over windows `at` whose rows are 1 + positions in `words`."""
        ids, buckets, cut = words
        p, keep, out = self.p, [], {}
        x = self.inputs(ids, buckets, cut)
        table = self.table(x)
        logit = self.forward(table, at, keep)
        states, weight, pooled = keep[2:]
        d = ((_sigmoid(logit) - labels) / len(labels)).astype(np.float32)
        out["base"], out["out"] = np.array([d.sum()]), pooled.T @ d
        d_pool = d[:, None] * p["out"]
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_score = weight * (d_weight - (weight * d_weight).sum(0))
        out["look"] = np.einsum("tn,tnh->h", d_score, states)
        d_states = weight[:, :, None] * d_pool + d_score[:, :, None] * p["look"]
        d_table = np.zeros_like(table)
        out["back"] = np.zeros_like(p["back"])
        for way in (0, 1):
            d_h, flat = np.zeros((len(at), HIDDEN), np.float32), np.zeros((at.shape[1], len(at), 3 * HIDDEN), np.float32)
            for t, before, reset, update, new, r_new in reversed(keep[way]):
                d_h = d_h + d_states[t, :, way * HIDDEN : (way + 1) * HIDDEN]
                d_new = d_h * (1 - update) * (1 - new * new)
                d_update = d_h * (before - new) * update * (1 - update)
                d_reset = d_new * r_new * reset * (1 - reset)
                flat[t] = np.concatenate([d_reset, d_update, d_new], 1)
                d_r = np.concatenate([d_reset, d_update, d_new * reset], 1)
                out["back"][way] += before.T @ d_r
                d_h = d_h * update + d_r @ p["back"][way].T
            rows, order = at.T.ravel(), np.argsort(at.T.ravel(), kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
            d_table[rows[order][edge], way * 3 * HIDDEN : (way + 1) * 3 * HIDDEN] = np.add.reduceat(flat.reshape(-1, 3 * HIDDEN)[order], edge, axis=0)
        d_gate = d_table[1:]
        out["in"], out["bias"] = x.T @ d_gate, d_gate.sum(0)
        d_x = d_gate @ p["in"].T
        out["word"], out["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(out["word"], ids, d_x[:, :EMBED] * (ids > 0)[:, None])
        sizes = np.diff(cut)
        d_run = np.repeat(d_x[:, EMBED:] / np.sqrt(sizes)[:, None], sizes, axis=0)
        flat = buckets.T.ravel()
        order = np.argsort(flat, kind="stable")
        edge = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
        out["char"][flat[order][edge]] = np.add.reduceat(np.tile(d_run, (3, 1))[order], edge, axis=0)
        return out


def _distinct(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word numbers of windows of 1-based numbers, and the windows renumbered from 1; 0 stays."""
    found, at = np.unique(windows, return_inverse=True)
    has = int(found[0] == 0)
    return found[has:] - 1, at.reshape(windows.shape) + 1 - has


def _some(words: tuple, pick: np.ndarray) -> tuple:
    """The word features of a choice of words."""
    ids, buckets, cut = words
    sizes = np.diff(cut)[pick]
    begin = np.r_[0, np.cumsum(sizes)]
    return ids[pick], buckets[np.repeat(cut[pick] - begin[:-1], sizes) + np.arange(begin[-1])], begin


def train(texts: list[str], labels: np.ndarray, seed: int = 2) -> Network:
    """A network fitted to whole texts; one text of each label at least is needed for it to tell them apart.

    A text is represented by one of its windows: by any in the first steps, later by the one that the network rates highest.
    """
    words, texts = [[normal(w) for w in t.lower().split()] for t in texts], None
    count = Counter()
    for found in words:
        count.update(set(found))
    vocabulary = {w: k + 1 for k, w in enumerate(sorted(w for w, n in count.most_common(VOCABULARY) if n >= LEAST_TEXTS))}
    net = Network(vocabulary, seed)
    number = {w: k for k, w in enumerate(sorted(count))}
    if not number or labels.min() == labels.max():
        share = min(max(float(labels.mean()), 0.01), 0.99) if len(labels) else 0.5
        net.p["out"][:] = 0
        net.p["base"][0] = np.log(share / (1 - share))
        return net
    known = net.features(list(number))
    of_text, windows = [], []
    for k, found in enumerate(words):
        coded = np.array([number[w] + 1 for w in found], np.int32)
        starts = spans(len(coded))
        if len(starts):
            coded = np.pad(coded, (0, max(0, WINDOW - len(coded))))
            windows.append(coded[starts[:, None] + np.arange(WINDOW)])
            of_text.append(np.full(len(starts), k))
    of_text, windows = np.concatenate(of_text), np.concatenate(windows)
    rng = np.random.default_rng(seed)
    first, second = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2))
    queue = np.zeros(0, int)
    for step in range(1, STEPS + 1):
        again = step > FREE_STEPS and (step - FREE_STEPS - 1) % AGAIN == 0
        if again or len(queue) < BATCH // 2:
            if step <= FREE_STEPS:
                rating = rng.random(len(windows))
            elif again:
                table = net.table(net.inputs(*known))
                rating = np.concatenate([net.rate(table, windows[k : k + CHUNK]) for k in range(0, len(windows), CHUNK)])
            order = np.lexsort((rating, of_text))
            queue = rng.permutation(order[np.r_[np.flatnonzero(np.diff(of_text[order])), len(order) - 1]])
        pick, queue = queue[:BATCH], queue[BATCH:]
        short = np.where((labels[of_text[pick]] == 0) & (rng.random(len(pick)) < CROP), rng.integers(1, WINDOW + 1, len(pick)), WINDOW)
        chosen, at = _distinct(np.where(np.arange(WINDOW) < short[:, None], windows[pick], 0))
        ids, buckets, cut = _some(known, chosen)
        change = net.gradients(at, labels[of_text[pick]], (np.where(rng.random(len(ids)) < DROP, 0, ids), buckets, cut))
        for k, g in change.items():
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g * g - second[k])
            move = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
            net.p[k] -= np.float32(RATE) * (1 - step / (STEPS + 50)) * (move + (DECAY * net.p[k] if k in ("word", "char") else 0))
            net.p[k] = net.p[k].astype(np.float32)
    return net


class Scorer:
    """Scores of whole texts with the gate inputs of a task's distinct words computed once."""

    def __init__(self, net: Network) -> None:
        self.net = net
        self._anew()

    def _anew(self) -> None:
        self.rows, self.used = {}, 1
        self.data = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.data[:1] = self.net.table(np.zeros((0, 2 * EMBED), np.float32))

    def _learn(self, new: list[str]) -> None:
        table = self.net.table(self.net.inputs(*self.net.features([normal(w) for w in new])))[1:]
        while self.used + len(new) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.used : self.used + len(new)] = table
        self.rows.update(zip(new, range(self.used, self.used + len(new))))
        self.used += len(new)

    def logits(self, texts: list[str]) -> np.ndarray:
        """The highest window's logit of each text; -inf for texts without words."""
        out, group, size = np.full(len(texts), -np.inf), [], 0
        for k, text in enumerate(texts):
            if found := text.lower().split():
                group.append((k, found))
                size += len(found)
            if size >= CHUNK * STRIDE:
                self._judge(group, out)
                group, size = [], 0
        if group:
            self._judge(group, out)
        return out

    def _judge(self, group: list, out: np.ndarray) -> None:
        new = [w for w in dict.fromkeys(chain.from_iterable(found for _, found in group)) if w not in self.rows]
        if self.used + len(new) > WORDS and self.rows:
            self._anew()
            return self._judge(group, out)
        if new:
            self._learn(new)
        windows, owner = [], []
        for k, found in group:
            coded = np.fromiter(map(self.rows.__getitem__, found), np.int32, len(found))
            if len(coded) < WINDOW:
                coded = np.pad(coded, (0, WINDOW - len(coded)))
            part = coded[spans(len(found))[:, None] + np.arange(WINDOW)]
            windows.append(part)
            owner.append(np.full(len(part), k))
        at, who = np.concatenate(windows), np.concatenate(owner)
        for k in range(0, len(at), CHUNK):
            np.maximum.at(out, who[k : k + CHUNK], self.net.rate(self.data, at[k : k + CHUNK]))

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(self.logits(texts)).round(6) if len(texts) else np.zeros(0)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE) -> Network:
    """A network learnt from about `rows` labelled documents that are not held out."""
    return train(*sample(docs, labels, "toxic", rows))


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, score): the score of every whole text, one row per input row; texts without words (null, empty) have 0.

    The network (a few MB, bounded by VOCABULARY and RUNS) is sent to every executor once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": scorer.scores(list(batch["text"])).astype(float)})

    return as_documents(docs).mapInPandas(tidy(run), "doc_id long, score double")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; null ids are not held out, repeated rows score alike, an empty
    table has no rows.  Texts without words score 0; without usable labels every other score is 1/2, with one label alone its share."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def reject(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, that score below `threshold`; null and empty texts stay.  Rows never leave their task."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(scorer.scores(texts) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
