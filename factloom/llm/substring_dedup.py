"""Operator 9: removal of passages that a document with a smaller doc_id has too, by suffix automata of reference documents.

References are the corpus itself.  The suffix automata of those that most words are
streamed past are broadcast, HOT_WORDS words of them in all; for the rest no bound is
known, so they are dealt out: each task builds those of its reference documents, from
their repeated text alone, and only documents that may match are streamed past.

* A window of WINDOW words has one anchor, the least hash among its runs of ANCHOR
  words; equal windows have equal anchors.  The least doc_id that has an anchor owns it.
* A document's windows with a shared anchor form spans, each sent to the anchor's owner.
  The owner's spans become a suffix automaton; the others are streamed through it, and
  where the matching statistic reaches WINDOW, the window also starts in the owner.
* Windows that share an anchor but not their words with the owner are compared with one
  another by hash and least doc_id, which finds the rest exactly.

A reference that very many words are streamed past is repeated over several tasks, and one
with very many repeated anchors is split by anchors into pieces of about PIECE.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import WordHashes, as_documents, bounded_broadcast, materialise, tidy, windows, words_of

WINDOW = 13
ANCHOR = 5
#: Words streamed past one copy of a reference, about.
STREAM_WORDS = 200_000
#: Reference words whose automata are broadcast (some 500 bytes each), and words streamed past a reference that make it worth it.
HOT_WORDS, HOT_STREAM = 30_000, 50_000
#: Repeated anchors of a reference in one automaton, and references that may have more (16 bytes each).
PIECE, PIECED = 20_000, 200_000
BROADCAST_IDS = 1_000_000
#: Distinct words a task remembers hashes of, and spans of a reference whose matching statistics it remembers.
WORDS, REMEMBERED = 600_000, 5_000
OWNER, MATCH, OPEN = 0, 1, 2


class SuffixAutomaton:
    """States of all substrings of a token sequence; `longest` gives matching statistics."""

    def __init__(self, tokens) -> None:
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]
        last = 0
        for token in tokens:
            state = len(self.size)
            self.next.append({})
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            at = last
            while at >= 0 and token not in self.next[at]:
                self.next[at][token] = state
                at = self.link[at]
            if at >= 0:
                to = self.next[at][token]
                if self.size[to] == self.size[at] + 1:
                    self.link[state] = to
                else:
                    copy = len(self.size)
                    self.next.append(dict(self.next[to]))
                    self.size.append(self.size[at] + 1)
                    self.link.append(self.link[to])
                    while at >= 0 and self.next[at].get(token) == to:
                        self.next[at][token] = copy
                        at = self.link[at]
                    self.link[to] = self.link[state] = copy
            last = state

    def longest(self, tokens) -> np.ndarray:
        """Length of the longest substring that ends at each token."""
        out, state, length = [], 0, 0
        step, link, size = self.next, self.link, self.size
        for token in tokens:
            to = step[state].get(token)
            while to is None and state:
                state = link[state]
                length = size[state]
                to = step[state].get(token)
            if to is not None:
                state, length = to, length + 1
            out.append(length)
        return np.array(out, np.int64)


def text_key(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _anchors(hashes: np.ndarray) -> np.ndarray:
    """The anchor of each window."""
    runs = windows(hashes, ANCHOR)
    return np.lib.stride_tricks.sliding_window_view(runs, WINDOW - ANCHOR + 1).min(1) if len(hashes) >= WINDOW else np.zeros(0, np.uint64)


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = WordHashes(WORDS)
    for batch in batches:
        ids, found = [], []
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            found.append(np.unique(_anchors(hashes.of(words_of(text)))))
            ids.append(np.full(len(found[-1]), doc_id, np.int64))
        yield pd.DataFrame({"anchor": np.concatenate(found).view(np.int64), "doc_id": np.concatenate(ids)})


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of True."""
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return edge[::2], edge[1::2] - edge[::2]


def _spans(pieces: dict[int, int]):
    """Runs of windows whose anchors have the same owner and piece of it, as (owner, piece, doc_id, key, start, n, words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(WORDS)
        for batch in batches:
            out = []
            for doc_id, text, anchors, owners in zip(batch["doc_id"], batch["text"], batch["anchors"], batch["owners"], strict=True):
                words = words_of(text)
                if len(words) < WINDOW:
                    continue
                own = np.asarray(anchors, np.int64).view(np.uint64)
                order = np.argsort(own)
                own, owners = own[order], np.asarray(owners, np.int64)[order]
                here = _anchors(hashes.of(words))
                at = np.minimum(np.searchsorted(own, here), len(own) - 1)
                known = own[at] == here
                owner, piece = np.where(known, owners[at], 0), np.zeros(len(here), np.int64)
                if pieces:
                    for one in np.unique(owner[known]).tolist():
                        if one in pieces:
                            piece = np.where(owner == one, (here % np.uint64(pieces[one])).astype(np.int64), piece)
                edge = np.flatnonzero(np.r_[True, (known[1:] != known[:-1]) | (owner[1:] != owner[:-1]) | (piece[1:] != piece[:-1]), True])
                key = text_key(text)
                for a, b in zip(edge[:-1], edge[1:], strict=True):
                    if known[a]:
                        out.append((owner[a], piece[a], doc_id, key, a, b - a + WINDOW - 1, b" ".join(words[a : b + WINDOW - 1])))
            if out:
                yield pd.DataFrame(out, columns=["owner", "piece", "doc_id", "key", "start", "n", "words"])

    return run


class _Statistics(dict):
    """A span's words -> its windows that are in the automaton, as (start, n), and the others, as (start, hash); a span that many documents share is streamed once."""

    def __init__(self, automaton: SuffixAutomaton, hashes: WordHashes) -> None:
        super().__init__()
        self.automaton, self.hashes = automaton, hashes

    def __missing__(self, words: bytes) -> tuple[list, list]:
        tokens = words.split(b" ")
        hit = self.automaton.longest(tokens)[WINDOW - 1 :] >= WINDOW
        rest = np.flatnonzero(~hit)
        h = windows(self.hashes.of(tokens), WINDOW).view(np.int64)[rest] if len(rest) else rest
        found = list(zip(*_ranges(hit), strict=True)), list(zip(rest, h, strict=True))
        if len(self) < REMEMBERED:
            self[words] = found
        return found

    def rows(self, words: bytes, doc_id: int, key: int, start: int) -> list[tuple]:
        inside, outside = self[words]
        return [(MATCH, doc_id, key, start + a, n, 0) for a, n in inside] + [(OPEN, doc_id, key, start + a, 1, h) for a, h in outside]


_JUDGED = ["kind", "doc_id", "key", "start", "n", "h"]


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by (owner, piece, salt, role): an owner's spans, then the documents to be matched with them."""
    hashes = WordHashes(WORDS)
    current, known, reference, seen = None, None, [], set()
    for batch in batches:
        out = []
        for owner, piece, salt, role, doc_id, key, start, words in zip(*(batch[c] for c in ("owner", "piece", "salt", "role", "doc_id", "key", "start", "words")), strict=True):
            if (owner, piece, salt) != current:
                current, known, reference, seen = (owner, piece, salt), None, [], set()
            if role == OWNER:
                if words not in seen:
                    seen.add(words)
                    reference += [len(reference), *words.split(b" ")]
                continue
            if known is None:
                known, reference, seen = _Statistics(SuffixAutomaton(reference), hashes), [], set()
            out += known.rows(words, doc_id, key, start)
        if out:
            yield pd.DataFrame(out, columns=_JUDGED)


def _hot(automata):
    """Spans streamed through the broadcast automata of their owners."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes(WORDS)
        known = {owner: _Statistics(automaton, hashes) for owner, automaton in automata.value.items()}
        for batch in batches:
            rows = zip(*(batch[c] for c in ("owner", "words", "doc_id", "key", "start")), strict=True)
            out = list(chain.from_iterable(known[owner].rows(words, doc_id, key, start) for owner, words, doc_id, key, start in rows))
            if out:
                yield pd.DataFrame(out, columns=_JUDGED)

    return run


def _broadcast_automata(spans: DataFrame) -> dict[int, SuffixAutomaton]:
    """Automata of the references that most words are streamed past, HOT_WORDS of their words at most."""
    sums = spans.groupBy("owner").agg(F.sum(F.when(F.col("doc_id") == F.col("owner"), F.col("n"))).alias("own"), F.sum(F.when(F.col("doc_id") != F.col("owner"), F.col("n"))).alias("past"))
    room, chosen = HOT_WORDS, []
    for row in sums.where((F.col("past") >= HOT_STREAM) & (F.col("own") <= HOT_WORDS)).orderBy(F.desc("past"), "owner").limit(HOT_WORDS // WINDOW).collect():
        if row.own <= room:
            chosen.append(row.owner)
            room -= row.own
    texts: dict[int, list] = {owner: [] for owner in chosen}
    if chosen:
        for row in spans.where((F.col("doc_id") == F.col("owner")) & F.col("owner").isin(chosen)).select("owner", "words").distinct().collect():
            texts[row.owner] += [len(texts[row.owner]), *bytes(row.words).split(b" ")]
    return {owner: SuffixAutomaton(tokens) for owner, tokens in texts.items()}


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for doc_id, text, starts, sizes in zip(*(batch[c] for c in ("doc_id", "text", "starts", "sizes")), strict=True):
            words = words_of(text)
            gone = np.zeros(len(words) + 1, np.int64)
            if starts is not None and len(starts):
                np.add.at(gone, np.asarray(starts), 1)
                np.add.at(gone, np.asarray(starts) + np.asarray(sizes) + WINDOW - 1, -1)
            keep = gone.cumsum()[:-1] == 0
            kept = b" ".join(w for w, k in zip(words, keep, strict=True) if k)
            out.append((doc_id, len(words), int(len(words) - keep.sum()), kept.decode("utf-8", "surrogatepass")))
        ids = pd.array([None if pd.isna(x[0]) else int(x[0]) for x in out], dtype="Int64")
        yield pd.DataFrame({"doc_id": ids, "n_words": [x[1] for x in out], "n_removed": [x[2] for x in out], "kept_text": [x[3] for x in out]})


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, key, start, n): runs of n windows of WINDOW words that also start in a document with a smaller doc_id; key is the text's hash."""
    known = as_documents(docs).where("doc_id is not null")
    anchors = materialise(known.mapInPandas(tidy(_shared), "anchor long, doc_id long"), "anchors")
    owners = anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("owner < other")
    lists = anchors.distinct().join(owners, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"), F.collect_list("owner").alias("owners"))
    lists = materialise(lists, "lists")
    count = lists.count()
    chosen = bounded_broadcast(lists.select("doc_id"), count, BROADCAST_IDS)
    piece = PIECE
    while lists.where(F.size("anchors") > piece).count() > PIECED:
        piece *= 2
    pieces = {r.doc_id: r.n for r in lists.where(F.size("anchors") > piece).select("doc_id", F.ceil(F.size("anchors") / piece).cast("int").alias("n")).collect()}
    schema = "owner long, piece long, doc_id long, key long, start long, n long, words binary"
    spans = materialise(known.join(chosen, "doc_id", "left_semi").join(lists, "doc_id").mapInPandas(tidy(_spans(pieces)), schema), "spans")
    other = F.col("doc_id") != F.col("owner")
    automata = _broadcast_automata(spans)
    hot = F.col("owner").isin(list(automata))
    judged_schema = "kind int, doc_id long, key long, start long, n long, h long"
    shared = docs.sparkSession.sparkContext.broadcast(automata)
    near = spans.where(hot & other).select("owner", "words", "doc_id", "key", "start").mapInPandas(tidy(_hot(shared)), judged_schema)
    spans = spans.where(~hot)
    load = spans.where(other).groupBy("owner", "piece").agg(F.ceil(F.sum("n") / STREAM_WORDS).cast("int").alias("salts"))
    load = materialise(load.where("salts > 1"), "load")
    salted = spans.join(bounded_broadcast(load, load.count(), BROADCAST_IDS), ["owner", "piece"], "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    role = F.when(other, MATCH).otherwise(OWNER)
    pick = F.pmod(F.xxhash64("doc_id", "start"), F.col("salts")).cast("int")
    salts = F.when(role == OWNER, F.sequence(F.lit(0), F.col("salts") - 1)).otherwise(F.array(pick))
    judged = (
        salted.select("owner", "piece", "doc_id", "key", "start", "words", role.alias("role"), F.explode(salts).alias("salt"))
        .repartition("owner", "piece", "salt")
        .sortWithinPartitions("owner", "piece", "salt", "role")
        .mapInPandas(tidy(_stream), judged_schema)
    )
    if automata:
        judged = judged.unionByName(near)
    judged = materialise(judged, "judged")
    open_ = judged.where(F.col("kind") == OPEN)
    least = open_.groupBy("h").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    more = open_.join(least, "h").where("doc_id > least")
    return judged.where(F.col("kind") == MATCH).select("doc_id", "key", "start", "n").unionByName(more.select("doc_id", "key", "start", "n"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Documents without the words covered by windows that also start in a document with a smaller doc_id.

    Returns doc_id, n_words, n_removed and kept_text (kept words joined by a space), one row per input row.  Null texts are
    empty; texts of fewer than WINDOW words lose nothing; a null doc_id is neither larger nor smaller than any, so its row is
    kept whole and removes nothing.  Rows that share a doc_id don't remove one another's words.
    """
    docs = as_documents(docs)
    gone = repeated_ranges(docs).groupBy("doc_id", "key").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    gone = materialise(gone, "gone")
    count = gone.count()
    ids = bounded_broadcast(gone.select("doc_id").distinct(), count, BROADCAST_IDS)
    none = F.lit(None).cast("array<long>")
    whole = docs.join(ids, "doc_id", "left_anti").select("doc_id", "text", none.alias("starts"), none.alias("sizes"))
    keyed = docs.join(ids, "doc_id", "left_semi").mapInPandas(tidy(_with_key), "doc_id long, key long, text string")
    some = keyed.join(gone, ["doc_id", "key"], "left").select("doc_id", "text", "starts", "sizes")
    schema = "doc_id long, n_words long, n_removed long, kept_text string"
    return whole.mapInPandas(tidy(_cut), schema).unionByName(some.mapInPandas(tidy(_cut), schema))


def _with_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"doc_id": batch["doc_id"], "key": [text_key(t) for t in batch["text"]], "text": batch["text"]})


def digest(df: DataFrame) -> DataFrame:
    """The columns of `remove_repeats` with the kept text's SHA-256 in its place."""
    return df.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
