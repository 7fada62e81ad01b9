"""Operators 5 and 6: token counts behind a digest cache, and BPE encoding and decoding by distinct words.

Both split a text into the tokenizer's own pieces with its own pattern.  Texts with code
points for which the pattern's classes might differ between libraries, or with the
tokenizer's special strings, go to the library whole.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import regex
import tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import as_documents, bounded_batches, bounded_broadcast, materialise, shared_dir, tidy

#: Distinct pieces, and distinct words made of them, that a worker remembers.
PIECES, UNITS = 600_000, 900_000
#: Characters of a block, whose distinct words a task holds, and of a compressed row of its texts.
BLOCK, PACK = 12_000_000, 1_000_000
#: Words between spaces that are remembered within a block, and pieces in one row of its list.
BLOCK_UNITS, WORD_ROW = 120_000, 5_000
BROADCAST_ROWS = 1_000_000
#: Code points whose letter, number, space and case classes are the same in all libraries and which no normal form changes.
_PLAIN = regex.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ɏ]*+")
#: White space beside white space, at an end or of another kind: there a piece may depend on more than its word.
_TANGLED = ("  ", "\n\n", " \n", "\n ", "\t", "\r")
# The pre-tokenizer patterns of the two vocabularies.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Byte -> the character that byte-level vocabularies write for it: itself where printable, else one from 256 on, in order.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
_SPACE = chr(_BYTE_CHARS[32])


@functools.lru_cache(maxsize=4)
def load(path: str) -> tokenizers.Tokenizer:
    """The tokenizer of a file every machine has, without truncation and padding."""
    found = tokenizers.Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def specials(path: str) -> tuple[str, ...]:
    """The strings that the library treats apart wherever they stand in a text."""
    return tuple(t.content for t in load(path).get_added_tokens_decoder().values())


class Memory(dict):
    """key -> value, made on demand; beyond `most` keys those that were not asked for lately are forgotten."""

    def __init__(self, make: Callable[[str], bytes], most: int) -> None:
        super().__init__()
        self.make, self.half, self.older = make, most // 2, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.half:
            self.older = dict(self)
            self.clear()
        found = self.older.get(key)
        if found is None:
            found = self.make(key)
        self[key] = found
        return found


class Splitter:
    """Texts as the joined values of their pieces; what a word between spaces gives is remembered."""

    def __init__(self, special: tuple[str, ...], pattern: str, lower: bool, value: Callable[[str], bytes], most: int | None = None) -> None:
        self.most = most or UNITS
        self.special, self.find, self.lower, self.value = special, regex.compile(pattern).findall, lower, value
        #: Pieces may hold the space before a word, or no white space at all; with other patterns texts are split as a whole.
        self.spaced, self.bare = pattern == BYTE_PATTERN and not lower, pattern == WORD_PATTERN
        self.forget()

    def forget(self) -> None:
        self.words = Memory(lambda word: self._joined(" " + word if self.spaced else word), self.most)
        self.first = Memory(self._joined, self.most // 4)

    def plain(self, text: str) -> bool:
        return _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def _joined(self, text: str) -> bytes:
        return b"".join(map(self.value, self.find(text)))

    def joined(self, text: str) -> bytes | None:
        """The values of a text's pieces, or None where only the library should split it."""
        if not self.plain(text):
            return None
        if self.lower:
            text = text.lower()
        if self.bare:
            return b"".join(map(self.words.__getitem__, text.split()))
        if not self.spaced or text[:1].isspace() or text[-1:].isspace() or any(x in text for x in _TANGLED):
            return self._joined(text)
        out, end, word = [], self.first["\n"], self.words.__getitem__
        for line in text.split("\n"):
            begin, *rest = line.split(" ")
            out.append(self.first[begin])
            out += map(word, rest)
            out.append(end)
        return b"".join(out[:-1])


class Encoder(Splitter):
    """Ids of whole texts, each remembered piece encoded once."""

    def __init__(self, path: str, pattern: str, lower: bool) -> None:
        self.tokenizer = tokenizer = load(path)
        #: The vocabulary's model can be asked directly where a piece's bytes are all that it sees.
        bytewise = (pattern == BYTE_PATTERN and not lower and tokenizer.normalizer is None) or (pattern == WORD_PATTERN and lower)
        self.piece = self.direct if bytewise else self.through
        self.pieces = Memory(self.piece, PIECES)
        super().__init__(specials(path), pattern, lower, self.pieces.__getitem__)

    def direct(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():
            seen = piece.replace(" ", _SPACE)
        else:
            seen = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_BYTE_CHARS)
        return array.array("I", [t.id for t in self.tokenizer.model.tokenize(seen)]).tobytes()

    def through(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        found = self.joined(text)
        return self.through(text) if found is None else found


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str, lower: bool) -> Encoder:
    """The encoder of a Python worker, whose next task starts with what it remembers."""
    return Encoder(path, pattern, lower)


def version(path: str) -> str:
    """Digest of the vocabulary file and the library that reads it."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read() + tokenizers.__version__.encode()).hexdigest()


def cache_folder(spark: SparkSession, path: str) -> str:
    """The folder in the shared one that all runs with a vocabulary and library keep their counts in."""
    return f"{shared_dir(spark).rstrip('/')}/factloom-token-counts/{version(path)[:16]}"


def token_counts(docs: DataFrame, path: str, cache: str | None = None, limit: int = 1024, pattern: str = BYTE_PATTERN) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; null texts are empty.

    `cache` is a Parquet folder of (version, digest, n_tokens) that later calls share; without it it is the vocabulary's
    own in the shared folder.  Contents are joined to it by SHA-256, of the misses one row a digest is encoded, and the
    counts are appended in a folder of the call's own, so calls at one time don't meet; a digest that two of them counted is
    read once.  Equal rows, equal ids and null ids are all counted; an empty table gives no rows.
    """
    spark = docs.sparkSession
    docs = as_documents(docs)
    cache, mark = cache or cache_folder(spark, path), version(path)
    own = f"{cache}/run={uuid.uuid4().hex}"
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
    rows = materialise(docs.select("doc_id", digest, F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    firsts = rows.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id"))["doc_id"].alias("doc_id"))
    schema = "version string, digest binary, n_tokens long"
    counted = lambda: spark.read.schema(schema).option("basePath", cache).parquet(f"{cache}/run=*").where(F.col("version") == mark)
    spark.createDataFrame([], schema).write.parquet(own)
    stored = counted()
    misses = materialise(firsts.join(stored, "digest", "left_anti").select(F.col("doc_id").alias("id"), F.xxhash64("digest").alias("mark")), "misses")
    chosen = bounded_broadcast(misses, misses.count(), BROADCAST_ROWS)
    texts = docs.select("doc_id", "text", digest).join(chosen, (F.xxhash64("digest") == F.col("mark")) & F.expr("doc_id <=> id"), "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = encoder(path, pattern, lower=False)
        for batch in batches:
            yield pd.DataFrame({"version": mark, "digest": batch["digest"], "n_tokens": [len(known.encode(t)) // 4 for t in batch["text"]]})

    texts.select("digest", "text").mapInPandas(tidy(run), schema).write.mode("append").parquet(own)
    counts = counted().dropDuplicates(["digest"]).select("digest", "n_tokens")
    return rows.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _with_block(batches: Iterator[pd.DataFrame], size: int) -> Iterator[tuple[int, object, str]]:
    """(block, doc_id, text): a block is a run of about `size` characters of one task's texts, or one longer text."""
    first, seen = TaskContext.get().partitionId() << 32, 0
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            yield first + seen // size, None if pd.isna(doc_id) else int(doc_id), text
            seen += len(text)


def word_lists(docs: DataFrame, path: str, pattern: str = WORD_PATTERN, lower: bool = True, size: int = BLOCK) -> DataFrame:
    """(block, words): the distinct words of every block, sorted, WORD_ROW of them in a row.  Texts that the library splits are left out."""

    special = specials(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        split, words = Splitter(special, pattern, lower, str.encode), set()

        def rows(block: int) -> pd.DataFrame:
            pieces = words
            if split.bare:
                pieces = set(itertools.chain.from_iterable(map(split.find, words)))
            found = sorted(pieces)
            parts = [found[k : k + WORD_ROW] for k in range(0, len(found), WORD_ROW)]
            return pd.DataFrame({"block": np.full(len(parts), block, np.int64), "words": pd.Series(parts, dtype=object)})

        for block, held in itertools.groupby(_with_block(batches, size), key=lambda x: x[0]):
            words.clear()
            for _, _, text in held:
                if split.plain(text):
                    text = text.lower() if lower else text
                    words.update(text.split() if split.bare else split.find(text))
            if words:
                yield rows(block)

    return as_documents(docs).mapInPandas(tidy(run), "block long, words array<string>")


def encoded_words(lists: DataFrame, path: str, pattern: str = WORD_PATTERN, lower: bool = True) -> DataFrame:
    """(block, words, sizes, ids): the ids of the words of every block, each distinct word encoded once for the whole corpus.

    All blocks that have a word meet in one task, next to one another, so it is encoded when it first comes.  Words are
    joined by NUL, the numbers of their ids and the ids are 32-bit integers.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, last, ids = Encoder(path, pattern, lower), None, b""
        for batch in batches:
            found, words, block = [], batch["word"].to_numpy(), batch["block"].to_numpy()
            for word in words:
                if word != last:
                    last, ids = word, known.piece(word)
                found.append(ids)
            order = np.argsort(block, kind="stable")
            edge = np.flatnonzero(np.r_[True, np.diff(block[order]) != 0, True]) if len(order) else np.zeros(1, int)
            out = []
            for at in (order[a:b] for a, b in itertools.pairwise(edge)):
                own = [found[k] for k in at]
                sizes = np.fromiter(map(len, own), np.int64, len(own)) // 4
                out.append((block[at[0]], "\0".join(words[at]).encode("utf-8", "surrogatepass"), sizes.astype("<u4").tobytes(), b"".join(own)))
            if out:
                yield pd.DataFrame(out, columns=["block", "words", "sizes", "ids"])

    rows = lists.select("block", F.explode("words").alias("word")).repartition("word").sortWithinPartitions("word")
    return rows.mapInPandas(tidy(run), "block long, words binary, sizes binary, ids binary")


def packed_texts(docs: DataFrame, size: int = BLOCK) -> DataFrame:
    """(block, doc_ids, sizes, texts): the documents of every block, about PACK characters in a compressed row; `sizes` are in bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=6)

        def row(block: int, doc_ids: list, texts: list) -> pd.DataFrame:
            packed = packer.compress(b"".join(texts))
            return pd.DataFrame({"block": [block], "doc_ids": [doc_ids], "sizes": [[len(t) for t in texts]], "texts": [packed]})

        for block, held in itertools.groupby(_with_block(batches, size), key=lambda x: x[0]):
            doc_ids, texts, total = [], [], 0
            for _, doc_id, text in held:
                doc_ids.append(doc_id)
                texts.append(text.encode("utf-8", "surrogatepass"))
                total += len(text)
                if total >= PACK:
                    yield row(block, doc_ids, texts)
                    doc_ids, texts, total = [], [], 0
            if doc_ids:
                yield row(block, doc_ids, texts)

    return as_documents(docs).mapInPandas(tidy(run), "block long, doc_ids array<long>, sizes array<int>, texts binary")


class _Table(dict):
    """word -> ids of one block; a word that is not in it, as when a task has read its rows in another order, is encoded here."""

    def __init__(self, encode: Callable[[], Encoder]) -> None:
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        found = self[word] = self.encode().piece(word)
        return found

    def add(self, words: bytes, sizes: bytes, ids: bytes) -> None:
        ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64) * 4
        cuts = [0, *ends.tolist()]
        if cuts[-1] != len(ids):
            raise ValueError(f"words of a block have {cuts[-1]} bytes of ids, not {len(ids)}")
        self.update(zip(words.decode("utf-8", "surrogatepass").split("\0"), (ids[a:b] for a, b in itertools.pairwise(cuts)), strict=True))


def vocabulary(path: str) -> list[str]:
    """The pieces of a vocabulary by id, special ones too."""
    return [load(path).id_to_token(k) or "" for k in range(load(path).get_vocab_size())]


def _text(ids: bytes, piece: list[str]) -> str:
    return " ".join(map(piece.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encode(docs: DataFrame, path: str, pattern: str = WORD_PATTERN, lower: bool = True, size: int = BLOCK, decoded: bool = False) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian unsigned 32-bit integers, one row per input row.

    With `decoded` their text is a third column, as `decode` gives it, made in the same task.

    Null texts are empty and have no ids; null and repeated doc_ids are rows like any other; an empty table gives no rows.
    Texts are dealt out in blocks.  The distinct words of all blocks are encoded once each in Spark, their ids joined back
    to the blocks that have them, and put where the words stood.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows sorted by (block, whether texts): a block's words with their ids, then its texts."""
        known, unpacker = functools.partial(encoder, path, pattern, lower), zstandard.ZstdDecompressor()
        current, table = None, _Table(known)
        split = Splitter(special, pattern, lower, table.__getitem__, BLOCK_UNITS)
        for batch in batches:
            for block, words, sizes, ids, doc_ids, lengths, texts in zip(*(batch[c] for c in ("block", "words", "sizes", "ids", "doc_ids", "lengths", "texts")), strict=True):
                if block != current:
                    current = block
                    table.clear()
                    split.forget()
                if texts is None:
                    table.add(words, sizes, ids)
                    continue
                whole, at, found = unpacker.decompress(texts), 0, []
                for n in lengths:
                    text = whole[at : at + n].decode("utf-8", "surrogatepass")
                    at += n
                    own = split.joined(text)
                    found.append(known().through(text) if own is None else own)
                out = pd.DataFrame({"doc_id": pd.array([None if x is None or pd.isna(x) else int(x) for x in doc_ids], dtype="Int64"), "ids": pd.Series(found, dtype=object)})
                yield out.assign(text=[_text(own, pieces.value) for own in found]) if decoded else out

    special = specials(path)
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path)) if decoded else None
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    coded = encoded_words(word_lists(docs, path, pattern, lower, size), path, pattern, lower)
    coded = coded.select("block", F.lit(0).alias("kind"), "words", "sizes", "ids", *none("array<long>", "doc_ids"), *none("array<int>", "lengths"), *none("binary", "texts"))
    texts = packed_texts(docs, size).select("block", F.lit(1).alias("kind"), *none("binary", "words", "sizes", "ids"), "doc_ids", F.col("sizes").alias("lengths"), "texts")
    rows = texts.unionByName(coded).repartition("block").sortWithinPartitions("block", "kind")
    return rows.mapInPandas(tidy(run), "doc_id long, ids binary, text string" if decoded else "doc_id long, ids binary")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of `encode` with their text: ids joined to the vocabulary's pieces as the library's decode does without a decoder, special ones kept.

    The vocabulary is the bounded side of the join and is sent to every task.  Rows without ids have empty texts.
    """
    pieces = encoded.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(text=pd.Series([_text(ids, pieces.value) for ids in batch["ids"]], index=batch.index, dtype=object))

    bounded_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInPandas(tidy(run), "doc_id long, ids binary, text string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and SHA-256 of the ids and of the decoded text, one row per input row; edge cases as in `encode`."""
    both = encode(docs, path, decoded=True)
    text = F.sha2(F.col("text").cast("binary"), 256)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), text.alias("decoded_sha256"))
