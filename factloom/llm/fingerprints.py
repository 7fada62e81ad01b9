"""Operator 3: MinHash fingerprints of whole texts, and pairs of like documents by signature bands.

A signature holds the least value of each of HASHES universal hash functions
a * x + b (mod 2**32) over a text's word shingles, taken in vectorised numpy a few
hundred shingles at a time.  The share of equal entries estimates the Jaccard
similarity.  `like_pairs` joins bands of signatures in Spark and verifies the
similarity on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import WordHashes, as_documents, materialise, shingles, tidy
from factloom.llm.near_dedup import BLOCK, SLACK, _node, _root

HASHES = 64
WIDTH = 5
BAND = 4
_SEED = np.random.default_rng(3)
_MUL = _SEED.integers(0, 2**31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _SEED.integers(0, 2**32, HASHES, dtype=np.uint64).astype(np.uint32)


def signature(items: np.ndarray) -> np.ndarray:
    """Least value of each hash function over a set of 64-bit hashes; all ones for the empty set."""
    least = np.full(HASHES, 2**32 - 1, np.uint32)
    low = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 512):
        part = low[k : k + 512, None] * _MUL
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    return least


def _bytes(sig: np.ndarray) -> bytes:
    return sig.astype(">u4").tobytes()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, fingerprint): the signature of every whole text as hexadecimal text; null is empty, empty texts share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield batch.assign(fingerprint=[_bytes(signature(shingles(t, width, hashes))).hex() for t in batch["text"]])

    return as_documents(docs).mapInPandas(tidy(run), "doc_id long, text string, fingerprint string")


def edited_fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Fingerprints of each text and of its edited text: the last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document.

    Documents follow one another by doc_id; nulls come first and rows of equal doc_id by a hash of their text.  A table of
    one row follows itself.  Empty texts have a fingerprint of their own, likeness 1 with one another.
    """
    docs = as_documents(docs)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie")]
    dealt = docs.withColumn("tie", F.xxhash64("text")).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def signed(batch: pd.DataFrame, column: str, hashes: WordHashes) -> list:
        return [signature(shingles(t, width, hashes)) for t in batch[column]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Within a partition the next row follows; a partition's last row goes out with its text, and the partition's first text with it."""
        hashes = WordHashes()
        rows, first = [], None
        for batch in batches:
            rows += zip(_ids(batch["doc_id"]), batch["text"], signed(batch, "text", hashes), strict=True)
            first = first if first is not None or not rows else rows[0][1]
            if len(rows) > 1:
                yield _frame([_judge(*rows[k], *rows[k + 1][1:], width, hashes) + (None, None) for k in range(len(rows) - 1)])
            rows = rows[-1:]
        if rows:
            yield _frame([(rows[0][0], None, None, None, None, None, None, rows[0][1], first)])

    schema = "doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, last_text string, first_text string"
    out = materialise(dealt.mapInPandas(tidy(run), schema), "fingerprints")
    ends = out.where("last_text is not null")
    by = Window.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("last_text"))
    joined = ends.select("doc_id", "last_text", F.lead("first_text").over(by).alias("next"), F.first("first_text").over(by).alias("start"))
    joined = joined.select("doc_id", "last_text", F.coalesce("next", "start").alias("next"))

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            rows = zip(_ids(batch["doc_id"]), batch["last_text"], signed(batch, "last_text", hashes), batch["next"], signed(batch, "next", hashes), strict=True)
            yield _frame([_judge(*row, width, hashes) + (None, None) for row in rows])

    # Bytes on disk, hexadecimal text in the result.
    columns = ["doc_id", "n_chars", *(F.lower(F.hex(c)).alias(c) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), "near_edited", "near_next"]
    return out.where("last_text is null").select(*columns).unionByName(joined.mapInPandas(tidy(close), schema).select(*columns))


def _ids(column: pd.Series) -> list:
    return [None if pd.isna(x) else int(x) for x in column]


def _judge(doc_id, text: str, own: np.ndarray, following: str, after: np.ndarray, width: int, hashes: WordHashes) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + following[: n // 2]
    other = signature(shingles(edited, width, hashes))
    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest()
    return doc_id, n, digest, _bytes(own), _bytes(other), likeness(own, other), likeness(own, after)


def _frame(rows: list) -> pd.DataFrame:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "last_text", "first_text"]
    return pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingles(t, width, hashes) for t in batch["text"]]
            yield batch.assign(node=[_node(x) for x in sets], n=[len(x) for x in sets], fingerprint=[_bytes(signature(x)).hex() for x in sets])

    return run


def _compare(width: int, threshold: float):
    """Verified links of rows sorted by (bucket, x, y): the two blocks of one bucket at a time, pairs in falling order of their likeness.

    A pair is judged in the first band it shares, and only while verified links don't connect it yet.
    """
    least = threshold - SLACK * (threshold * (1 - threshold) / HASHES) ** 0.5

    def links(frame: pd.DataFrame, hashes: WordHashes) -> list:
        sigs = np.frombuffer(bytes.fromhex("".join(frame["fingerprint"])), ">u4").reshape(-1, HASHES)
        node, block, text = frame["node"].to_numpy(), frame["block"].to_numpy(), frame["text"].to_numpy()
        ids, own, band = frame["doc_id"].to_numpy(), frame["x"].iloc[0] == frame["y"].iloc[0], frame["band"].iloc[0]
        found = []
        for i in range(len(frame) - 1):
            same = sigs[i] == sigs[i + 1 :]
            j = np.flatnonzero((same.mean(1) >= least) & (own | (block[i + 1 :] != block[i])))
            j = j[same[j].reshape(len(j), HASHES // BAND, BAND).all(2).argmax(1) == band]
            found += zip(-same[j].mean(1), [i] * len(j), (j + i + 1).tolist(), strict=True)
        parent, items, out = {}, {}, []
        for _, i, j in sorted(found):
            if _root(parent, node[i]) == _root(parent, node[j]):
                continue
            for k in (i, j):
                if k not in items:
                    items[k] = shingles(text[k], width, hashes)
            both = len(np.intersect1d(items[i], items[j], assume_unique=True))
            share = both / (len(items[i]) + len(items[j]) - both)
            if share >= threshold:
                parent[_root(parent, node[i])] = _root(parent, node[j])
                out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), share))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, hashes = None, WordHashes()

        def judged(frame: pd.DataFrame) -> pd.DataFrame:
            out = [row for _, group in frame.groupby(["bucket", "x", "y"], sort=False) for row in links(group, hashes)]
            return pd.DataFrame(out, columns=["representative", "doc_id", "jaccard"])

        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            key = frame[["bucket", "x", "y"]]
            open_ = (key == key.iloc[-1]).all(axis=1)
            rest = frame[open_]
            if not open_.all():
                yield judged(frame[~open_])
        if rest is not None and len(rest):
            yield judged(rest)

    return run


def like_pairs(docs: DataFrame, width: int = WIDTH, threshold: float = 0.8) -> DataFrame:
    """(representative, doc_id, jaccard): links between documents that share a signature band, verified on full sets, the smaller doc_id first.

    All members of a band's bucket are compared by their signatures, in blocks of BLOCK rows; links of one pair of blocks
    are a forest, so a pair that other links connect has no link of its own.  Texts with the same shingles are one node
    and link to its least doc_id; different texts that share an id are documents of their own.  Null doc_ids and texts
    without words have no links.
    """
    kept = as_documents(docs).where("doc_id is not null")
    prints = kept.mapInPandas(tidy(_sketch(width)), "doc_id long, text string, node long, n long, fingerprint string").where("n > 0")
    prints = materialise(prints, "prints")
    nodes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "text", "fingerprint")).alias("first")).select("node", "first.*")
    nodes = materialise(nodes, "nodes")
    copies = prints.select("node", F.col("doc_id").alias("other")).distinct().join(nodes.select("node", "doc_id"), "node").where("other > doc_id")
    step = BAND * 8
    bands = F.array(*(F.substring("fingerprint", k * step + 1, step) for k in range(HASHES // BAND)))
    rows = nodes.select("node", F.posexplode(bands).alias("band", "part")).select("node", "band", F.xxhash64("band", "part").alias("bucket"))
    met = rows.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1").select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = (
        rows.join(met, "bucket")
        .withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("bucket", "band", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
        .join(nodes, "node")
        .repartition("bucket", "x", "y")
        .sortWithinPartitions("bucket", "x", "y")
    )
    links = dealt.mapInPandas(tidy(_compare(width, threshold)), "representative long, doc_id long, jaccard double")
    return links.unionByName(copies.select(F.col("doc_id").alias("representative"), F.col("other").alias("doc_id"), F.lit(1.0).alias("jaccard"))).distinct()
