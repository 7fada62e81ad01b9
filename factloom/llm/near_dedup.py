"""Operator 7: near-duplicate groups from SetSketch registers.

A document's set of word shingles becomes REGISTERS truncated minima of
exponential variates, stored as floor(1 - log_BASE(min)) in one byte.  Sketches of
parts merge by the larger register, and equal registers become likelier with the
Jaccard similarity.  Documents that agree in a band of registers meet in a bucket;
within a bucket the Jaccard similarity of two sketches is estimated jointly with
the known set sizes by maximum likelihood, and what may reach the threshold is
verified on the full sets of words, unless verified links connect it already.

Exact copies of a set are one node from the start, and buckets with the same members
are looked at once.  A large bucket is dealt out in blocks of about BLOCK rows, each
compared within itself; as every bucket is dealt in another way, a large group is
connected after that.  What is not, is compared across the blocks in a second round:
nodes outside the bucket's largest component meet all its blocks, and where they fill
more than a block themselves, every pair of blocks meets.  So no task ever holds more
than two blocks, no pair is lost, and a text isn't sent to every block of its group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import MASK, WordHashes, as_documents, bounded_broadcast, discard, materialise, mixed, shingles, tidy
from factloom.llm.components import components

REGISTERS = 384
BASE = 1.083
RATE = 20.0
TOP = 255
#: Rows of a bucket that one task compares with one another at a time, on average.
BLOCK = 1024
#: Standard errors of the estimate that a pair may miss the threshold by and still be verified.
SLACK = 3.7
#: Ids that are broadcast (8 bytes each); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
_SEED = np.random.default_rng(7)
_MUL = _SEED.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _SEED.integers(0, 2**32, REGISTERS, dtype=np.uint64).astype(np.uint32)


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes; of the empty set all 0."""
    least = np.full(REGISTERS, 2**32 - 1, np.uint32)
    if not len(items):
        return np.zeros(REGISTERS, np.uint8)
    low = (items >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(low), 256):
        part = low[k : k + 256, None] * _MUL
        part += _ADD
        np.minimum(least, part.min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(variate) / np.log(BASE)), 0, TOP).astype(np.uint8)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihood_jaccard(lower: np.ndarray, higher: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 128) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from the counts of registers where a is lower or higher than b and the set sizes."""
    u = n_a / (n_a + n_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, steps)[None, :] * most[:, None] * (1 - 1e-9)
    below = np.clip(_p(np.clip(v[:, None] - u[:, None] * grid, 0, 1)), 1e-12, 1)
    above = np.clip(_p(np.clip(u[:, None] - v[:, None] * grid, 0, 1)), 1e-12, 1)
    same = np.clip(1 - below - above, 1e-12, 1)
    equal = REGISTERS - lower - higher
    score = lower[:, None] * np.log(below) + higher[:, None] * np.log(above) + equal[:, None] * np.log(same)
    return grid[np.arange(len(grid)), score.argmax(axis=1)]


def estimates(regs: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """Joint estimates of the pairs i, j; 0 where too few registers agree for `least`."""
    out = np.zeros(len(i))
    for k in range(0, len(i), 4096):
        a, b = i[k : k + 4096], j[k : k + 4096]
        near = np.flatnonzero((regs[a] == regs[b]).sum(1) >= REGISTERS * (least - 0.15))
        if len(near):
            a, b = a[near], b[near]
            out[k + near] = likelihood_jaccard((regs[a] < regs[b]).sum(1), (regs[a] > regs[b]).sum(1), sizes[a].astype(float), sizes[b].astype(float))
    return out


def _agreeing(regs: np.ndarray, left: np.ndarray, right: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the rows left and right with enough equal registers, a few rows at a time."""
    found = [(left[:0], left[:0])]
    for k in range(0, len(left), 32):
        rows = left[k : k + 32]
        equal = (regs[rows][:, None, :] == regs[right][None, :, :]).sum(2)
        x, y = np.nonzero(equal >= REGISTERS * (least - 0.15))
        found.append((rows[x], right[y]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _root(parent: dict, x: int) -> int:
    while (up := parent.setdefault(x, x)) != x:
        parent[x] = parent.setdefault(up, up)  # a label may be a node that isn't here
        x = up
    return x


def _compare(width: int, percent: int, least: float, rows: int):
    """Verified links of rows sorted by (bucket, x, y); holds the two blocks of one bucket at a time.

    Nodes of one label are connected already.  A pair is judged in the first band it shares, in falling order of its estimate,
    and only while verified links don't connect it yet: the links are a forest.
    """
    threshold, count = percent / 100, REGISTERS // rows

    def candidates(frame: pd.DataFrame, regs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = frame[["bucket", "x", "y"]].to_numpy()
        cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1), True])
        side, own, sizes = frame["block"].to_numpy(), key[:, 1] == key[:, 2], np.diff(cut)
        group, few = np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes <= 8, sizes)
        found = []
        for lag in range(1, min(8, len(frame))):
            i = np.flatnonzero(few[:-lag] & (group[:-lag] == group[lag:]) & (own[:-lag] | (side[:-lag] != side[lag:])))
            found.append((i, i + lag))
        for k in np.flatnonzero(sizes > 8):
            at = np.arange(cut[k], cut[k + 1])
            if own[at[0]]:
                i, j = _agreeing(regs, at, at, least)
                found.append((i[i < j], j[i < j]))
            else:
                low = side[at] == key[at[0], 1]
                found.append(_agreeing(regs, at[low], at[~low], least))
        return np.concatenate([x for x, _ in found]).astype(int), np.concatenate([y for _, y in found]).astype(int)

    def links(frame: pd.DataFrame, hashes: WordHashes) -> pd.DataFrame:
        regs = np.frombuffer(b"".join(frame["regs"]), np.uint8).reshape(-1, REGISTERS)
        node, n, text = frame["node"].to_numpy(), frame["n"].to_numpy(), frame["text"].to_numpy()
        label = frame["label"].to_numpy()
        band = frame["bucket"].to_numpy() & 63
        i, j = candidates(frame, regs) if len(frame) > 1 else (np.zeros(0, int), np.zeros(0, int))
        fits = (np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j])) & (label[i] != label[j])
        i, j = i[fits], j[fits]
        first = np.zeros(len(i), bool)
        for k in range(0, len(i), 4096):
            a, b = i[k : k + 4096], j[k : k + 4096]
            agree = (regs[a, : count * rows] == regs[b, : count * rows]).reshape(len(a), count, rows).all(2)
            first[k : k + 4096] = agree.argmax(1) == band[a]
        i, j = i[first], j[first]
        est = estimates(regs, n, i, j, least)
        items, parent, out = {}, dict(zip(node.tolist(), label.tolist())), []
        for k in np.argsort(-est, kind="stable"):
            if est[k] < least:
                break
            a, b = int(node[i[k]]), int(node[j[k]])
            if _root(parent, a) == _root(parent, b):
                continue
            for at in (i[k], j[k]):
                if int(node[at]) not in items:
                    items[int(node[at])] = shingles(text[at], width, hashes)
            x, y = items[a], items[b]
            both = int((x[np.minimum(np.searchsorted(x, y), len(x) - 1)] == y).sum())
            if 100 * both >= percent * (len(x) + len(y) - both):
                parent[_root(parent, a)] = _root(parent, b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest, hashes = None, WordHashes()
        for batch in batches:
            frame = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if not len(frame):
                continue
            last = frame[["bucket", "x", "y"]].iloc[-1]
            open_ = ((frame["bucket"] == last["bucket"]) & (frame["x"] == last["x"]) & (frame["y"] == last["y"])).to_numpy()
            rest, done = frame[open_], frame[~open_]
            if len(done):
                yield links(done.reset_index(drop=True), hashes)
        if rest is not None and len(rest):
            yield links(rest.reset_index(drop=True), hashes)

    return run


def _node(items: np.ndarray) -> int:
    """A digest of the set as a signed 64-bit id: equal sets are one node."""
    if not len(items):
        return 0
    first = mixed(items)
    digest = int(first.sum(dtype=np.uint64)) * 3 + int(np.bitwise_xor.reduce(mixed(first))) * 5 + len(items)
    return int(np.uint64(digest & MASK).astype(np.int64))


def _with_node(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            yield pd.DataFrame({"node": [_node(shingles(text, width, hashes)) for text in batch["text"]], "text": batch["text"]})

    return run


def _sketch(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = WordHashes()
        for batch in batches:
            out = []
            for text in batch["text"]:
                items = shingles(text, width, hashes)
                out.append((len(items), _node(items), registers(items).tobytes()))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "mark": batch["mark"], "n": [x[0] for x in out], "node": [x[1] for x in out], "regs": [x[2] for x in out]})

    return run


def _bands(rows: int):
    """(bucket, node) for every band of registers; the last six bits of a bucket are its band."""
    count = REGISTERS // rows
    salt = mixed(np.arange(1, count + 1, dtype=np.uint64))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), 1000):
                part = batch.iloc[k : k + 1000]
                regs = np.frombuffer(b"".join(part["regs"]), np.uint8).reshape(-1, REGISTERS)
                wide = np.zeros((len(part), count, 8), np.uint8)
                wide[:, :, :rows] = regs[:, : count * rows].reshape(len(part), count, rows)
                keys = mixed(wide.view(np.uint64)[:, :, 0] + salt) & np.uint64(MASK - 63) | np.arange(count, dtype=np.uint64)
                yield pd.DataFrame({"bucket": keys.ravel().view(np.int64), "node": np.repeat(part["node"].to_numpy(), count)})

    return run


def _across(large: DataFrame) -> DataFrame:
    """The rows of the second round: (bucket, node, block, x, y, label) of what large buckets still have to compare across blocks.

    Few nodes outside the main component are a block of their own, -1, which meets itself and every other.
    """
    sizes = large.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    sizes = sizes.groupBy("bucket").agg(F.max_by("label", "n").alias("main"), (F.sum("n") - F.max("n")).alias("others")).where("others > 0")
    rest = large.join(sizes, "bucket")
    every = lambda first: F.sequence(F.lit(first), F.col("blocks") - 1)
    outside = F.col("label") != F.col("main")
    few = rest.where(F.col("others") <= BLOCK).select(
        "bucket", "node", F.when(outside, -1).otherwise(F.col("block")).alias("block"), F.explode(F.when(outside, every(-1)).otherwise(F.array("block"))).alias("x"), F.lit(-1).alias("y"), "label"
    )
    many = rest.where(F.col("others") > BLOCK).withColumn("other", F.explode(every(0))).where("other <> block")
    many = many.select("bucket", "node", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "label")
    return few.unionByName(many)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of at least percent/100 over shingles of `width` words.

    Returns doc_id, n_shingles, component_id (the least doc_id reachable over links) and kept (doc_id is component_id),
    one row per input row.  Null or empty texts have no shingles, link with nothing and are kept.  Rows with equal doc_id
    are documents of their own that share an id; a row with null doc_id gets the least other id of its group, or null.
    """
    return _groups(docs, width, percent).drop("mark")


def _groups(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The rows of `near_duplicates` with mark, the xxhash64 of their text."""
    docs = as_documents(docs)
    threshold = percent / 100
    least = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    rows = 8 if percent >= 84 else 6
    sketched = docs.withColumn("mark", F.xxhash64("text")).mapInPandas(tidy(_sketch(width)), "doc_id long, mark long, n long, node long, regs binary")
    sketched = materialise(sketched, "sketches")
    full = sketched.where("n > 0")
    nodes = materialise(full.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n", "regs")).alias("first")).select("node", "first.doc_id", "first.n", "first.regs"), "nodes")
    bands = materialise(nodes.select("node", "regs").mapInPandas(tidy(_bands(rows)), "bucket long, node long"), "bands")
    met = bands.groupBy("bucket").agg(F.count("*").alias("m"), F.min("node").alias("lo"), F.max("node").alias("hi"), F.bit_xor(F.xxhash64("node")).alias("mark")).where("m > 1")
    low = F.min(F.struct(F.col("bucket").bitwiseAND(63).alias("band"), "bucket"))["bucket"]
    met = met.groupBy("m", "lo", "hi", "mark").agg(low.alias("bucket")).select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    members = materialise(bands.join(met, "bucket").select("bucket", "node", "blocks"), "members")
    ends = materialise(members.select("node").distinct().join(nodes.select("node", "doc_id"), "node"), "ends")
    few = ends.count()
    chosen = bounded_broadcast(ends.select(F.col("doc_id").alias("id")).distinct(), few, BROADCAST_IDS)
    bodies = docs.join(chosen, F.expr("doc_id <=> id"), "left_semi").mapInPandas(tidy(_with_node(width)), "node long, text string")
    bodies = bodies.join(bounded_broadcast(ends.select("node"), few, BROADCAST_IDS), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))
    bodies = materialise(bodies.join(nodes.select("node", "n", "regs"), "node"), "bodies")
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node", "bucket"), F.col("blocks")).cast("int"))

    def compared(rows_: DataFrame) -> DataFrame:
        found = rows_.join(bodies, "node").repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")
        return found.mapInPandas(tidy(_compare(width, percent, float(least), rows)), "a long, b long")

    own = dealt.select("bucket", "node", "block", F.col("block").alias("x"), F.col("block").alias("y"), F.col("node").alias("label"))
    links = materialise(compared(own), "links")
    groups = components(links)
    large = dealt.where("blocks > 1").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    large = materialise(large, "large")
    if not large.isEmpty():
        links = links.unionByName(materialise(compared(_across(large)), "links"))
        groups = components(links)
    named = nodes.select("node", "doc_id").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    heads = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    where = named.join(heads, "label").select("node", "component_id")
    out = sketched.select("doc_id", "mark", "n", "node").join(where, "node", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "mark")


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, without those that are not kept by `near_duplicates`.

    Null ids and texts without words stay.  Rows that agree in doc_id and text are judged alike: all of them stay or none.
    """
    gone = _groups(docs, width, percent).where(~F.col("kept")).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"))
    gone = materialise(gone.distinct(), "gone")
    side = bounded_broadcast(gone, gone.count(), BROADCAST_IDS)
    mark = F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.join(side, (docs["doc_id"].cast("long") == side["gone_id"]) & (mark == side["gone_mark"]), "left_anti")
