"""Operator 8: token ids packed into rows of a fixed width by best-fit decreasing.

A task encodes its documents, splits ids longer than a row into consecutive chunks
and places the chunks, longest first, each in the open row with the least room that
suffices; a segment tree over room sizes finds it.  Rows that are not full stay open
for the task's next batch while they are few, so nothing is gathered beyond a task
and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_documents, tidy
from factloom.llm.tokens import BYTE_PATTERN, encoder, load

#: Chunks that a task gathers before it places them.
GROUP = 20_000


class Rooms:
    """Open rows by room left: a segment tree of counts finds the least room that is large enough."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: dict[int, list[int]] = {}

    def _add(self, room: int, n: int) -> None:
        at = room + self.leaves
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, row: int) -> None:
        if room:
            self.rows.setdefault(room, []).append(row)
            self._add(room, 1)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, row) of the tightest fit, which leaves the tree; None where no open row has that room."""
        at, count = size + self.leaves, self.count
        while not count[at]:
            while at & 1:  # a right child: its parent's other rooms are smaller
                at >>= 1
            if not at:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.rows[room].pop()


def best_fit(sizes: list[int], width: int) -> list[list[int]]:
    """Rows as lists of item numbers: longest items first, equal ones in order, each into the row with the least sufficient room."""
    rooms, rows = Rooms(width), []
    for item in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        found = rooms.take(sizes[item])
        if found is None:
            rows.append([item])
            rooms.put(width - sizes[item], len(rows) - 1)
        else:
            room, row = found
            rows[row].append(item)
            rooms.put(room - sizes[item], row)
    return rows


def pack(docs: DataFrame, path: str, width: int = 2048, pad: int = 0, pattern: str = BYTE_PATTERN, lower: bool = False) -> DataFrame:
    """Rows of `width` ids with the segments they hold.

    row_key (hash of the segments' ids), n_tokens, ids (little-endian unsigned, 16 bits where the vocabulary allows and else
    32, padded with `pad` to `width`), cu_seqlens (cumulative segment lengths from 0), resets (offsets where positions start
    at 0 again), doc_ids, chunks (number of a document's chunk in it) and doc_tokens (ids of the whole document).
    Null and empty texts have no ids and one zero-length segment each, so every input row is in the output; null doc_ids and
    repeated rows are segments like any other.
    """
    wide = load(path).get_vocab_size() > 65536

    def rows_of(chunks: list, last: bool) -> tuple[pd.DataFrame | None, list]:
        chunks.sort(key=lambda c: (-len(c[1]), c[0] is None, c[0] or 0, c[2]))
        out, rest = [], []
        kind = "<u4" if wide else "<u2"
        for row in best_fit([len(c[1]) for c in chunks], width):
            held = [chunks[k] for k in row]
            n = sum(len(c[1]) for c in held)
            if not last and n < 0.98 * width and len(rest) < GROUP // 4:
                rest += held
                continue
            ids = np.full(width, pad, kind)
            ids[:n] = np.concatenate([c[1] for c in held])
            ends = np.cumsum([0, *(len(c[1]) for c in held)])
            key = xxhash.xxh3_64_intdigest(ids.tobytes() + repr([(c[0], c[2]) for c in held]).encode()) - (1 << 63)
            out.append((key, n, ids.tobytes(), ends.tolist(), ends[:-1].tolist(), [c[0] for c in held], [c[2] for c in held], [c[3] for c in held]))
        names = ["row_key", "n_tokens", "ids", "cu_seqlens", "resets", "doc_ids", "chunks", "doc_tokens"]
        return (pd.DataFrame(out, columns=names) if out else None), rest

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, chunks = encoder(path, pattern, lower), []
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.frombuffer(known.encode(text), "<u4")
                doc_id = None if pd.isna(doc_id) else int(doc_id)
                chunks += [(doc_id, ids[k : k + width], k // width, len(ids)) for k in range(0, max(len(ids), 1), width)]
                if len(chunks) >= GROUP:
                    frame, chunks = rows_of(chunks, False)
                    if frame is not None:
                        yield frame
        frame, _ = rows_of(chunks, True)
        if frame is not None:
            yield frame

    schema = "row_key long, n_tokens long, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, chunks array<int>, doc_tokens array<long>"
    return as_documents(docs).mapInPandas(tidy(run), schema)


def unpack(packed: DataFrame, wide: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids as little-endian 32-bit): documents put together again from their chunks; ids must be unique."""
    at = F.posexplode("doc_ids").alias("k", "doc_id")
    rows = packed.select("ids", "cu_seqlens", "chunks", "doc_tokens", at)
    size = 4 if wide else 2
    begin, end = F.get("cu_seqlens", F.col("k")), F.get("cu_seqlens", F.col("k") + 1)
    part = F.hex(F.substring(F.col("ids"), begin * size + 1, (end - begin) * size))
    rows = rows.select("doc_id", F.get("chunks", F.col("k")).alias("chunk"), F.get("doc_tokens", F.col("k")).alias("n_tokens"), part.alias("part"))
    whole = rows.groupBy("doc_id").agg(F.max("n_tokens").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("chunk", "part"))).alias("parts"))
    return whole.select("doc_id", "n_tokens", F.unhex(F.array_join(F.transform("parts", lambda p: p["part"]), "")).alias("ids"))


def write(docs: DataFrame, path: str, to: str, width: int = 2048, pad: int = 0, overwrite: bool = False) -> None:
    """Write the packed rows as Parquet, with `pad` behind the tokens of a row; a folder that is there is only replaced with `overwrite`."""
    pack(docs, path, width, pad=pad).write.mode("overwrite" if overwrite else "errorifexists").parquet(to)
