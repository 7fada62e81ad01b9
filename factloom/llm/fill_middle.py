"""Operator 13: fill-in-middle by a sparse index of checkpoints.

While a text's units are counted, every STEP of them the byte and the code point at which
the unit starts are written down.  A cut is found by binary search among the checkpoints
and a brief scan from the nearest one before it, so no list of all units is ever held.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import bounded_batches, tidy

#: Units between checkpoints, and bytes that are counted at a time.
STEP, CHUNK = 512, 1 << 20
# The marks before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 texts so many stay plain, and of 100 others so many have the suffix first.
PLAIN_PERCENT, SPM_PERCENT = 10, 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _points(raw: np.ndarray, before: int) -> np.ndarray:
    """Whether a byte starts a code point."""
    return (raw & 0xC0) != 0x80


def _words(raw: np.ndarray, before: int) -> np.ndarray:
    """A word with the white space before it is a unit; white space at the end is one too.  `before` is the byte before, -1 at the start."""
    space = _SPACE[raw]
    last = np.r_[before >= 0 and bool(_SPACE[before]), space[:-1]]
    starts = space & ~last
    starts[:1] |= before < 0
    return starts


def _lines(raw: np.ndarray, before: int) -> np.ndarray:
    """A line with its line feed is a unit."""
    return np.r_[before in (-1, 10), raw[:-1] == 10]


#: kind of unit -> whether a unit starts at each of the given bytes.
UNITS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {"points": _points, "words": _words, "lines": _lines}


class Checkpoints:
    """Where every STEP-th unit of a UTF-8 text starts, and how many units and code points there are."""

    def __init__(self, text: bytes, unit: str = "points", step: int = STEP, chunk: int = CHUNK) -> None:
        self.raw, self.starts, self.step = np.frombuffer(text, np.uint8), UNITS[unit], step
        at_byte, at_point, self.n, self.points = [], [], 0, 0
        for a in range(0, len(text), chunk):
            part = self.raw[a : a + chunk]
            begins, lead = np.flatnonzero(self.starts(part, self._before(a))), _points(part, 0)
            marked = begins[-self.n % step :: step]
            if len(marked):
                at_byte.append(a + marked)
                at_point.append(self.points + np.cumsum(lead)[marked] - 1)
            self.n += len(begins)
            self.points += int(np.count_nonzero(lead))
        none = np.zeros(0, np.int64)
        self.bytes, self.code_points = np.concatenate([none, *at_byte]), np.concatenate([none, *at_point])
        self.units = np.arange(len(self.bytes)) * step

    def _before(self, at: int) -> int:
        return int(self.raw[at - 1]) if at else -1

    def cut(self, unit: int) -> tuple[int, int]:
        """(bytes, code points) before the unit of that number; all of them at the end."""
        if unit >= self.n:
            return len(self.raw), self.points
        k = int(np.searchsorted(self.units, unit, "right")) - 1
        at, left, points = int(self.bytes[k]), unit - int(self.units[k]), int(self.code_points[k])
        while True:
            part = self.raw[at : at + 4 * self.step]
            begins = np.flatnonzero(self.starts(part, self._before(at)))
            if left < len(begins):
                stop = int(begins[left])
                return at + stop, points + int(np.count_nonzero(_points(part[:stop], 0)))
            left, at, points = left - len(begins), at + len(part), points + int(np.count_nonzero(_points(part, 0)))


def draws(doc_id: int | None, seed: str = "1") -> list[int]:
    """Four numbers of 32 bits that depend on the document's id alone; a null id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def arranged(text: bytes, doc_id: int | None, unit: str = "points", seed: str = "1") -> tuple[int, str, int | None, int | None, bytes]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    one, two, three, four = draws(doc_id, seed)
    index = Checkpoints(text, unit)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not text or three % 100 >= 100 - PLAIN_PERCENT or any(m in text for m in marks):
        return index.n, "plain", None, None, text
    low, high = sorted((one % (index.n + 1), two % (index.n + 1)))
    (a, points), (b, end) = index.cut(low), index.cut(high)
    prefix, middle, suffix = marks[0] + text[:a], marks[2] + text[a:b], marks[1] + text[b:]
    spm = four % 100 < SPM_PERCENT
    return index.n, "spm" if spm else "psm", points, end - points, (suffix + prefix if spm else prefix + suffix) + middle


def rearrange(docs: DataFrame, unit: str = "points", seed: str = "1") -> DataFrame:
    """doc_id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (code points, null where plain) and output of every row.

    Null and empty texts are plain with no units, as are texts that hold a mark; null ids are drawn for as an empty id.
    Repeated rows and ids give a row each, equal ones equal rows; other columns are not read; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            rows = [arranged(t, d, unit, seed) for t, d in zip(batch["text"], ids, strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            long = lambda values: pd.array(values, dtype="Int64")
            yield pd.DataFrame({"doc_id": long(ids), "n": long(n), "form": form, "prefix_chars": long(prefix), "middle_chars": long(middle), "output": output})

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary"
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text).mapInPandas(tidy(run), schema)
    return found.withColumn("output", F.col("output").cast("string"))


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made from: no mark can stand inside the three parts, so the marks split it."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(arranged_rows: DataFrame) -> DataFrame:
    """The rows of `rearrange` with SHA-256 of the output and of the text that is rebuilt from it, in place of the output."""
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    output = F.col("output")
    return arranged_rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(output).alias("output_sha256"), digest(restored(F.col("form"), output)).alias("restored_sha256"))
