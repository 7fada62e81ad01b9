"""Bounded samples of labelled rows that the two classifiers learn from."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import as_documents

#: Labelled rows that a classifier is fitted on, about: a bound on what the driver holds, whatever the table's size.
SAMPLE = 4000
_SPAN = 1 << 30


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learnt: crc32(doc_id as text) mod 4 is 2; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, column: str, rows: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """Distinct texts and 0/1 labels of about `rows` rows that are not held out, in an order of their hashes.

    Rows are chosen by a hash of their id against a share taken from the count of usable labels, so all rows are
    equally likely at every size and at most a few standard deviations more than `rows` are collected.  Null
    labels and ids are left out; of several labels of one id the largest counts.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).dropna()
    usable = usable.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, rows / max(usable.count(), 1))
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(column), "doc_id"), F.lit(_SPAN)) < int(share * _SPAN))
    found = as_documents(docs).join(F.broadcast(chosen), "doc_id").select(F.xxhash64("text").alias("mark"), "text", "label")
    once = {}
    for row in sorted(found.toLocalIterator(), key=lambda r: (r.mark, r.label)):
        once[row.mark] = (row.text, row.label)
    return [t for t, _ in once.values()], np.array([y for _, y in once.values()], np.float32)
