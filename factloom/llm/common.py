"""Shared helpers of the training-data operators: tables in the shared folder, word and shingle hashes."""

from __future__ import annotations

import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}
MASK = (1 << 64) - 1
#: Distinct words a task remembers hashes of, where an operator names no other number (some 180 bytes each).
WORD_TABLE = 250_000
#: Bytes of a batch of rows that Spark hands to Python.
BATCH_BYTES = 2 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one where it is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    return found or _LOCAL.setdefault("dir", tempfile.mkdtemp(prefix="factloom-"))


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/factloom/{kind}-{uuid.uuid4().hex}"


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_BYTES: texts are long, and a Python worker and its JVM hold a batch at a time."""
    if int(re.sub(r"\D", "", spark.conf.get(_BATCH_CONF))) > BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def tidy(run: Callable) -> Callable:
    """A task function that gives memory back when it ends: Python workers outlive their tasks and wait beside the next ones."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return wrapped


def materialise(df: DataFrame, kind: str, compression: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    path = shared_path(df.sparkSession, kind)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if "/factloom/" in folder.toString():
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_documents(df: DataFrame) -> DataFrame:
    """doc_id as long and text with null as empty; nothing else of the input is used."""
    bounded_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


class WordHashes(dict):
    """UTF-8 word -> 64-bit hash, filled on demand; beyond `most` words it starts anew."""

    def __init__(self, most: int = WORD_TABLE) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit mixing hash: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        h = h ^ (h >> np.uint64(30))
        h = h * np.uint64(0xBF58476D1CE4E5B9)
        h = h ^ (h >> np.uint64(27))
        h = h * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def windows(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mixed(out)


def words_of(text: str, lower: bool = False) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ as UTF-8; `lower` folds A-Z only."""
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def shingles(text: str, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct word shingles of the A-Z-folded text; with fewer words the whole sequence is one, without words there is none."""
    words = words_of(text, lower=True)
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(width, len(words))))


def bounded_broadcast(df: DataFrame, rows: int, limit: int) -> DataFrame:
    """A broadcast hint for a side whose row count has been checked; beyond the limit Spark shuffles it."""
    return F.broadcast(df) if rows <= limit else df
