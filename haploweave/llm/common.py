"""What the operators share: tables in the shared folder, Arrow batches of bounded size, words as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship

#: A word, and what lies between words.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts of an Arrow batch. A batch ends at this many bytes or rows, whichever comes first.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
_given: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of this session and give executors this package. Idempotent."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset and both are one machine (tests), a
    temporary one; a cluster needs the setting.

    With its file system, so that Spark's writers and others see one place.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        found = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="haploweave-"))
        spark.conf.set("spark.checkpoint.dir", found)
    where = spark._jvm.org.apache.hadoop.fs.Path(found)
    full = where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    _given.add(path)
    return path


def save(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to a table in the shared folder and read it. A lost executor costs only its own tasks."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what save() wrote, once nothing reads it."""
    if path := getattr(df, "_saved_at", None):
        _remove(df.sparkSession, path)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of what is saved by now: it does so when the driver collects its garbage.

    The scheduler holds on to the last job's stages until another has run: a job of one row goes first.
    """
    spark.range(1).count()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    _given.discard(path)


def sweep(spark: SparkSession) -> None:
    """Remove all that operators of this process have put into the shared folder: call it when their results are written."""
    for path in list(_given):
        _remove(spark, path)


def join_checked(left: DataFrame, right: DataFrame, on: Column | list[str], rows: int, most: int = 20_000, how: str = "inner") -> DataFrame:
    """Join with a right side of `rows` rows (a counted figure): broadcast up to `most`, else by shuffle with AQE's skew handling."""
    return left.join(F.broadcast(right) if rows <= most else right, on, how)


_memories: dict[str, Callable[[], None]] = {}


def keep_memory(owner: str, forget: Callable[[], None]) -> None:
    """Tell how to empty what an operator remembers between tasks of a Python worker."""
    _memories[owner] = forget


def lean(run: Callable[..., Iterator], owner: str = "") -> Callable[..., Iterator]:
    """A batch function that empties what other operators remember, and gives its memory back to the system when it ends:
    Python workers live on between tasks."""

    def out(batches: Iterator) -> Iterator:
        for other, forget in _memories.items():
            if other != owner:
                forget()
        try:
            yield from run(batches)
        finally:
            release()

    return out


def release() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


class Words:
    """Words of an Arrow array of texts (null: none) as arrays.

    starts, ends: byte offsets into data; first: index of each text's first word (one more entry than texts);
    ids and distinct: words as indices into a BinaryArray, equal exactly if the words are.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        width = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], dtype=width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]] if raw is not None and len(texts) else np.zeros(0, np.uint8)
        self.bounds = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
        if lower:
            data = data.copy()
            data[(data >= 65) & (data <= 90)] += 32
        self.data, self.n_texts = data, len(texts)
        self.is_word = ~_SEPARATOR[data]
        begins, finishes = self.is_word.copy(), self.is_word.copy()
        begins[1:] &= ~self.is_word[:-1]
        finishes[:-1] &= ~self.is_word[1:]
        inner = self.bounds[1:-1]
        inner = inner[(inner > 0) & (inner < len(data))]
        begins[inner] = self.is_word[inner]
        finishes[inner - 1] = self.is_word[inner - 1]
        self.starts, self.ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
        self.first = np.searchsorted(self.starts, self.bounds)
        self.counts = np.diff(self.first)
        self._ids: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.starts)

    def _encode(self) -> None:
        offsets = np.zeros(len(self) + 1, dtype=np.int64)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        kept = np.ascontiguousarray(self.data[self.is_word])
        array = pa.Array.from_buffers(pa.large_binary(), len(self), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        self._ids, self._distinct = array.indices.to_numpy(zero_copy_only=False).astype(np.int64), array.dictionary

    @property
    def ids(self) -> np.ndarray:
        if self._ids is None:
            self._encode()
        return self._ids

    @property
    def distinct(self) -> pa.Array:
        if self._ids is None:
            self._encode()
        return self._distinct

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_texts), self.counts)


def per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of unsigned 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
