"""Documents in compressed packs: what moves as one when texts must meet what was found out about them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import Words, lean, mix64

#: Bytes of text of a pack (a longer text is a pack alone), and bits for the place of a row in its pack.
PACK, DOCS = 4 << 20, 18


def pack(docs: DataFrame, bytes_: int = PACK) -> DataFrame:
    """docs(doc_id, held, text) in packs of about bytes_: ids, held (any column), lengths, and the texts compressed.

    A pack's number is its task's and its place there: a repeated task numbers alike. A row is pack << DOCS | place.
    """

    held_kind = docs.schema["held"].dataType
    schema = StructType().add("pack", "long").add("ids", ArrayType(LongType())).add("held", ArrayType(held_kind)).add("lengths", ArrayType(LongType())).add("blob", "binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        held: list[pa.Array] = []
        texts: list[bytes] = []
        size = number = 0

        def close() -> pa.RecordBatch:
            whole = pa.concat_arrays(held)
            columns = [pa.array([TaskContext.get().partitionId() << 16 | number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), pa.array([[len(t) for t in texts]], pa.list_(pa.int64())), pa.array([zstandard.ZstdCompressor(3).compress(b"".join(texts))], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["pack", "ids", "held", "lengths", "blob"])

        for batch in batches:
            begin = 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2), strict=True)):
                raw = t.as_buffer().to_pybytes() if t.is_valid else b""
                if ids and (size + len(raw) > bytes_ or len(ids) >> DOCS):
                    held.append(batch.column(1).slice(begin, k - begin))
                    yield close()
                    ids, held, texts, size, number, begin = [], [], [], 0, number + 1, k
                ids.append(i)
                texts.append(raw)
                size += len(raw)
            held.append(batch.column(1).slice(begin))
        if ids:
            yield close()

    return docs.mapInArrow(lean(run), schema)


def unpack(lengths: list[int], blob: bytes) -> pa.Array:
    """The texts of a pack."""
    raw = zstandard.ZstdDecompressor().decompress(blob, max_output_size=sum(lengths)) if sum(lengths) else b""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_string(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])


_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_STEP = np.uint64(0x9FB21C651E98DF25)
_CHUNK = 1 << 18


def word_hashes(words: Words) -> np.ndarray:
    """A 64-bit hash of every word: polynomial over a random table of bytes, mixed. Equal words, equal hashes.

    Sums run over chunks of bytes, so that the temporary arrays stay small; a word over a chunk's end is added up.
    """
    out = np.zeros(len(words), dtype=np.uint64)
    if not len(words):
        return out
    power = np.full(_CHUNK + 1, _STEP)
    power[0] = 1
    power = np.cumprod(power)
    total = np.zeros(_CHUNK + 1, dtype=np.uint64)
    lo = 0
    while lo < len(words):
        base = int(words.starts[lo])
        hi = max(lo + 1, int(np.searchsorted(words.ends, base + _CHUNK, side="right")))
        if words.ends[lo] - base > _CHUNK:  # a word longer than a chunk, alone
            value = np.uint64(0)
            for at in range(base, int(words.ends[lo]), _CHUNK):
                part = words.data[at : min(at + _CHUNK, int(words.ends[lo]))]
                with np.errstate(over="ignore"):
                    value = value * power[len(part)] + np.sum(_TABLE[part] * power[: len(part)][::-1])
            out[lo] = value
        else:
            stop = int(words.ends[hi - 1]) - base
            np.cumsum(_TABLE[words.data[base : base + stop]] * power[:stop][::-1], out=total[1 : stop + 1])
            a, b = words.starts[lo:hi] - base, words.ends[lo:hi] - base
            out[lo:hi] = (total[b] - total[a]) * _INVERSES[stop - b]
        lo = hi
    return mix64(out)


def _inverses() -> np.ndarray:
    found = np.full(_CHUNK + 1, np.uint64(pow(int(_STEP), -1, 1 << 64)))
    found[0] = 1
    return np.cumprod(found)


_INVERSES = _inverses()


def squeeze(values: np.ndarray) -> bytes:
    """Unsigned integers as bytes, like bytes of all values side by side, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T)
    return zstandard.ZstdCompressor(1).compress(planes.tobytes())


def expand(data: bytes, kind: type = np.uint64) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).reshape(-1) if len(raw) else np.zeros(0, kind)


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys, by their steps."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def expand_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(expand(data))
