"""Vector code compression: product quantization whose codebooks are fitted by Lloyd's rounds with heaps of bounds.

Each part of a vector lies in the heap of its codebook entry, keyed by the slack between the lower bound of its distance
to any other entry and the upper bound of that to its own (public: Hamerly and Drake, 2015). Entries that move use up
slack: by their own way and the longest of the others'. A key is the slack plus what the entry had used up when the part
came in, so that nothing is touched until the entry's use has reached the top of its heap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import discard, join_checked, lean, prepare, save

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Vectors of a block, and the bytes of their components as 64-bit integers, whichever is less.
BLOCK, BLOCK_BYTES = 8192, 8 << 20
#: Far more than the rounding of square roots and sums, relative to what is rounded.
_EPS = 1e-12
_STATE = ("codes", "keys", "items", "sizes", "delta")


def distances(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer entries."""
    if not x.shape[1] or not len(x):
        return np.zeros((len(x), len(book)), dtype=np.int64)
    top = max(int(np.abs(x).max()), int(np.abs(book).max()))
    kind = np.float64 if 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    a, b = x.astype(kind), book.astype(kind)
    return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None, :]).astype(np.int64)


class Block:
    """Vectors of one length with their codes and heaps: x (n, parts, width) integers, codes (n, parts), heaps by part and entry."""

    def __init__(self, x: np.ndarray, entries: int) -> None:
        self.x, self.entries = x, entries
        self.codes = np.full(x.shape[:2], -1, dtype=np.int16)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(x.shape[1] * entries)]
        self.scanned = 0

    def assign(self, book: np.ndarray, used: np.ndarray) -> np.ndarray:
        """Bring codes up to date with book (parts, entries, width), used (parts, entries) being the slack used up so far.

        Returns what the codebook's sums gain: (parts, entries, width + 1), the last place for counts. Only parts that
        come off their heap are looked at, and those against all entries, exactly; ties go to the lower index.
        """
        n, parts, width = self.x.shape
        gain = np.zeros((parts, self.entries, width + 1), dtype=np.int64)
        for p in range(parts):
            heaps = self.heaps[p * self.entries : (p + 1) * self.entries]
            todo = np.flatnonzero(self.codes[:, p] < 0).tolist()
            for heap, most in zip(heaps, used[p].tolist(), strict=True):
                while heap and heap[0][0] <= most:
                    todo.append(heappop(heap)[1])
            if not todo:
                continue
            rows = np.array(todo, dtype=np.int64)
            self.scanned += len(rows)
            d = distances(self.x[rows, p], book[p])
            best = d.argmin(1)
            first = np.sqrt(d[np.arange(len(rows)), best])
            d[np.arange(len(rows)), best] = np.iinfo(np.int64).max
            other = np.sqrt(d.min(1)) if d.shape[1] > 1 else np.full(len(rows), np.inf)
            own = used[p][best]
            keys = other - first + own - _EPS * (other + own + 1) if d.shape[1] > 1 else other
            self._move(p, rows, best, gain[p])
            if all(not h for h in heaps):
                for k in np.unique(best).tolist():
                    mine = best == k
                    heaps[k].extend(zip(keys[mine].tolist(), rows[mine].tolist(), strict=True))
                    heapify(heaps[k])
            else:
                for k, key, row in zip(best.tolist(), keys.tolist(), todo, strict=True):
                    heappush(heaps[k], (key, row))
        return gain

    def _move(self, p: int, rows: np.ndarray, best: np.ndarray, gain: np.ndarray) -> None:
        old = self.codes[rows, p]
        moved = old != best
        rows, old, new = rows[moved], old[moved], best[moved]
        x = np.concatenate([self.x[rows, p].astype(np.int64), np.ones((len(rows), 1), dtype=np.int64)], axis=1)
        np.add.at(gain, new, x)
        np.subtract.at(gain, old[old >= 0], x[old >= 0])
        self.codes[rows, p] = new

    def error(self, book: np.ndarray) -> np.ndarray:
        """Of each vector, the squared distances to its entries, summed over its parts."""
        chosen = book[np.arange(self.x.shape[1])[None, :], self.codes]
        return ((self.x.astype(np.int64) - chosen) ** 2).sum((1, 2))

    def dump(self) -> dict[str, bytes]:
        flat = [pair for heap in self.heaps for pair in heap]
        return {
            "codes": self.codes.tobytes(),
            "keys": np.array([k for k, _ in flat], dtype=np.float64).tobytes(),
            "items": np.array([i for _, i in flat], dtype=np.int32).tobytes(),
            "sizes": np.array([len(h) for h in self.heaps], dtype=np.int32).tobytes(),
        }

    def load(self, state: dict[str, bytes]) -> Block:
        """Heaps as dump() wrote them, in the order of a heap."""
        self.codes = np.frombuffer(state["codes"], dtype=np.int16).reshape(self.x.shape[:2]).copy()
        keys, items = np.frombuffer(state["keys"]).tolist(), np.frombuffer(state["items"], dtype=np.int32).tolist()
        at = 0
        for k, size in enumerate(np.frombuffer(state["sizes"], dtype=np.int32).tolist()):
            self.heaps[k] = list(zip(keys[at : at + size], items[at : at + size], strict=True))
            at += size
        return self


class Codebook:
    """The entries for vectors of one length, with the sums and counts of their parts and the slack used up so far."""

    def __init__(self, first: np.ndarray) -> None:
        """first: (vectors, parts, width) integers, whose parts the entries start as."""
        self.entries = np.ascontiguousarray(first.transpose(1, 0, 2)).astype(np.int64)
        parts, n, width = self.entries.shape
        self.sums = [0] * (parts * n * (width + 1))
        self.used = np.zeros((parts, n))

    def update(self, gain: dict[int, int]) -> None:
        """Replace entries by the floors of their parts' means; gain: what sums and counts change by, by place."""
        for place, value in gain.items():
            self.sums[place] += value
        before, (parts, n, width) = self.entries, self.entries.shape
        self.entries = before.copy()
        for e in range(parts * n):
            *total, count = self.sums[e * (width + 1) : (e + 1) * (width + 1)]
            if count:
                self.entries[e // n, e % n] = [t // count for t in total]
        way = np.sqrt(((self.entries - before).astype(np.float64) ** 2).sum(2)) * (1 + _EPS)
        for k in range(n):
            rest = np.delete(way, k, axis=1)
            self.used[:, k] += way[:, k] + (rest.max(1) if rest.shape[1] else 0.0)
        self.used *= 1 + _EPS

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def _integers(lists: pa.Array, length: int, parts: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, (n, parts, width), filled up with zeros to a multiple of parts."""
    width = -(-length // parts)
    found = np.floor(lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), length) * scale)
    top = float(np.abs(found).max()) if found.size else 0.0
    if 4 * parts * width * (top + 1) ** 2 >= 1 << 62:
        raise ValueError("A component is too large for its squared distances to be 64-bit integers.")
    out = np.zeros((len(lists), parts * width), dtype=np.int16 if top < 1 << 15 else np.int64)
    out[:, :length] = found
    return out.reshape(len(lists), parts, width)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, dict[int, Codebook]]:
    """vectors(vec_id, embedding, label, ...) -> ((vec_id, label, length, code, error), codebooks by length).

    One row per vector that is usable(). code: a byte for each part, the index of its entry (so at most 256 entries);
    error: squared distances to the entries, summed over the parts. Components become floor(scale * x). Vectors are cut
    into equal parts; where parts doesn't divide a length, zeros fill it up. Vectors of different lengths have codebooks
    of their own. Entries start as the parts of the vectors of the smallest ids (nulls last; repeated ids by their
    vectors); fewer vectors make fewer entries. Repeated rows count as often as they stand there; other columns aren't
    read; an empty table gives an empty table. Components whose squared distances would leave 64 bits fail the job.

    Vectors are packed into blocks once. A round rewrites the blocks with their codes and heaps into the shared folder
    and drops those before, so that a lost executor costs its own tasks only; besides, each block tells by how much its
    moved parts change the sums, and these are added up by place. The driver holds the codebooks, nothing that grows with
    the rows.
    """
    spark = prepare(vectors.sparkSession)
    rows = vectors.select("vec_id", "label", "embedding").where(usable(F.col("embedding"))).withColumn("length", F.size("embedding"))
    nth = F.row_number().over(Window.partitionBy("length").orderBy(F.col("vec_id").asc_nulls_last(), "embedding"))
    smallest = rows.select("vec_id", "length", "embedding").withColumn("nth", nth).where(F.col("nth") <= entries).orderBy("length", "nth").collect()
    books: dict[int, Codebook] = {}
    for length in sorted({r.length for r in smallest}):
        first = pa.array([r.embedding for r in smallest if r.length == length], pa.list_(pa.float64()))
        books[length] = Codebook(_integers(first, length, parts, scale))
    label = rows.schema["label"].dataType
    held = StructType().add("length", "integer").add("ids", ArrayType(LongType())).add("labels", ArrayType(label)).add("narrow", "boolean").add("x", "binary")
    blocks = rows.select("length", "vec_id", "label", "embedding").mapInArrow(lean(_packing(parts, scale)), held)
    for name in _STATE:
        blocks = blocks.withColumn(name, F.lit(None).cast("binary"))
    for _ in range(rounds):
        new = save(blocks.mapInArrow(lean(_stepping(books, parts)), blocks.schema), "blocks")
        discard(blocks)
        blocks = new
        gains = blocks.select("length", "delta").mapInArrow(lean(_gains), "length int, place int, value long")
        gains = gains.groupBy("length", "place").agg(F.sum("value").alias("value")).collect()
        for length, book in books.items():
            book.update({r.place: r.value for r in gains if r.length == length})
    out = StructType().add("vec_id", "long").add("label", label).add("length", "integer").add("code", "binary").add("error", "long")
    coded = save(blocks.mapInArrow(lean(_coding(books, parts)), out), "codes")
    discard(blocks)
    return coded, books


def _packing(parts: int, scale: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}

        def close(length: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting.pop(length)).combine_chunks()
            ids, labels, vectors = (table.column(c).combine_chunks() for c in ("vec_id", "label", "embedding"))
            x = _integers(vectors, length, parts, scale)
            ends = pa.array([0, len(ids)], pa.int32())
            columns = [pa.array([length], pa.int32()), pa.ListArray.from_arrays(ends, ids), pa.ListArray.from_arrays(ends, labels), pa.array([x.dtype == np.int16]), pa.array([x.tobytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["length", "ids", "labels", "narrow", "x"])

        for batch in batches:
            lengths = batch.column("length").to_numpy()
            for length in np.unique(lengths).tolist():
                mine = batch.filter(pa.array(lengths == length))
                most = max(1, min(BLOCK, BLOCK_BYTES // (8 * max(1, length))))
                for begin in range(0, len(mine), most):
                    piece = mine.slice(begin, most)
                    if sum(map(len, waiting.get(length, []))) + len(piece) > most:
                        yield close(length)
                    waiting.setdefault(length, []).append(piece)
        for length in list(waiting):
            yield close(length)

    return run


def _block(row: dict, n: int, book: Codebook, parts: int) -> Block:
    x = np.frombuffer(row["x"], dtype=np.int16 if row["narrow"] else np.int64).reshape(n, parts, book.entries.shape[2])
    found = Block(x, book.entries.shape[1])
    return found if row["codes"] is None else found.load(row)


def _opened(batches: Iterator[pa.RecordBatch], books: dict[int, Codebook], parts: int) -> Iterator[tuple[pa.RecordBatch, Codebook, Block]]:
    for batch in batches:
        for k in range(len(batch)):
            one = batch.slice(k, 1)
            row = {c: one.column(c)[0].as_py() for c in ("length", "narrow", "x", *_STATE)}
            book = books[row["length"]]
            yield one, book, _block(row, len(one.column("ids").flatten()), book, parts)


def _stepping(books: dict[int, Codebook], parts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, book, block in _opened(batches, books, parts):
            state = {"delta": block.assign(book.entries, book.used).tobytes()} | block.dump()
            columns = [one.column(c) if c not in state else pa.array([state[c]], pa.binary()) for c in one.schema.names]
            yield pa.RecordBatch.from_arrays(columns, names=one.schema.names)

    return run


def _gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a partition's blocks add to the sums, by length and place."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for length, delta in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            gain = np.frombuffer(delta.as_buffer(), dtype=np.int64)
            total[length] = total[length] + gain if length in total else gain
    for length, gain in total.items():
        place = np.flatnonzero(gain)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(place), length, dtype=np.int32)), pa.array(place.astype(np.int32)), pa.array(gain[place])], names=["length", "place", "value"])


def _coding(books: dict[int, Codebook], parts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one, book, block in _opened(batches, books, parts):
            block.assign(book.entries, book.used)
            codes = pa.array([c.tobytes() for c in block.codes.astype(np.uint8)], pa.binary())
            length = pa.array(np.full(len(codes), one.column("length")[0].as_py(), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([one.column("ids").flatten(), one.column("labels").flatten(), length, codes, pa.array(block.error(book.entries))], names=["vec_id", "label", "length", "code", "error"])

    return run


def summed_by_label(coded: DataFrame) -> DataFrame:
    """With label_error: error summed over rows of equal labels, nulls together. Sums meet first, rows only join them."""
    sums = save(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return join_checked(coded, sums, F.col("label").eqNullSafe(F.col("_label")), sums.count()).drop("_label")
