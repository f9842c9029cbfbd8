"""Substring dedup: compact windows of min-hashes bring passages together that share a signature; then each is verified.

A compact window (l, c, r) of a hash function stands for all subsequences that begin in [l, c], end in [c, r] and have
their least hash at c. The windows are the nodes of the Cartesian tree over the hashes; those of at least WIDTH shingles
are the places that are least in some run of WIDTH shingles. (Public: Deng et al., 2022; Peng et al., 2023.)
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD, Words, discard, free_shuffles, join_checked, lean, mix64, prepare, save
from .packs import DOCS, pack, unpack, word_hashes

#: Words of a shingle, of the shortest passage, hash functions, least similarity (Jaccard, of sets of shingles).
SHINGLE, LEAST_WORDS, HASHES, SIMILAR = 5, 50, 3, 0.8
WIDTH = LEAST_WORDS - SHINGLE + 1
#: Shingles beyond the outermost shared signatures in which a passage's ends are looked for.
MARGIN = 64
#: Bytes of text of a pack: a task works on several arrays of its words at once.
PACK = 2 << 20
#: Signatures with more windows than this, and packs with more requests than this, are shared among tasks.
CROWDED, REQUESTS = 1000, 1000
_SEEDS = mix64(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_WORDS = re.compile(WORD).finditer
_STEP = np.uint64(0x9FB21C651E98DF25)
_INVERSE = np.uint64(pow(int(_STEP), -1, 1 << 64))


class Shingled:
    """Shingle hashes of the texts of a pack, one after another; first: where each text's begin (one more entry)."""

    def __init__(self, lengths: list[int], blob: bytes) -> None:
        self.words = Words(unpack(lengths, blob), lower=True)
        hashes = word_hashes(self.words)
        n = len(hashes)
        mixed = np.zeros(n, dtype=np.uint64)
        for k in range(SHINGLE):
            mixed[: n - k] += np.roll(hashes, -k)[: n - k] * mix64(np.full(1, k + 1, dtype=np.uint64))
        counts = np.maximum(self.words.counts - SHINGLE + 1, 0)
        inside = np.arange(n) - np.repeat(self.words.first[:-1], self.words.counts) < np.repeat(counts, self.words.counts)
        self.hashes = mix64(mixed[inside])
        self.first = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(counts, out=self.first[1:])
        self.counts = counts

    def of(self, text: int, lo: int, hi: int) -> np.ndarray:
        """Shingles [lo, hi) of a text, as 32-bit hashes."""
        base = self.first[text]
        return (self.hashes[base + lo : base + hi] >> np.uint64(32)).astype(np.uint32)


def compact_windows(values: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(l, c, r) of the Cartesian trees' nodes of at least width elements: one tree for each part between firsts.

    values: 64-bit hashes, compared by their upper bits, ties by place. The centres are the least elements of runs of
    width; a node's nearest smaller elements are centres too, so that a stack over the centres alone finds its ends.
    """
    n = len(values)
    if n < width:
        return (np.zeros(0, np.int64),) * 3
    bits = np.uint64(max(16, n.bit_length()))
    order = (values >> bits << bits) | np.arange(n, dtype=np.uint64)
    least, span = order.copy(), 1
    while span * 2 <= width:
        least[: n - span] = np.minimum(least[: n - span], least[span:])
        span *= 2
    if width > span:
        least[: n - width + span] = np.minimum(least[: n - width + span], least[width - span :])
    counts = np.diff(first)
    end = np.repeat(first[1:], counts)
    starts = np.flatnonzero(np.arange(n) + width <= end)
    centre = np.zeros(n, dtype=bool)
    centre[(least[starts] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = True
    centres = np.flatnonzero(centre)
    begin = np.repeat(first[:-1], counts)[centres]
    left, right = begin.tolist(), (end[centres] - 1).tolist()
    keys, owner, places, stack = order[centres].tolist(), begin.tolist(), centres.tolist(), []
    now = -1
    for i, key in enumerate(keys):
        if owner[i] != now:
            stack.clear()
            now = owner[i]
        while stack and keys[stack[-1]] > key:
            right[stack.pop()] = places[i] - 1
        if stack:
            left[i] = places[stack[-1]] + 1
        stack.append(i)
    return np.array(left, dtype=np.int64), centres, np.array(right, dtype=np.int64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of width values, by where it starts (what starts too late for a whole run: of the rest)."""
    least, span, n = values.copy(), 1, len(values)
    while span * 2 <= width:
        least[: n - span] = np.minimum(least[: n - span], least[span:])
        span *= 2
    if width > span:
        late = width - span
        least[: n - late] = np.minimum(least[: n - late], least[late:])
    return least


def _windows(packs: DataFrame, hashes: int) -> DataFrame:
    """(sig, row, spot, near, sides): spot holds c and how far the window goes to each side.

    near: of the half contexts before and after the centre, the least by the next hash function, 16 bits each. sides, for
    the first hash function alone: the exact half contexts, likewise. The lowest bit of sig tells the first hash function's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half, low, wide16 = WIDTH // 2, np.uint64(48), np.uint64(16)
        for batch in batches:
            for row in batch.to_pylist():
                s = Shingled(row["lengths"], row["blob"])
                n = len(s.hashes)
                if not n:
                    continue
                power = np.full(n, _STEP)
                power[0] = 1
                power, back = np.cumprod(power), np.cumprod(np.where(np.arange(n) > 0, _INVERSE, np.uint64(1)))
                total = np.zeros(n + 1, dtype=np.uint64)
                np.cumsum(s.hashes * power, out=total[1:])
                del power
                text = np.repeat(np.arange(len(s.counts)), s.counts)
                for k in range(hashes):
                    values = mix64(s.hashes ^ _SEEDS[k])
                    left, c, right = compact_windows(values, s.first, WIDTH)
                    t = text[c]
                    other = least_of(mix64(s.hashes ^ _SEEDS[(k + 1) % hashes]), half + 1)
                    before = mix64(other[np.maximum(c - half, s.first[t])]) >> low
                    after = mix64(other[np.minimum(c, s.first[t + 1] - half - 1)]) >> low
                    near = (before << wide16 | after).astype(np.uint32).view(np.int32)
                    sides = np.zeros(len(c), dtype=np.int32)
                    if k == 0:
                        lo, hi = np.maximum(c - half, s.first[t]), np.minimum(c + half + 1, s.first[t + 1])
                        before = mix64((total[c + 1] - total[lo]) * back[lo]) >> low
                        sides = (before << wide16 | mix64((total[hi] - total[c]) * back[c]) >> low).astype(np.uint32).view(np.int32)
                    wide = (1 << 12) - 1
                    spot = (c - s.first[t]) << 24 | np.minimum(c - left, wide) << 12 | np.minimum(right - c, wide)
                    for a in range(0, len(c), 1 << 16):
                        b = slice(a, a + (1 << 16))
                        yield pa.RecordBatch.from_arrays([pa.array((values[c[b]] >> np.uint64(1) << np.uint64(1) | np.uint64(k == 0)).view(np.int64)), pa.array((row["pack"] << DOCS) + t[b]), pa.array(spot[b]), pa.array(near[b]), pa.array(sides[b])], names=["sig", "row", "spot", "near", "sides"])

    return packs.select("pack", "lengths", "blob").mapInArrow(lean(run), "sig long, row long, spot long, near int, sides int")


def _half(sides: str, k: int) -> Column:
    return (F.shiftrightunsigned(sides, 16) if k == 0 else F.col(sides)).bitwiseAND(F.lit(0xFFFF))


def leaders(sig: np.ndarray, row: np.ndarray, spot: np.ndarray, near: np.ndarray) -> np.ndarray:
    """For each window the first window, by (row, spot), of its signature, of its signature and near context before, and of
    its signature and near context after it: three rows of indices."""
    out = []
    for key in (np.zeros(len(sig), dtype=np.int64), near >> 16 & 0xFFFF, near & 0xFFFF):
        by = np.lexsort((spot, row, key, sig))
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = (sig[by][1:] != sig[by][:-1]) | (key[by][1:] != key[by][:-1])
        lead = np.empty(len(by), dtype=np.int64)
        lead[by] = by[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        out.append(lead)
    return np.array(out)


def _matches(windows: DataFrame) -> DataFrame:
    """(row, c, of, d): the centre of each window, and that of a leader of its signature, and of its signature with the same
    least shingle of another hash function in the half context before, or after, it: the first window of each such class.

    Windows are never paired up: a class is its leader and those that meet it. A leader that has the signature but not the
    passage (a stock phrase at the centre) has another half context, so that those that do have the passage meet through
    the narrower classes. See _runs() for rows whose leader holds only a part of what they share exactly.

    Ordinary signatures find leaders in one shuffle by signature, a group of at most CROWDED windows at a time; crowded
    ones by partial minima, joined back.
    """
    wide = (1 << 12) - 1
    crowded = save(windows.groupBy("sig").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("sig"), "crowded")
    n = crowded.count()
    free_shuffles(windows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def lead(x: np.ndarray) -> pa.RecordBatch:
            sig, row, spot, near = x
            first, out = leaders(sig, row, spot, near), []
            for k, p in enumerate(first):
                # The part that both windows cover around the shared centre must hold most of the shortest passage.
                common = np.minimum(spot >> 12 & wide, spot[p] >> 12 & wide) + np.minimum(spot & wide, spot[p] & wide) + 1
                new = (row[p] != row) & (common >= int(SIMILAR * WIDTH)) & ~(first[:k] == p).any(axis=0)
                out.append(np.array([row[new], spot[new] >> 24, row[p][new], spot[p][new] >> 24]))
            return pa.RecordBatch.from_arrays([pa.array(y) for y in np.ascontiguousarray(np.concatenate(out, axis=1))], names=["row", "c", "of", "d"])

        held = np.zeros((4, 0), dtype=np.int64)
        for batch in batches:
            x = np.concatenate([held, np.array([y.to_numpy(zero_copy_only=False) for y in batch.columns])], axis=1)
            whole = np.searchsorted(x[0], x[0, -1]) if x.shape[1] else 0
            held = x[:, whole:]
            if whole:
                yield lead(x[:, :whole])
        yield lead(held)

    plain = join_checked(windows, crowded, ["sig"], n, how="left_anti").select("sig", "row", "spot", "near")
    out = plain.repartition("sig").sortWithinPartitions("sig").mapInArrow(lean(run), "row long, c long, of long, d long")
    if n:
        many = join_checked(windows, crowded, ["sig"], n, how="left_semi")
        many = save(many.select("sig", "row", "spot", _half("near", 0).alias("before"), _half("near", 1).alias("after")), "crowded-windows")
        side = lambda x, k: F.shiftright(x, k).bitwiseAND(F.lit(wide))
        for by in (["sig"], ["sig", "before"], ["sig", "after"]):
            # One row for each key that a crowded signature's windows share: counted, so that the windows stay in place
            # where that is a short list, and else move by a join whose hot keys Spark can split.
            least = many.groupBy(*by).agg(F.min(F.struct("row", "spot")).alias("p"), F.count("*").alias("m")).where("m > 1").drop("m")
            least = save(least, "crowded-leaders")
            met = join_checked(many, least, by, least.count()).where(F.col("p.row") != F.col("row"))
            common = F.least(side(F.col("spot"), 12), side(F.col("p.spot"), 12)) + F.least(side(F.col("spot"), 0), side(F.col("p.spot"), 0)) + 1
            out = out.unionByName(met.where(common >= int(SIMILAR * WIDTH)).select("row", F.shiftright("spot", 24).alias("c"), F.col("p.row").alias("of"), F.shiftright("p.spot", 24).alias("d")))
    return out


def covered(rows: np.ndarray, lo: np.ndarray, hi: np.ndarray, of: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of the intervals [lo, hi) of rows lie in one of the spans [begin, end) of the same row. Rows are small numbers."""
    by = np.lexsort((begin, of))
    keys, ends = (of << 32 | begin)[by], np.maximum.accumulate((of << 32 | end)[by])
    at = np.searchsorted(keys, rows << 32 | lo, side="right") - 1
    return (at >= 0) & (ends[at] >= rows << 32 | hi) if len(keys) else np.zeros(len(rows), dtype=bool)


def _runs(packs: DataFrame, windows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, c, of, d): runs of WIDTH shingles that no found passage of their row covers, with the first row that has the run.
    windows: those of the first hash function.

    A run that several rows have is least at the same place in each, by the first hash function: it belongs to windows of
    one signature that agree in one exact half context. Of such classes only those are looked at that have a window
    besides the first with an uncovered run: all their runs are hashed, so that the rows of a run meet its first row,
    which holds it whole. No run in two rows goes without a covering or this. The windows' table is removed on the way.
    """
    side = lambda k: F.least(F.shiftright("spot", k).bitwiseAND(F.lit(0xFFF)), F.lit(WIDTH - 1))
    c = F.shiftright("spot", 24)
    own = windows.select("sig", "sides", "row", c.alias("c"), (c - side(12)).alias("lo"), (c + side(0) + 1).alias("hi"), F.shiftright("row", DOCS).alias("pack"))
    spans = found.select("row", F.col("start").alias("s"), (F.col("end") - SHINGLE + 1).alias("e"), F.shiftright("row", DOCS).alias("pack")).distinct()

    def mark(left: pa.Table, right: pa.Table) -> pa.Table:
        place = lambda t: t.column("row").to_numpy() & ((1 << DOCS) - 1)
        inside = covered(place(left), left.column("lo").to_numpy(), left.column("hi").to_numpy(), place(right), right.column("s").to_numpy(), right.column("e").to_numpy())
        return left.drop_columns(["pack"]).append_column("open", pa.array(~inside))

    own = own.groupBy("pack").cogroup(spans.groupBy("pack")).applyInArrow(mark, "sig long, sides int, row long, c long, lo long, hi long, open boolean")
    own = save(own.select("sig", _half("sides", 0).alias("before"), _half("sides", 1).alias("after"), "row", "c", "lo", "hi", "open"), "class-windows")
    discard(windows)
    free_shuffles(packs.sparkSession)
    parts = []
    for by in (["sig", "before"], ["sig", "after"]):
        wanted = own.groupBy(*by).agg(F.min("row").alias("first"), F.max(F.when(F.col("open"), F.col("row"))).alias("last")).where("last > first").select(*by)
        wanted = save(wanted, "open-classes")
        parts.append(join_checked(own, wanted, by, wanted.count()).select("row", "c", "lo", "hi"))
    asked = parts[0].unionByName(parts[1]).distinct().withColumn("pack", F.shiftright("row", DOCS))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("run", pa.int64()), ("row", pa.int64()), ("s", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        own = left.to_pylist()[0]
        s = Shingled(own["lengths"], own["blob"])
        row, c, lo, hi = (right.column(x).to_numpy() for x in ("row", "c", "lo", "hi"))
        begin, last = np.maximum(lo, c - WIDTH + 1), np.minimum(c, hi - WIDTH)
        counts = np.maximum(last - begin + 1, 0)
        starts = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(begin, counts)
        rows = np.repeat(row, counts)
        at = s.first[rows & ((1 << DOCS) - 1)] + starts
        hashes = np.zeros(len(at), dtype=np.uint64)
        for k in range(WIDTH):
            hashes = hashes * _STEP + s.hashes[at + k]
        return pa.table([pa.array(mix64(hashes).view(np.int64)), pa.array(rows), pa.array(starts)], schema=schema)

    asked = save(asked, "asked-runs")
    runs = _only(packs, asked).select("pack", "lengths", "blob").groupBy("pack").cogroup(asked.select("pack", "row", "c", "lo", "hi").groupBy("pack")).applyInArrow(run, "run long, row long, s long")
    runs = save(runs, "runs")
    first = save(runs.groupBy("run").agg(F.min(F.struct("row", "s")).alias("p"), F.max("row").alias("last")).where("last > p.row").drop("last"), "first-runs")
    met = join_checked(runs, first, ["run"], first.count()).where("row > p.row").select("row", "s", F.col("p.row").alias("of"), F.col("p.s").alias("at"))
    spans = spans.select(F.col("row").alias("in"), F.col("s").alias("begin"), "e")
    met = met.join(spans, (F.col("row") == F.col("in")) & (F.col("begin") <= F.col("s")) & (F.col("e") >= F.col("s") + WIDTH), "left_anti")
    half = WIDTH // 2
    return save(met.select("row", (F.col("s") + half).alias("c"), "of", (F.col("at") + half).alias("d")), "met")


def chain(runs: list[tuple[int, int, int]]) -> list[list[int]]:
    """Runs (first, last, shift) of shared centres of two rows, on one diagonal each, into segments [a0, a1, b0, b1]:
    those near each other, on about the same diagonal."""
    done, open_ = [], []
    for c0, c1, by in sorted(runs):
        for s in open_:
            if c0 - s[1] <= 2 * WIDTH and abs(by - (s[3] - s[1])) <= WIDTH // 2:
                s[1], s[2], s[3] = max(s[1], c1), min(s[2], c0 + by), max(s[3], c1 + by)
                break
        else:
            done += [s for s in open_ if c0 - s[1] > 2 * WIDTH]
            open_ = [s for s in open_ if c0 - s[1] <= 2 * WIDTH] + [[c0, c1, c0 + by, c1 + by]]
    return done + open_


def _segments(matches: DataFrame) -> DataFrame:
    """Matches of a pair of rows as segments: see chain(). Matches on one diagonal become runs by arrays first."""
    slim = matches.select("row", "of", (F.col("d") - F.col("c")).alias("by"), "c")
    names = ["row", "of", "a0", "a1", "b0", "b1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair: tuple[int, int] | None = None
        runs: list[tuple[int, int, int]] = []
        held = np.zeros((4, 0), dtype=np.int64)

        def out(done: list[list[int]]) -> pa.RecordBatch:
            columns = np.array(done, dtype=np.int64).reshape(-1, 6).T
            return pa.RecordBatch.from_arrays([pa.array(c) for c in np.ascontiguousarray(columns)], names=names)

        def take(x: np.ndarray, done: list[list[int]]) -> None:
            nonlocal pair, runs
            row, of, by, c = x
            if not len(row):
                return
            fresh = np.ones(len(row), dtype=bool)
            fresh[1:] = (row[1:] != row[:-1]) | (of[1:] != of[:-1]) | (by[1:] != by[:-1]) | (c[1:] - c[:-1] > 2 * WIDTH)
            at = np.flatnonzero(fresh)
            last = np.append(at[1:], len(row)) - 1
            for r, o, b, lo, hi in zip(row[at].tolist(), of[at].tolist(), by[at].tolist(), c[at].tolist(), c[last].tolist(), strict=True):
                if pair != (r, o):
                    done.extend([*pair, *s] for s in (chain(runs) if pair else ()))
                    pair, runs = (r, o), []
                runs.append((lo, hi, b))

        for batch in batches:
            x = np.concatenate([held, np.array([y.to_numpy(zero_copy_only=False) for y in batch.columns])], axis=1)
            done: list[list[int]] = []
            # The last diagonal may go on in the next batch.
            tail = (x[0] == x[0, -1]) & (x[1] == x[1, -1]) & (x[2] == x[2, -1]) if x.shape[1] else np.zeros(0, dtype=bool)
            take(x[:, ~tail], done)
            held = x[:, tail]
            yield out(done)
        done = []
        if held.shape[1]:
            take(held, done)
        done.extend([*pair, *s] for s in (chain(runs) if pair else ()))
        yield out(done)

    return slim.repartition("row", "of").sortWithinPartitions("row", "of", "by", "c").mapInArrow(lean(run), "row long, of long, a0 long, a1 long, b0 long, b1 long")


def verify(a: np.ndarray, b: np.ndarray, shift: int) -> list[tuple[int, int, int, int, float]]:
    """Passages [i, j) of a and [p, q) of b, in shingles, of at least WIDTH and of Jaccard similarity of at least SIMILAR.

    shift: about how far b lies behind a. If an equal run at that shift leaves less than WIDTH of a on either side, and
    none of that occurs in b, it is the passage. Else the longest and the densest stretch of a whose shingles mostly occur
    in b are tried whole, and where they aren't similar enough, their equal runs are; then what is left on either side.
    """
    found = []
    lo, hi = max(0, -shift), min(len(a), len(b) - shift)
    if hi - lo >= WIDTH:  # mostly, one equal run is all there is
        i, j = _longest_run(a[lo:hi] == b[lo + shift : hi + shift])
        if j - i >= WIDTH and lo + i < WIDTH and len(a) - lo - j < WIDTH and not (_inside(a[: lo + i], b).any() or _inside(a[lo + j :], b).any()):
            return [(lo + i, lo + j, lo + i + shift, lo + j + shift, 1.0)]
    inside = _inside(a, b)
    if int(inside.sum()) < SIMILAR * WIDTH:
        return found
    todo = [(0, len(a))]
    while todo:
        x, y = todo.pop()
        if y - x < WIDTH or int(inside[x:y].sum()) < SIMILAR * WIDTH:
            continue
        tried = [(x + i, x + j) for i, j in (_longest(inside[x:y]), _densest(inside[x:y])) if j - i >= WIDTH]
        if not tried:
            continue
        for i, j in dict.fromkeys(tried):
            p, q, similar = _counterpart(a, b, i, j, shift)
            if similar >= SIMILAR:
                found.append((i, j, p, q, similar))
                break
        else:
            i, j = min(i for i, _ in tried), max(j for _, j in tried)
            for by in {int(d) for d in np.unique(_diagonals(a, b, i, j))}:
                at = np.arange(max(i, -by), min(j, len(b) - by))
                steps = np.flatnonzero(np.diff(a[at] == b[at + by], prepend=False, append=False)) if len(at) >= WIDTH else np.zeros(0, int)
                found += [(int(at[0] + s), int(at[0] + e), int(at[0] + s + by), int(at[0] + e + by), 1.0) for s, e in zip(steps[::2], steps[1::2], strict=True) if e - s >= WIDTH]
        todo += [(x, i), (j, y)]
    return found


def _longest(inside: np.ndarray) -> tuple[int, int]:
    """The longest stretch, from a shingle inside to one, of which so many are that as many others on either side still
    leave two texts similar: with m of n outside in each, (n - m) / (n + m) is at least SIMILAR."""
    miss = int(round((1 + SIMILAR) / (1 - SIMILAR))) - 1
    total = np.concatenate([[0], np.cumsum(np.where(inside, 1, -miss))])
    begins = np.flatnonzero(np.concatenate([[True], total[1:] < np.minimum.accumulate(total)[:-1]]))
    ends = np.searchsorted(-np.maximum.accumulate(total[::-1])[::-1], -total[begins], side="right") - 1
    k = int((ends - begins).argmax())
    some = np.flatnonzero(inside[begins[k] : ends[k]])
    return (int(begins[k] + some[0]), int(begins[k] + some[-1]) + 1) if len(some) else (0, 0)


def _densest(inside: np.ndarray) -> tuple[int, int]:
    """The stretch no prefix and no suffix of which has a smaller share inside than SIMILAR: that with the largest surplus."""
    total = np.concatenate([[0], np.cumsum(np.where(inside, 1, -int(round(SIMILAR / (1 - SIMILAR)))))])
    j = int((total - np.minimum.accumulate(total)).argmax())
    return int(np.flatnonzero(total[: j + 1] == total[: j + 1].min())[-1]), j


def _counterpart(a: np.ndarray, b: np.ndarray, i: int, j: int, shift: int) -> tuple[int, int, float]:
    """What of b, near the shift, holds the shingles of a[i:j], and how similar it is."""
    lo, hi = max(0, i + shift - WIDTH), min(len(b), j + shift + WIDTH)
    spots = np.flatnonzero(_inside(b[lo:hi], a[i:j])) + lo
    if not len(spots):
        return 0, 0, 0.0
    near = spots[(spots >= i + shift - WIDTH // 2) & (spots < j + shift + WIDTH // 2)]
    near = near if len(near) else spots
    p, q = int(near[0]), int(near[-1]) + 1
    mine, other = np.unique(a[i:j]), np.unique(b[p:q])
    both = int(_inside(mine, other).sum())
    return p, q, both / (len(mine) + len(other) - both)


def _inside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which of x occur in y."""
    if not len(x) or not len(y):
        return np.zeros(len(x), dtype=bool)
    y = np.sort(y)
    return y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x


def _longest_run(same: np.ndarray) -> tuple[int, int]:
    """The first longest run of true."""
    steps = np.flatnonzero(np.diff(same, prepend=False, append=False))
    if not len(steps):
        return 0, 0
    k = int((steps[1::2] - steps[::2]).argmax())
    return int(steps[2 * k]), int(steps[2 * k + 1])


def _diagonals(a: np.ndarray, b: np.ndarray, i: int, j: int) -> np.ndarray:
    """All shifts at which the shingle of each WIDTH // 2 that is rarest in b occurs there: a run of WIDTH holds one such part."""
    ordered, out = np.sort(b), [np.zeros(0, dtype=np.int64)]
    times = np.searchsorted(ordered, a[i:j], side="right") - np.searchsorted(ordered, a[i:j])
    for x in range(0, j - i, WIDTH // 2):
        rare = i + x + int(times[x : x + WIDTH // 2].argmin())
        out.append(np.flatnonzero(b == a[rare]) - rare)
    return np.concatenate(out)


def passages(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, start, end, source_doc_id, source_start, source_end, similarity, row, source).

    A row for each passage found: words [start, end) of a text, at least 50, that nearly or exactly occur in another
    text, which comes earlier in the table (row and source are their places), with the Jaccard similarity of their sets
    of 5-word shingles (A-Z lower-cased), at least 0.8. Of texts that share 50 consecutive
    words, all but the first have these words in a passage; nearly equal passages are found if one of the hash functions agrees and
    no earlier text with that signature and without the passage stands before the first of them. Only passages across rows count: repeats inside a text are a matter of the quality rules.
    Texts of under 50 words, empty and null ones have no passages. Repeated rows and copies are passages of each other;
    null ids stay null. Other columns are not read.
    """
    packs = save(_packs(docs), "packs")
    return _verified(packs, hashes)


def _packs(docs: DataFrame) -> DataFrame:
    prepare(docs.sparkSession)
    return pack(docs.select("doc_id", F.lit(False).alias("held"), "text"), PACK)


def _verified(packs: DataFrame, hashes: int) -> DataFrame:
    free_shuffles(packs.sparkSession)
    windows = save(_windows(packs, hashes), "windows")
    segments = save(_segments(_matches(windows)), "segments")
    free_shuffles(packs.sparkSession)
    # From here on only the first hash function's windows are read: the table of all goes.
    own = save(windows.where(F.col("sig").bitwiseAND(F.lit(1)) == 1).drop("near"), "own-windows")
    discard(windows)
    lent = _lent(packs, segments)
    found = save(_compared(packs, segments, lent), "found")
    discard(lent)
    free_shuffles(packs.sparkSession)
    segments = save(_segments(_runs(packs, own, found)), "segments")
    return found.unionByName(_compared(packs, segments, _lent(packs, segments))).distinct()


def _only(packs: DataFrame, asked: DataFrame) -> DataFrame:
    """The packs that asked(pack, ...) names: the list is counted before it is sent along."""
    named = save(asked.select("pack").distinct(), "named-packs")
    return join_checked(packs, named, ["pack"], named.count(), how="left_semi")


def _lent(packs: DataFrame, segments: DataFrame) -> DataFrame:
    """What each segment's source holds there, for the pack that has the other side: a table, so that packs move to lend and
    to compare one after the other, not both at once."""
    free_shuffles(packs.sparkSession)
    asked = segments.withColumn("pack", F.shiftright("of", DOCS))
    crowded = save(asked.groupBy("pack").agg(F.count("*").alias("n")).where(F.col("n") > REQUESTS).select("pack", F.ceil(F.col("n") / REQUESTS).cast("int").alias("shares")), "crowded-packs")
    n = crowded.count()
    share = F.coalesce("shares", F.lit(1))
    asked = join_checked(asked, crowded, ["pack"], n, how="left").withColumn("share", F.pmod(F.xxhash64("row", "a0"), share).cast("int")).drop("shares")
    lent = join_checked(_only(packs, asked), crowded, ["pack"], n, how="left").withColumn("share", F.explode(F.sequence(F.lit(0), share - 1))).drop("shares")

    def lend(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("pack", pa.int64()), ("row", pa.int64()), ("a0", pa.int64()), ("a1", pa.int64()), ("shift", pa.int64()), ("of", pa.int64()), ("source_doc_id", pa.int64()), ("source_from", pa.int64()), ("shingles", pa.binary())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        own = left.to_pylist()[0]
        s = Shingled(own["lengths"], own["blob"])
        row, of, a0, b0, b1 = (right.column(x).to_numpy() for x in ("row", "of", "a0", "b0", "b1"))
        text = of & ((1 << DOCS) - 1)
        lo, hi = np.maximum(0, b0 - MARGIN), np.minimum(s.counts[text], b1 + MARGIN + 1)
        lent = pa.array([s.of(*x).tobytes() for x in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)], pa.large_binary()).cast(pa.binary())
        ids = pa.array(own["ids"], pa.int64()).take(pa.array(text))
        return pa.table([pa.array(row >> DOCS), right.column("row"), right.column("a0"), right.column("a1"), pa.array(b0 - a0), right.column("of"), ids, pa.array(lo), lent], schema=schema)

    schema = "pack long, row long, a0 long, a1 long, shift long, of long, source_doc_id long, source_from long, shingles binary"
    lending = lent.select("pack", "share", "ids", "lengths", "blob").groupBy("pack", "share").cogroup(asked.groupBy("pack", "share")).applyInArrow(lend, schema)
    lending = save(lending, "lent")
    free_shuffles(packs.sparkSession)
    return lending


def _compared(packs: DataFrame, segments: DataFrame, lending: DataFrame) -> DataFrame:
    """The passages of segments, with what _lent() gives: see passages()."""

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("source_doc_id", pa.int64()), ("source_start", pa.int64()), ("source_end", pa.int64()), ("similarity", pa.float64()), ("row", pa.int64()), ("source", pa.int64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        own = left.to_pylist()[0]
        s, out = Shingled(own["lengths"], own["blob"]), set()
        for x in _rows(right):
            text = x["row"] & ((1 << DOCS) - 1)
            lo, hi = max(0, x["a0"] - MARGIN), min(int(s.counts[text]), x["a1"] + MARGIN + 1)
            a, b, base = s.of(text, lo, hi), np.frombuffer(x["shingles"], dtype=np.uint32), x["source_from"]
            for i, j, p, q, similar in verify(a, b, x["shift"] + lo - base):
                out.add((own["ids"][text], lo + i, lo + j + SHINGLE - 1, x["source_doc_id"], base + p, base + q + SHINGLE - 1, similar, x["row"], x["of"]))
        return pa.Table.from_pylist([dict(zip(schema.names, x, strict=True)) for x in sorted(out, key=lambda x: x[1:3] + x[7:])], schema)

    schema = "doc_id long, start long, end long, source_doc_id long, source_start long, source_end long, similarity double, row long, source long"
    comparing = _only(packs, segments.select(F.shiftright("row", DOCS).alias("pack")))
    return comparing.select("pack", "ids", "lengths", "blob").groupBy("pack").cogroup(lending.groupBy("pack")).applyInArrow(compare, schema)


def _rows(table: pa.Table) -> Iterator[dict]:
    for batch in table.to_batches(max_chunksize=500):
        yield from batch.to_pylist()


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """Text without the words of the spans; what stood between words goes with the word after it."""
    out, last, at, spans = [], 0, 0, sorted(spans)
    for n, m in enumerate(_WORDS(text)):
        while at < len(spans) and spans[at][1] <= n:
            at += 1
        if any(lo <= n < hi for lo, hi in spans[at:]):
            last = m.end()
        else:
            out.append(text[last : m.end()])
            last = m.end()
    out.append(text[last:])
    return "".join(out).strip() if spans else text


def remove_passages(docs: DataFrame, hashes: int = HASHES) -> DataFrame:
    """docs without the passages that passages() finds: each stays in the text that its chain of sources ends in.

    Columns as they were (n_chars, if there, counts the new text); one row per row, empty texts if all of a text goes.
    The other columns travel as one struct of fields named by their places, so that no name and no type can clash.
    """
    prepare(docs.sparkSession)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    fields = {c: f"c{k}" for k, c in enumerate(others)}
    rest = F.struct(F.col("text").isNull().alias("empty"), *(F.col(f"`{c}`").alias(f) for c, f in fields.items()))
    packs = save(pack(docs.select("doc_id", rest.alias("held"), "text"), PACK), "packs")
    spans = save(_verified(packs, hashes).select("row", "start", "end").distinct(), "spans")
    held = packs.schema["held"].dataType.elementType

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["doc_id", "rest", "text"]
        if not left.num_rows:
            kinds = [pa.int64(), left.schema.field("held").type.value_type, pa.string()]
            return pa.table([pa.array([], k) for k in kinds], names=names)
        own, found = left.select(["lengths", "blob"]).to_pylist()[0], {}
        for x in right.to_pylist():
            found.setdefault(x["row"] & ((1 << DOCS) - 1), []).append((x["start"], x["end"]))
        texts = [cut(t, found[i]) if i in found else t for i, t in enumerate(unpack(own["lengths"], own["blob"]).to_pylist())]
        ids, rest = (left.column(c).combine_chunks().flatten() for c in ("ids", "held"))
        return pa.table([ids, rest, pa.array(texts, pa.string())], names=names)

    by = spans.withColumn("pack", F.shiftright("row", DOCS)).groupBy("pack")
    out = packs.groupBy("pack").cogroup(by).applyInArrow(run, StructType().add("doc_id", "long").add("rest", held).add("text", "string"))
    out = out.withColumn("text", F.when(~F.col("rest.empty"), F.col("text")))
    columns = [F.col(c) if c in ("doc_id", "text") else F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(f"rest.{fields[c]}").alias(c) for c in docs.columns]
    return out.select(*columns)


__all__ = ["compact_windows", "cut", "discard", "passages", "remove_passages", "verify"]
