"""Periodic runs of words: a suffix automaton whose states' end positions, merged small to large, meet as neighbours.

A state of length l stands for words that end at the same places. Two places that become neighbours there at a distance
d <= l seed a square: the state's words have period d across both. Each maximal run has its two last ends as such
neighbours at the state where they meet, so that none is missed (public: the automaton by Blumer et al., 1985).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import Words, lean, prepare

#: A run has this many words and this many periods at least.
MIN_WORDS, MIN_PERIODS = 6, 4
#: Positions of a piece of an ordered set.
_PIECE = 512


class Ends:
    """An ordered set of end positions in pieces of bounded size."""

    __slots__ = ("n", "pieces", "tops")

    def __init__(self, position: int) -> None:
        self.pieces, self.tops, self.n = [[position]], [position], 1

    def __iter__(self) -> Iterator[int]:
        for piece in self.pieces:
            yield from piece

    def add(self, x: int) -> tuple[int | None, int | None]:
        """Take a position in; its neighbours below and above."""
        k = min(bisect_left(self.tops, x), len(self.tops) - 1)
        piece = self.pieces[k]
        i = bisect_left(piece, x)
        below = piece[i - 1] if i else self.tops[k - 1] if k else None
        above = piece[i] if i < len(piece) else None
        piece.insert(i, x)
        self.n += 1
        if above is None:
            self.tops[k] = x
        if len(piece) > _PIECE:
            half = len(piece) // 2
            self.pieces[k : k + 1] = [piece[:half], piece[half:]]
            self.tops[k : k + 1] = [piece[half - 1], piece[-1]]
        return below, above


def automaton(words: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(length, link, end) of the states of the words' suffix automaton; end: the place of a prefix's last word, -1 for clones."""
    length, link, end, arcs = [0], [-1], [-1], [{}]
    last = 0
    for i, w in enumerate(words):
        new = len(length)
        length.append(length[last] + 1)
        end.append(i)
        arcs.append({})
        at = last
        while at >= 0 and w not in arcs[at]:
            arcs[at][w] = new
            at = link[at]
        if at < 0:
            link.append(0)
        else:
            to = arcs[at][w]
            if length[to] == length[at] + 1:
                link.append(to)
            else:
                clone = new + 1
                link.append(clone)
                length.append(length[at] + 1)
                link.append(link[to])
                end.append(-1)
                arcs.append(dict(arcs[to]))
                link[to] = clone
                while at >= 0 and arcs[at].get(w) == to:
                    arcs[at][w] = clone
                    at = link[at]
        last = new
    return length, link, end


def seeds(words: list[int]) -> Iterator[tuple[int, int, int]]:
    """(first word, last word, period) of squares: neighbouring ends of a state at a distance of at most its length."""
    length, link, end = automaton(words)
    sets: list[Ends | None] = [None if e < 0 else Ends(e) for e in end]
    for state in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        parent, small, large = link[state], sets[state], sets[link[state]]
        sets[state] = None
        if not parent:
            continue  # the root's words are none: no distance is short enough
        if large is None:
            sets[parent] = small
            continue
        if small.n > large.n:
            small, large = large, small
        sets[parent], reach = large, length[parent]
        for x in small:
            below, above = large.add(x)
            if below is not None and x - below <= reach:
                yield below - reach + 1, x, x - below
            if above is not None and above - x <= reach:
                yield x - reach + 1, above, above - x


def _primitive(words: list[int], start: int, period: int) -> bool:
    """Whether no shorter period divides this one, in a stretch of at least two periods from start on."""
    rest, p = period, 2
    while rest > 1:
        if p * p > rest:
            p = rest
        if rest % p == 0:
            shorter = period // p
            if words[start : start + period] == words[start + shorter : start + shorter + period]:
                return False
            while rest % p == 0:
                rest //= p
        p += 1
    return True


def runs_of(words: list[int], min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of at least min_words words and min_periods (two or more) smallest periods."""
    out: list[tuple[int, int, int]] = []
    known: dict[int, list[tuple[int, int]]] = {}  # by period, stretches that no word extends: they overlap by less than a period
    for first, last, period in seeds(words):
        found = known.setdefault(period, [])
        at = bisect_right(found, (first, len(words) + 1)) - 1
        if at >= 0 and found[at][1] > last:
            continue
        start, stop = first, last + 1
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        while stop < len(words) and words[stop] == words[stop - period]:
            stop += 1
        insort(found, (start, stop))
        if stop - start >= max(min_words, min_periods * period) and _primitive(words, start, period):
            out.append((start, stop - start, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def gram_size(min_words: int, min_periods: int) -> int:
    """The longest gram of which every run holds each of its own min_periods - 1 times at least."""
    return min(max(min_words - (min_periods - 1) * q, q) + 1 for q in range(1, min_words + 1))


def _grams(ids: np.ndarray, text: np.ndarray, size: int) -> np.ndarray:
    """A number for each place but the last size - 1: equal exactly if the grams there are equal and of the same text."""
    key = text.astype(np.int64)
    for k in range(size):
        step = ids[k : len(ids) - size + 1 + k]
        top = int(step.max()) + 1
        if (int(key.max()) + 1) * top >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
        key = key[: len(step)] * top + step
    return key


def stretches(ids: np.ndarray, text: np.ndarray, min_words: int, min_periods: int) -> list[tuple[int, int]]:
    """[begin, end) of what may hold runs: stretches of one text in which every gram occurs min_periods - 1 times or more.

    Each run lies within one, since its own words hold each of its grams as often. The others of a text's words can't
    belong to a run; the automaton needs no states for them.
    """
    size, often = gram_size(min_words, min_periods), min_periods - 1
    out, open_ = [], [(0, len(ids))]
    while open_:
        begin, end = open_.pop()
        if end - begin < max(min_words, size):
            continue
        part, own = ids[begin:end], text[begin:end]
        _, which, count = np.unique(_grams(part, own, size), return_inverse=True, return_counts=True)
        alive = (count[which] >= often) & (own[: len(which)] == own[size - 1 :])
        # A place that opens another text ends a stretch as well.
        edges = np.flatnonzero(np.diff(np.concatenate([[False], alive, [False]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a == len(which):
                out.append((begin, end))
            else:
                open_.append((begin + a, begin + b + size - 1))
    return out


def find(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, n_words, runs, collapsed), one row per row.

    runs: array of (start, length, period) by start, then period, in words of the whole text numbered from 0. A run is a
    stretch of words with smallest period q, of max(min_words, min_periods * q) words or more, that no neighbouring word
    extends. collapsed: the words that no run holds after its first q words, joined by one space. A null text is empty:
    no words, no runs, the empty text. Repeated rows stay; other columns aren't read; an empty table gives an empty table.

    Texts are independent of each other: nothing is shuffled. Memory goes with a batch of texts and, for the automaton,
    with the longest stretch of one text that may hold runs (about 1 KB a word there).
    """
    prepare(docs.sparkSession)
    run_type = StructType().add("start", "long").add("length", "long").add("period", "long")
    schema = StructType().add("doc_id", docs.schema["doc_id"].dataType).add("n_words", LongType()).add("runs", ArrayType(run_type)).add("collapsed", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"))
            ids, text = words.ids, words.text_of_word()
            kept = np.ones(len(words), dtype=bool)
            found: list[list[dict[str, int]]] = [[] for _ in range(words.n_texts)]
            for begin, end in sorted(stretches(ids, text, min_words, min_periods)):
                k = int(text[begin])
                for start, length, period in runs_of(ids[begin:end].tolist(), min_words, min_periods):
                    kept[begin + start + period : begin + start + length] = False
                    found[k].append({"start": begin + start - int(words.first[k]), "length": length, "period": period})
            ends = np.zeros(len(kept) + 1, dtype=np.int64)
            np.cumsum(kept, out=ends[1:])
            lists = pa.LargeListArray.from_arrays(pa.array(ends[words.first]), words.distinct.take(pa.array(ids[kept])))
            collapsed = pc.binary_join(lists, pa.scalar(b" ", pa.large_binary())).cast(pa.large_string()).cast(pa.string())
            rows = [sorted(r, key=lambda x: (x["start"], x["period"])) for r in found]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(rows, kind), collapsed], names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select("doc_id", "text").mapInArrow(lean(run), schema)


def longest(runs: str = "runs"):  # noqa: ANN201
    """The run of greatest length; ties go to the smallest start, then period. Null without a run."""
    ordered = F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    best = F.array_max(ordered)
    return F.when(F.size(runs) > 0, F.struct((-best["start"]).alias("start"), best["length"].alias("length"), (-best["period"]).alias("period")))
