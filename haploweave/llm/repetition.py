"""Quality rules on repetition inside a text, by a suffix array over its words and the intervals of common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, lean, per_text, prepare

#: Rules beyond the base. Repeats shorter than MIN_REPEAT words are ordinary language.
MIN_REPEAT, MAX_COVERED, MAX_LONGEST = 6, 0.35, 100
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_BLANKS = " \t\n\r\x0b\x0c"


def suffix_ranks(ids: np.ndarray, text_end: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix ranks of many texts at once by prefix doubling; also the classes of prefixes of 1, 2, 4, ... words.

    Texts never share a class, so that the suffixes of each text stand together. A class is named by its first place
    in the suffix array; only suffixes whose class holds others are sorted again in the next step.
    """
    n = len(ids)
    order = np.lexsort((ids, text))
    fresh = np.ones(n, dtype=bool)
    fresh[1:] = (ids[order][1:] != ids[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = place
    levels, k = [rank.astype(np.int32)], 1
    several = np.bincount(rank, minlength=n)[rank] > 1
    active = np.flatnonzero(several)
    while len(active):
        after = active + k
        second = np.where(after < text_end[active], rank[np.minimum(after, n - 1)], -1)
        key = rank[active] * (n + 1) + second + 1
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        fresh = np.ones(len(active), dtype=bool)
        fresh[1:] = key[1:] != key[:-1]
        own = rank[active]
        lead = np.ones(len(active), dtype=bool)
        lead[1:] = own[1:] != own[:-1]
        spot = np.arange(len(active))
        rank[active] = own + np.maximum.accumulate(np.where(fresh, spot, 0)) - np.maximum.accumulate(np.where(lead, spot, 0))
        levels.append(rank.astype(np.int32))
        k *= 2
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        active = active[~alone]
    return rank, levels


def longest_repeats(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the length in words of the longest substring that starts there and occurs elsewhere in its text.

    That is the value of the innermost interval of common prefixes around the suffix; the outer intervals' substrings
    start at the same word and are shorter, so that the spans' union is the union over all maximal repeats.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, dtype=np.int64)
    counts = np.diff(first)
    text, text_end = np.repeat(np.arange(len(counts)), counts), np.repeat(first[1:], counts)
    rank, levels = suffix_ranks(ids, text_end, text)
    array = np.empty(n, dtype=np.int64)
    array[rank] = np.arange(n)
    common = np.zeros(n + 1, dtype=np.int64)  # common[i]: of array[i - 1] and array[i]
    at = np.flatnonzero(levels[0][array[1:]] == levels[0][array[:-1]]) + 1
    a, b = array[at - 1].copy(), array[at].copy()
    for level in range(len(levels) - 1, -1, -1):
        inside = (a < text_end[array[at - 1]]) & (b < text_end[array[at]])
        same = inside & (levels[level][np.minimum(a, n - 1)] == levels[level][np.minimum(b, n - 1)])
        step = same.astype(np.int64) << level
        common[at] += step
        a, b = a + step, b + step
    out = np.empty(n, dtype=np.int64)
    out[array] = np.maximum(common[:-1], common[1:])
    return out


def covered(lengths: np.ndarray, least: int) -> np.ndarray:
    """Words in the union of spans [i, i + lengths[i]) of at least `least` words."""
    at = np.flatnonzero(lengths >= least)
    steps = np.zeros(len(lengths) + 1, dtype=np.int64)
    np.add.at(steps, at, 1)
    np.subtract.at(steps, at + lengths[at], 1)
    return np.cumsum(steps[:-1]) > 0


def _measure(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    words = Words(texts)
    lengths = longest_repeats(words.ids, words.first) if len(words) else np.zeros(0, np.int64)
    letters = np.zeros(len(words.data) + 1, dtype=np.int64)
    np.cumsum((words.data & 0xC0) != 0x80, out=letters[1:])
    chars = letters[words.ends] - letters[words.starts]
    twice, spans = covered(lengths, 8), covered(lengths, min_repeat)
    lines = []
    for t in texts:
        own = [x for x in (t.as_py() or "").split("\n") if x.strip(_BLANKS)]
        lines.append(len(own) - len(set(own)))
    word_chars = per_text(chars, words.first)
    longest = np.zeros(words.n_texts, dtype=np.int64)
    has = np.flatnonzero(words.counts)
    if len(has):
        longest[has] = np.maximum.reduceat(lengths, words.first[has])
    return {"n_words": words.counts.astype(np.int64), "word_chars": word_chars, "n_symbols": per_text(_SYMBOLS[words.data], words.bounds), "n_dup_lines": np.array(lines, dtype=np.int64), "n_repeat_words": per_text(twice, words.first), "repeat_chars": per_text(chars * spans, words.first), "longest_repeat": longest}


def measures(docs: DataFrame, min_repeat: int = MIN_REPEAT, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> keep columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, repeat_chars, longest_repeat.

    repeat_chars: code points of words in substrings of min_repeat words or more that occur again in the same text (the
    first occurrence included; occurrences may overlap); longest_repeat: words of the longest. No shuffle: each text is
    read whole and alone, one row out for each row in, repeated rows and null ids too. Null or empty text: zeros.
    """
    prepare(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_chars", "longest_repeat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.array([len(t.as_buffer()) if t.is_valid else 0 for t in batch.column(len(keep))], dtype=np.int64)
            group = np.cumsum(sizes) // (1 << 20)  # about a megabyte of text at a time; a longer text alone
            cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                part = batch.slice(lo, hi - lo)
                found = _measure(part.column(len(keep)), min_repeat)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *[pa.array(found[x], pa.int64()) for x in names]], names=[*keep, *names])

    picked = docs.select(*keep, "text")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1]), *(f"{x} long" for x in names)])
    return picked.mapInArrow(lean(run), schema)


def judge(docs: DataFrame, min_repeat: int = MIN_REPEAT, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """measures() with base_failed and kept.

    base_failed: under 20 words, or over 30 % of the words in 8-word windows found twice. kept: base passed, and repeats
    of min_repeat words or more cover at most max_covered of the characters in words, and none is over max_longest words.
    """
    found = measures(docs, min_repeat, keep)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    passed = (F.col("repeat_chars") <= F.lit(max_covered) * F.col("word_chars")) & (F.col("longest_repeat") <= max_longest)
    return found.withColumns({"base_failed": failed, "kept": ~failed & passed})


def select_kept(docs: DataFrame, **options: float) -> DataFrame:
    """Rows of docs that judge() keeps, columns as they were: each row carries its own, so nothing is joined or shuffled."""
    names = docs.columns
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), "text")
    return judge(packed, keep=("row",), **options).where("kept").select("row.*")
