"""LM scoring: a backoff automaton of smoothed n-grams, its parts brought to the texts that need them, run over each text.

States are histories, arcs the n-grams seen in training; a state's failure arc leads to the next shorter history. Counts
are discounted by a constant (public: Ney, Essen and Kneser, 1994): what a state's arcs lose is what its failure arc hands on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, discard, free_shuffles, lean, mix64, per_text, prepare, save
from .packs import expand, expand_sorted, pack, squeeze, squeeze_sorted, unpack, word_hashes

#: Words of history + 1; what is taken off each count of an n-gram of two words or more.
ORDER, DISCOUNT = 3, 0.75
#: Keys go by their upper bits to 2**RANGE ranges of each order; FAN packs' counts of a range meet in one task, and where
#: there are more packs, their sums, cut 2**SPLIT times finer, meet in turn.
RANGE, SPLIT, FAN = 6, 8, 256
#: Hashes of the two marks. An even key is of one token, an odd one of a longer n-gram or of the start.
END, START = np.uint64(0x9E3779B97F4A7C14), np.uint64(0xD1B54A32D192ED03)
_ASKED = "bucket long, asker long, keys binary, own binary"
_TOLD = "bucket long, asker long, totals binary, n long, v long"


class Tokens:
    """The tokens of a pack: words and an end for each text, with the keys of the n-grams that end at each token.

    For each order: keys (distinct, ascending), own (training counts in the pack), where (each token's key; -1: none),
    and, for two tokens or more, history (each key's history among the keys of the order below). The mark of the start
    is a key among the single tokens: the history of each text's first token. Orders below least stay empty.
    """

    def __init__(self, lengths: list[int], blob: bytes, held: list[bool], order: int, least: int = 0) -> None:
        words = Words(unpack(lengths, blob), lower=True)
        known = word_hashes(words) & ~np.uint64(1)
        self.counts = words.counts + 1
        self.first = np.zeros(len(lengths) + 1, dtype=np.int64)
        np.cumsum(self.counts, out=self.first[1:])
        n, texts = int(self.first[-1]), len(lengths)
        tokens = np.empty(n, dtype=np.uint64)
        is_end = np.zeros(n, dtype=bool)
        is_end[self.first[1:] - 1] = True
        tokens[is_end] = END
        if len(words):
            tokens[~is_end] = known
        train = ~np.array(held, dtype=bool)
        self.train = np.repeat(train, self.counts)
        place = np.arange(n) - np.repeat(self.first[:-1], self.counts)
        self.keys: list[np.ndarray] = []
        self.own: list[np.ndarray] = []
        self.where: list[np.ndarray] = []
        self.history: list[np.ndarray | None] = []
        if least == 0:
            where = self._table(np.concatenate([tokens, np.full(texts, START)]), np.concatenate([self.train, train]))
            self.start = int(where[n]) if texts else 0
            self.where.append(where[:n])
        else:
            self._skip()
        self.history.append(None)
        before, key = tokens, tokens
        for k in range(1, order):
            before = np.roll(before, 1)
            before[place == k - 1] = START
            key = mix64(key * np.uint64(0x9FB21C651E98DF25) + mix64(before)) | np.uint64(1)
            if k < least:
                self._skip()
                self.history.append(None)
                continue
            # A text's first tokens have no longer history than the start.
            has = np.flatnonzero(place >= k - 1)
            where = np.full(n, -1, dtype=np.int64)
            where[has] = self._table(key[has], self.train[has])
            if k == least:
                self.where.append(where)
                self.history.append(None)
                continue
            shorter = np.roll(self.where[-1], 1)
            if k == 1:
                shorter[place == 0] = self.start
            history = np.zeros(len(self.keys[k]), dtype=np.int64)
            history[where[has]] = shorter[has]
            self.where.append(where)
            self.history.append(history)

    def _skip(self) -> None:
        self.keys.append(np.zeros(0, dtype=np.uint64))
        self.own.append(np.zeros(0, dtype=np.uint32))
        self.where.append(np.zeros(0, dtype=np.int64))

    def _table(self, keys: np.ndarray, train: np.ndarray) -> np.ndarray:
        by = np.argsort(keys)
        fresh = np.ones(len(by), dtype=bool)
        fresh[1:] = keys[by][1:] != keys[by][:-1]
        where = np.empty(len(by), dtype=np.int64)
        where[by] = np.cumsum(fresh) - 1
        self.keys.append(keys[by][fresh])
        self.own.append(np.bincount(where[train], minlength=int(fresh.sum())).astype(np.uint32))
        return where


class Automaton:
    """The part of the automaton that a pack's texts run through.

    With c a count, N(h) the number of distinct arcs of state h, D the discount and p' the probability from the next
    shorter history: an arc has p = (c(hw) - D) / c(h) + D N(h) / c(h) p', and the failure arc weighs D N(h) / c(h), so
    that each state's arcs and failures sum to one. The root adds one to each count, one more for all unknown words
    together. A history that training doesn't have is no state: then the state is the longest one that it has.
    """

    def __init__(self, tokens: Tokens, counts: list[np.ndarray], kinds: list[np.ndarray], n: int, v: int, discount: float) -> None:
        """counts: of each order's keys; kinds: distinct arcs of each order's keys but the last; n, v: tokens, distinct ones."""
        p = (counts[0][tokens.where[0]] + 1.0) / (n + v + 1.0)
        #: Whether the token's arc leaves the state of so many words, log10 weights of that arc and of the state's failure.
        self.hit, self.arc, self.fail = [np.ones(len(p), dtype=bool)], [np.log10(p)], [np.zeros(len(p))]
        self.known = counts[0][tokens.where[0]] > 0
        self.start = min(len(counts) - 1, 1 if len(counts[0]) and counts[0][tokens.start] > 0 else 0)
        for k in range(1, len(counts)):
            where = np.maximum(tokens.where[k], 0)
            history, seen = tokens.history[k][where] if len(tokens.keys[k]) else where, counts[k][where].astype(float) if len(tokens.keys[k]) else np.zeros(len(where))
            total = np.maximum(counts[k - 1][history], 1).astype(float)
            # A history that isn't a state has no failure arc: a score that took one would not be a number.
            state = (counts[k - 1][history] > 0) & (tokens.where[k] >= 0)
            back = np.where(state, discount * kinds[k - 1][history] / total, np.nan)
            hit = (seen > 0) & (tokens.where[k] >= 0)
            p = np.where(hit, (seen - discount) / total + back * p, np.where(state, back * p, p))
            self.hit.append(hit)
            self.arc.append(np.log10(p))
            self.fail.append(np.log10(back))
        self.first = tokens.first

    def root(self) -> np.ndarray:
        return np.add.reduceat(self.arc[0], self.first[:-1])

    def run(self) -> np.ndarray:
        """log10 probability of each text: one pass from left to right that carries the state (words of its history)."""
        out, top = [], len(self.hit) - 1
        lo = 0
        while lo < len(self.first) - 1:
            hi = max(lo + 1, int(np.searchsorted(self.first, self.first[lo] + (1 << 16), side="right")) - 1)
            part = slice(int(self.first[lo]), int(self.first[hi]))
            known = self.known[part].tolist()
            hit, arc, fail = ([x[part].tolist() for x in kind] for kind in (self.hit, self.arc, self.fail))
            for begin, end in zip((self.first[lo:hi] - part.start).tolist(), (self.first[lo + 1 : hi + 1] - part.start).tolist(), strict=True):
                state, score = self.start, 0.0
                for i in range(begin, end):
                    while not hit[state][i]:
                        score += fail[state][i]
                        state -= 1
                    score += arc[state][i]
                    # An arc leads to the next longer history; a word that training lacks, taken at the root, is none.
                    if state < top and (state or known[i]):
                        state += 1
                out.append(score)
            lo = hi
        scores = np.array(out)
        if np.isnan(scores).any():
            raise ValueError("The traversal took the failure arc of a history that training doesn't have.")
        return scores


def _rows(bucket: list[int], asker: int, keys: list[np.ndarray], own: list[np.ndarray]) -> pa.RecordBatch:
    data = [pa.array(bucket, pa.int64()), pa.array([asker] * len(bucket), pa.int64()), pa.array([squeeze_sorted(k) for k in keys], pa.binary()), pa.array([squeeze(o.astype(np.uint32)) for o in own], pa.binary())]
    return pa.RecordBatch.from_arrays(data, names=["bucket", "asker", "keys", "own"])


def _ask(orders: list[int], pack_: int, keys: list[np.ndarray], own: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """A pack's keys, by range."""
    for k, mine, counts in zip(orders, keys, own, strict=True):
        at = np.searchsorted(mine >> np.uint64(64 - RANGE), np.arange((1 << RANGE) + 1, dtype=np.uint64))
        some = [int(b) for b in np.flatnonzero(at[1:] > at[:-1])]
        yield _rows([k << RANGE | b for b in some], pack_, [mine[at[b] : at[b + 1]] for b in some], [counts[at[b] : at[b + 1]] for b in some])


class _Meeting:
    """What the askers of a bucket sent: distinct keys and their sums."""

    def __init__(self, table: pa.Table) -> None:
        parts = [expand_sorted(x.as_py()) for x in table.column("keys")]
        keys, self.own = np.concatenate(parts), np.concatenate([expand(x.as_py(), np.uint32) for x in table.column("own")]).astype(np.int64)
        self.ends = np.cumsum([len(p) for p in parts])
        self.by = np.argsort(keys, kind="stable")
        ordered = keys[self.by]
        fresh = np.ones(len(ordered), dtype=bool)
        fresh[1:] = ordered[1:] != ordered[:-1]
        self.begins = np.flatnonzero(fresh)
        self.keys, self.place = ordered[self.begins], np.cumsum(fresh) - 1
        self.sums = np.add.reduceat(self.own[self.by], self.begins)

    def deal(self, totals: np.ndarray, mine: np.ndarray) -> list[bytes]:
        """For each asker, in its order, twice the total of each of its keys; one more in the first that has counted it
        in training, where the key is ours to give (mine)."""
        n = len(self.by)
        first = np.minimum.reduceat(np.where(self.own[self.by] > 0, np.arange(n), n), self.begins)
        value = (totals << 1)[self.place]
        first = first[mine & (first < n)]
        value[first] |= 1
        out = np.empty(n, dtype=np.uint64)
        out[self.by] = value.astype(np.uint64)
        return [squeeze(x) for x in np.split(out, self.ends[:-1])]


def _told(table: pa.Table, blobs: list[bytes], n: int, v: int) -> pa.Table:
    zero = np.zeros(len(blobs), dtype=np.int64)
    some = [zero.copy(), zero.copy()]
    some[0][:1], some[1][:1] = n, v
    return pa.table({"bucket": table.column("bucket"), "asker": table.column("asker"), "totals": pa.array(blobs, pa.binary()), "n": pa.array(some[0]), "v": pa.array(some[1])})


def totals(asked: DataFrame, askers: int, fan: int = FAN, bits: int = RANGE) -> DataFrame:
    """asked(bucket, asker, keys, own) -> (bucket, asker, totals, n, v): for each key the sum of own over all askers.

    totals: see deal(). n, v sum up to the total and the number of counted single tokens. At most about fan askers meet in one
    task; more are grouped, and their sums ask for them, in narrower buckets, level by level. So no task gets more rows
    as the corpus grows, and a key that all packs hold is summed up before it moves on.
    """

    def answer(table: pa.Table) -> pa.Table:
        m = _Meeting(table)
        single = (m.keys & np.uint64(1) == 0) & (table.column("bucket")[0].as_py() >> bits == 0)
        return _told(table, m.deal(m.sums, np.ones(len(m.keys), dtype=bool)), int(m.sums[single].sum()), int((m.sums[single] > 0).sum()))

    if askers <= fan:
        return asked.groupBy("bucket").applyInArrow(answer, _TOLD)
    groups = -(-askers // fan)
    asked = asked.withColumn("group", F.pmod(F.xxhash64("asker"), F.lit(groups)).cast("long"))

    def merge(table: pa.Table) -> pa.Table:
        m, bucket = _Meeting(table), table.column("bucket")[0].as_py()
        at = np.searchsorted(m.keys >> np.uint64(64 - bits - SPLIT) & np.uint64((1 << SPLIT) - 1), np.arange((1 << SPLIT) + 1, dtype=np.uint64))
        some = [int(b) for b in np.flatnonzero(at[1:] > at[:-1])]
        return pa.Table.from_batches([_rows([bucket << SPLIT | b for b in some], table.column("group")[0].as_py(), [m.keys[at[b] : at[b + 1]] for b in some], [m.sums[at[b] : at[b + 1]] for b in some])])

    merged = save(asked.groupBy("bucket", "group").applyInArrow(merge, _ASKED), "merged")
    told = totals(merged, groups, fan, bits + SPLIT).withColumn("parent", F.shiftright("bucket", SPLIT))

    def hand_on(left: pa.Table, right: pa.Table) -> pa.Table:
        m, right = _Meeting(left), right.sort_by("bucket")
        value = np.concatenate([expand(x.as_py()) for x in right.column("totals")]).astype(np.int64)
        return _told(left, m.deal(value >> 1, (value & 1).astype(bool)), int(np.sum(right.column("n").to_numpy())), int(np.sum(right.column("v").to_numpy())))

    return asked.groupBy("bucket", "group").cogroup(told.groupBy("parent", "asker")).applyInArrow(hand_on, _TOLD)


def _answers(told: pa.Table, orders: list[int]) -> list[np.ndarray]:
    """A pack's answers for each order, in the order of its keys."""
    parts = dict(zip(told.column("bucket").to_pylist(), told.column("totals"), strict=True))
    return [np.concatenate([np.zeros(0, np.int64), *(expand(parts[b].as_py()).astype(np.int64) for b in sorted(b for b in parts if b >> RANGE == k))]) for k in orders]


def _kinds(total: np.ndarray, answers: np.ndarray) -> np.ndarray:
    """Distinct arcs of each history: one seen once has one, the others' were asked for."""
    out = np.minimum(total, 1)
    out[total > 1] = answers
    return out


def score(docs: DataFrame, order: int = ORDER, discount: float = DISCOUNT, fold: int = 7, held_out: int = 2, fan: int = FAN) -> DataFrame:
    """docs(doc_id, text, ...) -> (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per row.

    Learns from documents whose crc32(doc_id as text) mod fold isn't held_out (a null id counts as the empty text), and
    scores all, whole texts, null as empty: the end alone. Words are told apart by 64-bit hashes. Nothing is pruned.
    Repeated rows count as often as they stand there; an empty table gives an empty table; other columns aren't read.

    Packs of documents ask for the counts of their n-grams, for one and two tokens at once and then order by order, so that
    not all keys lie on disk together; and last for the number of distinct arcs of the states seen twice or more (of each
    n-gram, one pack is told that it is the first to have it: that one adds it to its state's arcs). Sums meet by ranges
    of keys, see totals(). So no task holds more than a pack and its part of the automaton, or a bucket of a bounded
    number of askers, and what moves grows with the corpus.
    """
    prepare(docs.sparkSession)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held_out, F.lit(held_out == 0))
    packs = save(pack(docs.select("doc_id", held.alias("held"), "text")), "packs")
    n_packs = packs.count()
    every, below = list(range(order)), list(range(order - 1))

    def ask(orders: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    t = Tokens(row["lengths"], row["blob"], row["held"], orders[-1] + 1, orders[0])
                    yield from _ask(orders, row["pack"], [t.keys[k] for k in orders], [t.own[k] for k in orders])

        return run

    thin = packs.select("pack", "held", "lengths", "blob")
    parts = []
    for orders in (every[:2], *([k] for k in every[2:])):
        asked = thin.mapInArrow(lean(ask(orders)), _ASKED)
        parts.append(save(totals(asked if n_packs <= fan else save(asked, "asked"), n_packs, fan), "counts"))
        del asked
        free_shuffles(docs.sparkSession)
    n, v = parts[0].agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    counts = parts[0]
    for part in parts[1:]:
        counts = counts.unionByName(part)

    def arcs(left: pa.Table, right: pa.Table) -> pa.Table:
        """A pack's states that are seen twice or more, with the arcs that it is the first to have."""
        row = left.to_pylist()[0]
        t, found = Tokens(row["lengths"], row["blob"], row["held"], order), _answers(right, every)
        new = [np.bincount(t.history[k + 1][found[k + 1] & 1 == 1], minlength=len(t.keys[k])) for k in below]
        many = [found[k] >> 1 > 1 for k in below]
        return pa.Table.from_batches(list(_ask(below, row["pack"], [t.keys[k][m] for k, m in zip(below, many, strict=True)], [x[m] for x, m in zip(new, many, strict=True)])), schema=pa.schema([("bucket", pa.int64()), ("asker", pa.int64()), ("keys", pa.binary()), ("own", pa.binary())]))

    kinds = counts.select("asker", (F.col("bucket") * 2).alias("bucket"), "totals")
    if order > 1:
        given = counts.select("bucket", "asker", "totals")
        asked = thin.groupBy("pack").cogroup(given.groupBy("asker")).applyInArrow(arcs, _ASKED)
        asked = asked if n_packs <= fan else save(asked, "states")
        states = save(totals(asked, n_packs, fan), "arcs")
        kinds = kinds.unionByName(states.select("asker", (F.col("bucket") * 2 + 1).alias("bucket"), "totals"))
        discard(asked)
        del asked
        free_shuffles(docs.sparkSession)

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        t = Tokens(row["lengths"], row["blob"], row["held"], order)
        bucket = right.column("bucket").to_numpy()
        own, other = (pa.table({"bucket": pa.array(bucket[bucket % 2 == b] // 2), "totals": right.column("totals").filter(pa.array(bucket % 2 == b))}) for b in (0, 1))
        found = [x >> 1 for x in _answers(own, every)]
        kinds = [_kinds(found[k], x >> 1) for k, x in zip(below, _answers(other, below), strict=True)]
        a = Automaton(t, found, kinds, n, v, discount)
        known = per_text((found[0][t.where[0]] > 0).astype(np.int64), t.first)
        return pa.table([pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(t.counts.astype(np.int64)), pa.array(known), pa.array(np.full(len(t.counts), n, dtype=np.int64)), pa.array(a.root()), pa.array(a.run())], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return packs.groupBy("pack").cogroup(kinds.groupBy("asker")).applyInArrow(tell, schema)
