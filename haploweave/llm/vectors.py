"""Embedding near-dedup: vectors described by their nearest pivots in order, retrieved through inverted lists, verified by cosine.

Candidates share at least SHARED of their NEAREST pivots. A pivot's inverted list would grow with the table, so lists are
those of SHARED pivots each: two vectors meet in one if and only if their count of shared pivots reaches SHARED.
(Public: Chávez et al., 2008; Tellez, Chávez and Navarro, 2013.)
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, join_checked, prepare, save
from .components import components

#: Fitting, for each vector length: at most PIVOTS reference vectors, no two of cosine over APART, out of a sample drawn by
#: hash: about SAMPLE vectors of all lengths together, but about FEW at least (or all) of each.
PIVOTS, SAMPLE, FEW, APART = 512, 8192, 256, 0.7
#: Index: a vector's NEAREST pivots; candidates share at least SHARED of them. Sides of a tile hold about TILE rows.
NEAREST, SHARED, TILE = 8, 3, 512


def choose_pivots(sample: np.ndarray, pivots: int = PIVOTS, apart: float = APART) -> np.ndarray:
    """Unit vectors of the sample in order, skipping those close to an earlier one, so that no crowd of copies holds many."""
    chosen = np.zeros((pivots, sample.shape[1]))
    n = 0
    for x in sample:
        if n == pivots:
            break
        if n == 0 or (chosen[:n] @ x).max() < apart:
            chosen[n] = x
            n += 1
    return chosen[:n]


def describe(units: np.ndarray, pivots: np.ndarray, nearest: int = NEAREST) -> np.ndarray:
    """Ids of the nearest pivots of each vector, nearest first (ties: the lower id first)."""
    return np.argsort(-(units @ pivots.T), axis=1, kind="stable")[:, :nearest]


def postings_of(lists: np.ndarray, shared: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the inverted lists of each described vector, and its class in each: its least pivot that isn't the list's but
    comes before the list's last (-1: none). Two vectors of one class share that pivot too: another list counts them."""
    lists = np.sort(lists, axis=1)
    combos = np.array(list(combinations(range(lists.shape[1]), shared)), dtype=np.int64).reshape(-1, shared)
    keys = lists[:, combos] @ (np.int64(base) ** np.arange(shared - 1, -1, -1, dtype=np.int64))
    out = [next((k for k in range(c[-1]) if k not in c), -1) for c in combos.tolist()]
    return keys, np.stack([lists[:, k] if k >= 0 else np.full(len(lists), -1) for k in out], axis=1)


def _units(payloads: list[bytes], kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(payloads), dtype=kind).astype(np.float64).reshape(len(payloads), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def verify_tile(units: np.ndarray, lists: np.ndarray, copies: np.ndarray, key: list[int], across: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of one tile: links of each row (weighted by the other's copies), and the least row reachable in the tile.

    across: the chunk of each row if the tile joins two chunks; then only pairs across count. A pair that meets in more
    than one list is counted in the first only: there, the count of pivots shared up to the list's last is the list's own.
    """
    linked = units @ units.T >= least
    np.fill_diagonal(linked, False)
    if across is not None:
        linked &= across[:, None] != across[None, :]
    if not linked.any():
        return np.zeros(len(units), dtype=np.int64), np.arange(len(units))
    upto = np.unique(lists[lists <= key[-1]])
    member = (lists[:, :, None] == upto[None, None, :]).any(axis=1).astype(np.float32)
    first = linked & (member @ member.T == len(key))
    counts = first @ copies
    lead = np.full(len(units), -1)
    for i in range(len(units)):
        if lead[i] < 0:
            lead[i], todo = i, [i]
            while todo:
                new = np.flatnonzero(linked[todo.pop()] & (lead < 0))
                lead[new] = i
                todo.extend(new.tolist())
    return counts, lead


def links(embeddings: DataFrame, least: float = 0.9, pivots: int = PIVOTS, nearest: int = NEAREST, shared: int = SHARED, tile: int = TILE) -> DataFrame:
    """embeddings(vec_id, embedding, ...) -> (vec_id, n_links, component_id, kept): one row per row.

    Pairs found with cosine >= least (double precision) are linked. Every row is indexed, each vector length by pivots of
    its own; the index is approximate: a pair is found if `shared` of its `nearest` pivots agree. Vectors that are null,
    empty, zero, or with null or non-finite components link with nothing: 0 links, their own vec_id, kept. Vectors of
    different lengths don't link. Equal vectors (by a 64-bit hash of their components) meet as one before the search, and
    are links of each other. Repeated rows count as vectors; a null vec_id takes part and names a component only if it
    has no other id. kept: vec_id = component_id (null ids: false unless alone). An empty table gives an empty table.
    A crowded inverted list is cut into chunks of one class and about tile rows, and pairs of chunks into tiles: tasks share
    it, pairs that another list counts aren't looked at twice where a class is large, and only sums leave a tile, never pairs.
    """
    prepare(embeddings.sparkSession)
    element = embeddings.schema["embedding"].dataType.elementType
    kind = "<f4" if isinstance(element, T.FloatType) else "<f8"
    value = F.col("embedding") if isinstance(element, (T.FloatType, T.DoubleType)) else F.col("embedding").cast("array<double>")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for x in batch.column(1):
                payload = None
                if x.is_valid and len(x) and not x.values.null_count:
                    v = x.values.to_numpy(zero_copy_only=False)
                    if np.isfinite(v).all() and v.any():
                        payload = (v + 0.0).astype(kind).tobytes()
                out.append(payload)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["vec_id", "payload"])

    rows = embeddings.select("vec_id", value.alias("embedding")).mapInArrow(pack, "vec_id long, payload binary")
    rows = save(rows.withColumn("node", F.when(F.col("payload").isNotNull(), F.xxhash64("payload"))), "vectors")
    classes = rows.where("payload is not null").groupBy("node").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("payload").alias("payload"))
    classes = save(classes.withColumn("width", F.length("payload")), "distinct-vectors")
    # Fitting: of each length at least FEW vectors, or all; SAMPLE and FEW bound what the driver gets of one length.
    counted = {r.width: r.n for r in classes.groupBy("width").agg(F.count("*").alias("n")).collect()}
    every = sum(counted.values())
    rates = [(w, min(1.0, max(SAMPLE / every, FEW / n))) for w, n in counted.items()]
    some = embeddings.sparkSession.createDataFrame(rates, "width int, rate double")
    draw = F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53)
    drawn = join_checked(classes.select("node", "width", "payload"), some, ["width"], len(rates)).where(draw < F.col("rate"))
    by_width: dict[int, list] = {}
    for r in drawn.select("width", F.xxhash64("node").alias("h"), "payload").collect():
        by_width.setdefault(r.width, []).append((r.h, bytes(r.payload)))
    refs = {w: choose_pivots(_units([p for _, p in sorted(rows)], kind), pivots) for w, rows in by_width.items()}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["node", "copies", "payload", "width", "pivots", "keys", "classes"]
        for batch in batches:
            widths = batch.column(3).to_numpy()
            for w in np.unique(widths):
                part, own = batch.filter(pa.array(widths == w)), refs[int(w)]
                lists = describe(_units(part.column(2).to_pylist(), kind), own, min(nearest, len(own)))
                keys, extra = postings_of(lists, min(shared, len(own)), pivots)
                made = [pa.array(lists.astype(np.int32).tolist(), pa.list_(pa.int32())), pa.array(keys.tolist(), pa.list_(pa.int64())), pa.array(extra.astype(np.int32).tolist(), pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=names)

    indexed = classes.select("node", "copies", "payload", "width").mapInArrow(index, "node long, copies long, payload binary, width int, pivots array<int>, keys array<long>, classes array<int>")
    indexed = save(indexed, "index")
    postings = indexed.select("node", "width", F.explode(F.arrays_zip("keys", "classes")).alias("p")).select("node", "width", F.col("p.keys").alias("key"), F.col("p.classes").alias("class"))
    by = ["width", "key"]
    crowd = save(postings.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "list-sizes")
    found = postings.join(crowd, by)
    zero = F.lit(0)
    few = found.where(F.col("n") <= tile).select("node", *by, zero.alias("own"), zero.alias("lo"), zero.alias("hi"))
    # Crowded lists: chunks are numbered one after another, those of the large classes first, then those of all else.
    big = crowd.where(F.col("n") > tile).select(*by)
    large = join_checked(postings, big, by, big.count()).groupBy(*by, "class").agg(F.count("*").alias("n"))
    large = large.withColumn("class", F.when(F.col("n") >= tile // 4, F.col("class")).otherwise(-1)).groupBy(*by, "class").agg(F.ceil(F.sum("n") / tile).cast("int").alias("chunks"))
    plans = large.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("class", "chunks"))).alias("plan"))
    plans = plans.withColumn("of", F.flatten(F.transform("plan", lambda x: F.array_repeat(x["class"], x["chunks"]))))
    plans = save(plans.select(*by, "of"), "crowded-lists")
    many = join_checked(postings, plans, by, plans.count())
    many = many.withColumn("class", F.when(F.array_contains("of", F.col("class")), F.col("class")).otherwise(-1))
    mine = F.filter(F.sequence(zero, F.size("of") - 1), lambda i: F.element_at("of", i + 1) == F.col("class"))
    many = many.withColumn("mine", mine).withColumn("own", F.element_at("mine", F.pmod(F.xxhash64("node", "key"), F.size("mine")).cast("int") + 1))
    others = F.filter(F.sequence(zero, F.size("of") - 1), lambda i: (F.col("class") == -1) | (F.element_at("of", i + 1) != F.col("class")))
    many = many.select("node", *by, "own", F.explode(others).alias("other")).select("node", *by, "own", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))
    tiles = few.unionByName(many)
    full = tiles.join(indexed.drop("keys", "classes", "width"), "node").repartition(*by, "lo", "hi").sortWithinPartitions(*by, "lo", "hi", "node")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def result(group: pa.RecordBatch) -> pa.RecordBatch | None:
            if group.num_rows < 2:
                return None
            key, lo, hi = (group.column(c)[0].as_py() for c in ("key", "lo", "hi"))
            digits = [int(key // pivots**k % pivots) for k in range(min(shared, len(refs[group.column("width")[0].as_py()])) - 1, -1, -1)]
            lists = np.array(group.column("pivots").to_pylist(), dtype=np.int64)
            across = group.column("own").to_numpy(zero_copy_only=False) if lo != hi else None
            copies = group.column("copies").to_numpy(zero_copy_only=False)
            counts, lead = verify_tile(_units(group.column("payload").to_pylist(), kind), lists, copies, digits, across, least)
            nodes = group.column("node").to_numpy(zero_copy_only=False)
            some = (counts > 0) | (lead != np.arange(len(lead)))
            if not some.any():
                return None
            return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(nodes[lead[some]]), pa.array(counts[some].astype(np.int64))], names=["a", "b", "n"])

        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            w, k, lo, hi = (held.column(c).to_numpy() for c in ("width", "key", "lo", "hi"))
            cuts = np.flatnonzero((w[1:] != w[:-1]) | (k[1:] != k[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            if len(cuts):
                flat = held.combine_chunks().to_batches()[0]
                for a, b in zip([0, *cuts[:-1]], cuts, strict=True):
                    if (out := result(flat.slice(a, b - a))) is not None:
                        yield out
                held = held.slice(int(cuts[-1]))
        if held is not None and (out := result(held.combine_chunks().to_batches()[0])) is not None:
            yield out

    pairs = save(full.mapInArrow(check, "a long, b long, n long"), "pairs")
    groups = components(pairs.select("a", "b"))
    counts = pairs.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = classes.select("node", "least_id", "copies").join(counts, "node", "left").join(groups.withColumnRenamed("vertex", "node"), "node", "left")
    named = save(named.select("node", "least_id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("root")), "named")
    least_of = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    answers = named.join(least_of, "root").select("node", "n_links", "component_id")
    out = rows.select("vec_id", "node").join(answers, "node", "left")
    discard(indexed)
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
