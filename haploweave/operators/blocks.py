"""Pairs of all sequences by blocks: a row holds so many sequences, two rows meet, and their distances are one product.

What leaves a pair of blocks is what a caller asks for: all distances, the nearest sequences of other components, or links.
No pair is a row of a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.states import AMBIGUOUS
from ..session import ship
from ..shared import discard, save

#: Sequences of a block; bytes of a batch on its way to Python.
BLOCK, BATCH_BYTES = 512, 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return ship(spark)


def spread(rows: DataFrame, *columns: str) -> DataFrame:
    """rows dealt out by the columns: they are few and small and much is worked out from each, so that their bytes say nothing."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *columns)


def codes(texts: list[str], kind: str) -> np.ndarray:
    """A line of numbers for each text, 0 for unknown states and beyond its end; a byte each where that is enough."""
    width = max(map(len, texts), default=0)
    found = np.array(texts, dtype=f"U{max(width, 1)}").view(np.uint32).reshape(len(texts), -1)[:, :width].copy()
    found[np.isin(found, [ord(c) for s in AMBIGUOUS[kind] for c in (s, s.lower())])] = 0
    return found.astype(np.uint8) if found.max(initial=0) < 256 else found


def apart(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of the sites at which both lines are known and differ: those known to both less those alike."""
    states = np.union1d(x, y)
    states = states[states > 0]
    number = np.float32 if weights.sum() < 1 << 24 else np.float64
    left = np.concatenate([(x != 0) * weights, *(-((x == s) * weights) for s in states)], axis=1).astype(number)
    right = np.concatenate([y != 0, *(y == s for s in states)], axis=1).astype(number)
    return np.rint(left @ right.T).astype(np.int64)


def stacked(sequences: DataFrame, kind: str = "dna", block: int = BLOCK) -> DataFrame:
    """sequences(network_id, index, seq[, weights][, labels][, datatype]) -> a row a block: (network_id, block, n, index, codes,
    weights, labels), the last four as bytes. weights: one array a network; labels: an array of longs for each sequence.
    """
    prepare(sequences.sparkSession)
    net = sequences.schema["network_id"].dataType.simpleString()
    extra = [c for c in ("weights", "labels", "datatype") if c in sequences.columns]
    rows = sequences.select("network_id", F.floor(F.col("index") / block).cast("int").alias("block"), F.col("index").cast("long").alias("index"), "seq", *extra)

    def stack(table: pa.Table) -> pa.Table:
        table = table.sort_by("index")
        found = codes(table.column("seq").to_pylist(), table.column("datatype")[0].as_py() if "datatype" in extra else kind)
        weights = np.array(table.column("weights")[0].as_py() if "weights" in extra else np.ones(found.shape[1]), dtype=np.int64)
        labels = np.array(table.column("labels").to_pylist() if "labels" in extra else [], dtype=np.int64)
        out = table.slice(0, 1).select(["network_id", "block"]).append_column("n", pa.array([len(found)], pa.int32()))
        for name, x in (("index", table.column("index").to_numpy()), ("codes", found), ("weights", weights), ("labels", labels)):
            out = out.append_column(name, pa.array([x.tobytes()], pa.binary()))
        return out

    return rows.groupBy("network_id", "block").applyInArrow(stack, f"network_id {net}, block int, n int, index binary, codes binary, weights binary, labels binary")


def lines(n: int, data: bytes, sites: int) -> np.ndarray:
    return np.frombuffer(data, dtype=np.uint8 if len(data) == n * sites else np.uint32).reshape(n, sites)


def met(stacks: DataFrame, of: Callable[[np.ndarray, tuple, tuple], Iterator[tuple[np.ndarray, ...]]], columns: str) -> DataFrame:
    """(network_id, columns) of what of() gives for each two blocks, the one of higher indices first, and each with itself:
    of(distances, (index, labels), (index, labels)), -1 for distances that don't count: of a sequence to itself or a later one.
    """
    name = to_arrow_type(stacks.schema["network_id"].dataType)
    kinds = {"long": pa.int64(), "int": pa.int32()}
    fields = [c.split() for c in columns.split(", ")]
    wanted = pa.schema([("network_id", name), *((c, kinds[k]) for c, k in fields)])
    a = stacks.select("network_id", *(F.col(c).alias(f"{c}_a") for c in ("block", "n", "index", "codes", "weights", "labels")))
    b = stacks.select("network_id", *(F.col(c).alias(f"{c}_b") for c in ("block", "n", "index", "codes", "labels")))
    pairs = spread(a.join(b, "network_id").where("block_a >= block_b"), "network_id", "block_a", "block_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.drop_columns(["network_id"]).to_pylist():
                weights = np.frombuffer(r["weights_a"], dtype=np.int64)
                x, y = (lines(r[f"n_{s}"], r[f"codes_{s}"], len(weights)) for s in "ab")
                d = apart(x, y, weights)
                if r["block_a"] == r["block_b"]:
                    d[~np.tri(len(d), k=-1, dtype=bool)] = -1
                p, q = ((np.frombuffer(r[f"index_{s}"], dtype=np.int64), np.frombuffer(r[f"labels_{s}"], dtype=np.int64).reshape(r[f"n_{s}"], -1)) for s in "ab")
                for found in of(d, p, q):
                    whole = [pa.repeat(pa.scalar(r["net"], name), len(found[0])), *(pa.array(x.astype(k.to_pandas_dtype(), copy=False), k) for x, k in zip(found, wanted.types[1:], strict=True))]
                    yield pa.RecordBatch.from_arrays(whole, schema=wanted)

    kind = stacks.schema["network_id"].dataType.simpleString()
    return pairs.withColumn("net", F.col("network_id")).mapInArrow(run, f"network_id {kind}, {columns}")


def distances(stacks: DataFrame) -> DataFrame:
    """(network_id, i, j, d) for all i > j."""

    def all_(d: np.ndarray, p: tuple, q: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        i, j = np.nonzero(d >= 0)
        yield p[0][i], q[0][j], d[i, j]

    return met(stacks, all_, "i int, j int, d long")


def _nearest(below: float) -> Callable[..., Iterator[tuple[np.ndarray, ...]]]:
    def nearest(d: np.ndarray, p: tuple, q: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        own, other = p[1][:, 0], q[1][:, 0]
        if own.min() == own.max() == other.min() == other.max():
            return
        far = np.iinfo(np.int64).max
        d = np.where((d >= 0) & (own[:, None] != other[None, :]), d, far)
        for e, (x, cx), (y, cy) in ((d, (p[0], own), (q[0], other)), (d.T, (q[0], other), (p[0], own))):
            at = e.argmin(axis=1)
            least = e[np.arange(len(x)), at]
            some = np.flatnonzero((least < far) & (least < below))
            low, high = np.minimum(x[some], y[at[some]]), np.maximum(x[some], y[at[some]])
            order = np.lexsort((high, low, least[some], cx[some]))
            first = order[np.flatnonzero(np.diff(cx[some][order], prepend=-1))]
            yield cx[some][first], least[some][first], low[first], high[first], cy[at[some]][first]

    return nearest


def _roots(table: pa.Table) -> pa.Table:
    """One network's components, each with the one it merges with -> the least component of all that merge. Links are told
    apart by (distance, indices), so that they close no ring but of two components that choose the same."""
    own, other = table.column("component").to_numpy(), table.column("other").to_numpy()
    names = np.union1d(own, other)
    up = np.arange(len(names))
    up[np.searchsorted(names, own)] = np.searchsorted(names, other)
    up = np.where((up[up] == np.arange(len(names))) & (up > np.arange(len(names))), np.arange(len(names)), up)
    while (up[up] != up).any():
        up = up[up]
    least = np.full(len(names), len(names))
    np.minimum.at(least, up, np.arange(len(names)))
    return pa.table({"network_id": pa.repeat(table.column("network_id")[0], len(names)), "component": names, "root": names[least[up]]})


def tree(sequences: DataFrame, kind: str = "dna", below: float = float("inf"), block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """sequences(network_id, index, seq) -> (network_id, index, component) and (network_id, i, j, d): what links shorter than
    below connect, named by the least index, and the links of the minimum spanning trees (of ties, the lowest indices).

    In each round every component takes its nearest link to another: half the components, at most, are left. A task holds
    two blocks, or a row for each component of one network.
    """
    net = sequences.schema["network_id"].dataType.simpleString()
    labels = save(sequences.select("network_id", F.col("index").cast("long").alias("index"), "seq", F.col("index").cast("long").alias("component")), "labels")
    links = labels.select("network_id", F.col("index").alias("i"), F.col("index").alias("j"), F.col("index").alias("d")).limit(0)
    while True:
        stacks = stacked(labels.withColumn("labels", F.array("component")), kind, block)
        near = met(stacks, _nearest(below), "component long, d long, low long, high long, other long")
        chosen = save(near.groupBy("network_id", "component").agg(F.min(F.struct("d", "low", "high", "other")).alias("m")).select("network_id", "component", "m.*"), "chosen")
        if chosen.isEmpty():
            return labels.select("network_id", "index", "component"), links.distinct()
        links = links.unionByName(chosen.select("network_id", F.col("high").alias("i"), F.col("low").alias("j"), "d"))
        roots = chosen.select("network_id", "component", "other").groupBy("network_id").applyInArrow(_roots, f"network_id {net}, component long, root long")
        new = save(labels.join(roots, ["network_id", "component"], "left").select("network_id", "index", "seq", F.coalesce("root", "component").alias("component")), "labels")
        discard(labels)
        labels = new


def _grown(table: pa.Table) -> pa.Table:
    """One network's tree -> for each sequence its components after each length of the links, shorter ones first."""
    i, j, d = (table.column(c).to_numpy() for c in ("i", "j", "d"))
    names = np.union1d(i, j)
    i, j, lengths = np.searchsorted(names, i), np.searchsorted(names, j), np.unique(d)
    up, after = np.arange(len(names)), [np.arange(len(names))]
    for t in lengths:
        top = up.tolist()

        def root(x: int, top: list[int] = top) -> int:
            while top[x] != x:
                top[x] = x = top[top[x]]
            return x

        for k in np.flatnonzero(d == t).tolist():
            a, b = root(int(i[k])), root(int(j[k]))
            top[max(a, b)] = min(a, b)
        up = np.array(top)
        while (up[up] != up).any():
            up = up[up]
        after.append(up)
    labels = [row.tolist() for row in np.column_stack([*after, np.broadcast_to(lengths, (len(names), len(lengths)))])]
    return pa.table({"network_id": pa.repeat(table.column("network_id")[0], len(names)), "index": names, "labels": pa.array(labels, pa.list_(pa.int64()))})


def _linked(epsilon: float) -> Callable[..., Iterator[tuple[np.ndarray, ...]]]:
    def linked(d: np.ndarray, p: tuple, q: tuple) -> Iterator[tuple[np.ndarray, ...]]:
        turns = p[1].shape[1] // 2
        lengths = p[1][0, turns + 1 :]
        i, j = np.nonzero((d >= 0) & (d <= lengths[-1] + epsilon))
        shorter = np.searchsorted(lengths, d[i, j] - epsilon)
        kept = p[1][i, shorter] != q[1][j, shorter]
        yield p[0][i[kept]], q[0][j[kept]], d[i, j][kept]

    return linked


def links(sequences: DataFrame, epsilon: float = 0, kind: str = "dna", block: int = BLOCK) -> DataFrame:
    """(network_id, i, j, d), i > j: pairs that links shorter than d - epsilon don't connect, d at most epsilon above the
    longest link of the minimum spanning tree."""
    net = sequences.schema["network_id"].dataType.simpleString()
    sequences = save(sequences.select("network_id", F.col("index").cast("long").alias("index"), "seq"), "sequences")
    grown = tree(sequences, kind, block=block)[1].groupBy("network_id").applyInArrow(_grown, f"network_id {net}, index long, labels array<bigint>")
    return met(stacked(sequences.join(grown, ["network_id", "index"]), kind, block), _linked(epsilon), "i long, j long, d long")


def known(seq: Column, kind: str, states: str) -> Column:
    """seq in upper case; a state that is neither one of states nor unknown fails the job."""
    up = F.upper(seq)
    rest = F.translate(up, states + "".join(AMBIGUOUS[kind]), "")
    return F.when(F.length(rest) > 0, F.raise_error(F.concat(F.lit("A state has no code: "), rest))).otherwise(up)
