"""Shortest paths of whole networks: by stripes of vertices, and the paths themselves as rows.

A stripe holds the lengths from some vertices to all others. It grows along the edges, which it has at hand: they are to its
lengths as a line of a square to the square. Networks of more than EDGES edges, and such as have weights that aren't whole,
go by min-plus products of square tiles: a tile holds the lengths between TILE vertices and TILE others, those of (row, k)
and (k, column) meet where the middle is the same, and lengths of twice as many edges come out of each round.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import ship
from ..shared import discard, save
from . import blocks, graph
from .graph import endpoints

TILE = 64
#: Edges of a network that goes by stripes; cells of a stripe, cells that edges bring to at a time, rows sent at once.
EDGES, CELLS, CELLS_AT_ONCE, SENT = 1 << 21, 1 << 20, 1 << 16, 1 << 18
#: Stripes that go together with one copy of their network's edges.
TOGETHER = 4
#: A cell of a stripe: length, then the highest vertex between, plus 1.
_FAR, _VIA = 1 << 62, (1 << 32) - 1
#: Products that a task adds up before it sends them on; bytes of a batch on its way to Python.
HELD, BATCH_BYTES = 64, 8 << 20
_TILES = "network_id {0}, row int, col int, lengths binary, vias binary, changed boolean"


def better(length: np.ndarray, via: np.ndarray, other: np.ndarray, other_via: np.ndarray) -> np.ndarray:
    """Take over, in place, what is shorter in other, or as short by lower vertices; where it did."""
    better_ = (other < length) | ((other == length) & (other_via < via))
    length[better_], via[better_] = other[better_], other_via[better_]
    return better_


def product(a: np.ndarray, va: np.ndarray, b: np.ndarray, vb: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Least lengths over all vertices first, first + 1, ... between two tiles, and the highest vertex between, least first."""
    length, via = np.full_like(a, np.inf), np.full_like(va, np.iinfo(np.int32).max)
    for k in range(a.shape[0]):
        if np.isfinite(a[:, k]).any() and np.isfinite(b[k]).any():
            better(length, via, a[:, k, None] + b[None, k], np.maximum(np.maximum(va[:, k, None], vb[None, k]), first + k))
    return length, via


def shortest_paths(vertices: DataFrame, edges: DataFrame, tile: int | None = None, of: tuple[str, ...] = ("length", "via")) -> DataFrame:
    """(network_id, i, j, length, via), or only those of the last two that are asked for, for all ordered pairs that are connected, 0 from a vertex to itself.

    length: the least sum of weights (not negative; parallel edges count by the least). via: of the shortest paths'
    highest vertices between the ends, the lowest, -1 where an edge is a shortest path: the vertex that the classic triple
    loop over k, i, j notes last. tile: go by tiles of this size.
    """
    if tile:
        return _by_tiles(vertices, edges, tile).select("network_id", "i", "j", *of)
    (v, e), rest = _parted(vertices, edges)
    return _all(_by_stripes(v, e, of), rest, _by_tiles)


def _by_tiles(vertices: DataFrame, edges: DataFrame, tile: int = TILE) -> DataFrame:
    """Only tiles that hold a path exist. No task holds more than one middle's tiles at a time, and what comes together for
    one tile of the result is one tile for each middle."""
    spark = ship(edges.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    kind, net = edges.schema["network_id"].dataType.simpleString(), to_arrow_type(edges.schema["network_id"].dataType)
    ends = endpoints(edges).select("network_id", F.col("vertex").alias("i"), F.col("other").alias("j"), F.col("weight").cast("double").alias("length"))
    zero = vertices.select("network_id", F.col("index").alias("i"), F.col("index").alias("j"), F.lit(0.0).alias("length"))
    cells = ends.unionByName(zero).groupBy("network_id", "i", "j").agg(F.min("length").alias("length"))
    cells = cells.withColumns({"row": F.floor(F.col("i") / tile).cast("int"), "col": F.floor(F.col("j") / tile).cast("int"), "at": (F.col("i") % tile * tile + F.col("j") % tile).cast("int")})

    def start(table: pa.Table) -> pa.Table:
        length, via = np.full(tile * tile, np.inf), np.full(tile * tile, -1, dtype=np.int32)
        length[table.column("at").to_numpy()] = table.column("length").to_numpy()
        head = table.slice(0, 1).select(["network_id", "row", "col"])
        return _with_tile(head, length, via, True)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for r in batch.to_pylist():
                found = product(*_arrays(r["la"], r["va"], tile), *_arrays(r["lb"], r["vb"], tile), r["k"] * tile)
                key = (r["network_id"], r["row"], r["col"])
                if key in held:
                    better(*held[key], *found)
                else:
                    held[key] = list(found)
                if len(held) >= HELD:
                    yield from _sent(held, net)
                    held = {}
        yield from _sent(held, net)

    def least(table: pa.Table) -> pa.Table:
        own = [r for r in table.to_pylist() if r["changed"] is None]
        length, via = (x.copy() for x in _arrays(own[0]["lengths"], own[0]["vias"], tile)) if own else (np.full((tile, tile), np.inf), np.full((tile, tile), np.iinfo(np.int32).max, dtype=np.int32))
        changed = False
        for r in table.to_pylist():
            if r["changed"] is not None:
                changed |= bool(better(length, via, *_arrays(r["lengths"], r["vias"], tile)).any())
        return _with_tile(table.slice(0, 1).select(["network_id", "row", "col"]), length.reshape(-1), via.reshape(-1), changed)

    schema = _TILES.format(kind)
    tiles = save(cells.groupBy("network_id", "row", "col").applyInArrow(start, schema), "tiles")
    while not tiles.where("changed").isEmpty():
        a = tiles.select("network_id", "row", F.col("col").alias("k"), F.col("lengths").alias("la"), F.col("vias").alias("va"))
        b = tiles.select("network_id", F.col("row").alias("k"), "col", F.col("lengths").alias("lb"), F.col("vias").alias("vb"))
        products = a.join(b, ["network_id", "k"]).mapInArrow(multiply, schema)
        both = products.unionByName(tiles.withColumn("changed", F.lit(None).cast("boolean")))
        new = save(both.groupBy("network_id", "row", "col").applyInArrow(least, schema), "tiles")
        discard(tiles)
        tiles = new

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(len(batch)):
                one = batch.slice(k, 1)
                row, col, ls, vs = (one.column(c)[0].as_py() for c in ("row", "col", "lengths", "vias"))
                length, via = _arrays(ls, vs, tile)
                i, j = np.nonzero(np.isfinite(length))
                name = one.column("network_id").take(pa.array(np.zeros(len(i), dtype=np.int64)))
                yield pa.RecordBatch.from_arrays([name, pa.array((i + row * tile).astype(np.int32)), pa.array((j + col * tile).astype(np.int32)), pa.array(length[i, j]), pa.array(via[i, j])], names=["network_id", "i", "j", "length", "via"])

    return tiles.mapInArrow(rows, f"network_id {kind}, i int, j int, length double, via int")


def _arrays(lengths: bytes, vias: bytes, tile: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(lengths).reshape(tile, tile), np.frombuffer(vias, dtype=np.int32).reshape(tile, tile)


def _with_tile(head: pa.Table, length: np.ndarray, via: np.ndarray, changed: bool) -> pa.Table:
    out = head.append_column("lengths", pa.array([length.tobytes()], pa.binary())).append_column("vias", pa.array([via.astype(np.int32).tobytes()], pa.binary()))
    return out.append_column("changed", pa.array([changed]))


def _sent(held: dict[tuple, list[np.ndarray]], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    for (net, row, col), (length, via) in held.items():
        columns = [pa.array([net], kind), pa.array([row], pa.int32()), pa.array([col], pa.int32()), pa.array([length.tobytes()], pa.binary()), pa.array([via.astype(np.int32).tobytes()], pa.binary()), pa.array([True])]
        yield pa.RecordBatch.from_arrays(columns, names=["network_id", "row", "col", "lengths", "vias", "changed"])


def path_edges(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """shortest_paths() and edges -> (network_id, i, j, step, vertex, edge): the edges of one shortest path from i to j.

    step: from 0 on; vertex: where the edge leads; edge: of the lightest between its ends, the first. The path is the one
    that the vias describe: to the via, then on. The last vertex before j is found by following vias towards j, in jumps
    that double; then paths unroll by whole stretches of steps, twice as long in each round.
    """
    pairs = paths.where("i != j")
    near = endpoints(edges).groupBy("network_id", F.col("vertex").alias("at"), F.col("other").alias("j")).agg(F.min(F.struct("weight", F.col("edge").alias("edge")))["edge"].alias("edge"))
    before = save(pairs.select("network_id", "i", "j", F.when(F.col("via") < 0, F.col("i")).otherwise(F.col("via")).alias("at"), (F.col("via") < 0).alias("there")), "before")
    while not before.where("not there").isEmpty():
        step = before.select("network_id", F.col("i").alias("at"), "j", F.col("at").alias("next"), F.col("there").alias("next_there"))
        more = before.where("not there").drop("there").join(step, ["network_id", "at", "j"]).select("network_id", "i", "j", F.col("next").alias("at"), F.col("next_there").alias("there"))
        new = save(before.where("there").unionByName(more), "before")
        discard(before)
        before = new
    last = before.join(near, ["network_id", "at", "j"])
    rows = save(last.select("network_id", "i", "j", F.lit(0).alias("back"), F.col("j").alias("vertex"), "edge"), "steps")
    jumps, reach = save(before.select("network_id", "i", "j", "at"), "jumps"), 1
    while not (open_ := jumps.where("at != i")).isEmpty():
        earlier = rows.select("network_id", "i", F.col("j").alias("at"), (F.col("back") + reach).alias("back"), "vertex", "edge")
        grown = save(rows.unionByName(open_.join(earlier, ["network_id", "i", "at"]).select("network_id", "i", "j", "back", "vertex", "edge")), "steps")
        step = jumps.select("network_id", "i", F.col("j").alias("at"), F.col("at").alias("next"))
        further = save(open_.join(step, ["network_id", "i", "at"]).select("network_id", "i", "j", F.col("next").alias("at")).unionByName(jumps.where("at = i")), "jumps")
        discard(rows)
        discard(jumps)
        rows, jumps, reach = grown, further, 2 * reach
    hops = rows.groupBy("network_id", "i", "j").agg(F.count("*").alias("hops"))
    return rows.join(hops, ["network_id", "i", "j"]).select("network_id", "i", "j", (F.col("hops") - 1 - F.col("back")).cast("int").alias("step"), "vertex", "edge")


def _parted(vertices: DataFrame, edges: DataFrame) -> tuple[tuple[DataFrame, DataFrame], tuple[DataFrame, DataFrame] | None]:
    """Vertices and edges of the networks that go by stripes, and of the rest, if there is any."""
    edges = edges if hasattr(edges, "_saved_at") else save(edges, "edges")
    heavy = (F.count("*") > EDGES) | (F.sum("weight") >= 1 << 29) | F.bool_or(F.col("weight") != F.floor("weight"))
    other = edges.groupBy("network_id").agg(heavy.alias("heavy")).where("heavy").select("network_id")
    if other.isEmpty():
        return (vertices, edges), None
    return tuple(tuple(t.join(other, "network_id", how) for t in (vertices, edges)) for how in ("left_anti", "left_semi"))


def _all(found: DataFrame, rest: tuple[DataFrame, DataFrame] | None, plain: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    return found.unionByName(plain(*rest).select(*found.columns)) if rest else found


def _stripes(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A row for each TOGETHER stripes: (network_id, net, part, size, last, and the network's vertices and edges as compressed
    bytes), edges sorted by where they lead: of parallel ones the lightest, then the first."""
    blocks.prepare(edges.sparkSession)
    net = edges.schema["network_id"].dataType.simpleString()
    ends = endpoints(edges).where("vertex != other").groupBy("network_id", F.col("other").cast("long").alias("a"), F.col("vertex").cast("long").alias("b"))
    ends = ends.agg(F.min(F.struct(F.col("weight").cast("long").alias("weight"), F.col("edge").cast("long").alias("edge"))).alias("m")).select("network_id", "a", "b", "m.*")
    alone = vertices.select("network_id", F.col("index").cast("long").alias("a"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("weight"), F.lit(-1).cast("long").alias("edge"))

    def pack(table: pa.Table) -> pa.Table:
        a, b, weight, edge = (table.column(c).to_numpy() for c in ("a", "b", "weight", "edge"))
        vertex, linked = np.unique(a), edge >= 0
        order = np.lexsort((a[linked], b[linked]))
        a, b, weight, edge = (x[linked][order] for x in (a, b, weight, edge))
        out = table.slice(0, 1).select(["network_id"]).append_column("size", pa.array([int(np.clip(CELLS // len(vertex), 16, 256))], pa.int32()))
        out = out.append_column("last", pa.array([len(vertex) - 1], pa.int32()))
        for name, x in (("vertex", vertex), ("source", np.searchsorted(vertex, a)), ("target", np.searchsorted(vertex, b)), ("weight", weight), ("edge", edge)):
            out = out.append_column(name, pa.array([zlib.compress(x.astype(np.int64).tobytes(), 1)], pa.binary()))
        return out

    packed = ends.unionByName(alone).groupBy("network_id").applyInArrow(pack, f"network_id {net}, size int, last int, vertex binary, source binary, target binary, weight binary, edge binary")
    rows = packed.withColumn("net", F.col("network_id")).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / (F.col("size") * TOGETHER)).cast("int"))))
    return blocks.spread(rows, "network_id", "part")


class _Stripe:
    """Lengths and vias from the vertices first, first + 1, ... of one network to all, grown along the edges."""

    def __init__(self, r: dict) -> None:
        self.vertex, self.source, self.target, self.weight, self.edge = (np.frombuffer(r[c], dtype=np.int64) for c in ("vertex", "source", "target", "weight", "edge"))
        self.block, self.first = r["block"], r["block"] * r["size"]
        self.own = np.arange(min(r["size"], len(self.vertex) - self.first))

    def grown(self) -> np.ndarray:
        """[own, vertex]: length << 32 | via + 1. Worked out in cells of half that width where all lengths fit."""
        bits = len(self.vertex).bit_length()
        cells = self._cells(np.int32, bits, 30) if bits < 20 else None
        if cells is None:
            return np.ascontiguousarray(self._cells(np.int64, 32, 62).T)
        wide = np.ascontiguousarray(cells.T).astype(np.int64)
        return np.where(wide < 1 << 30, wide >> bits << 32 | wide & (1 << bits) - 1, _FAR)

    def _cells(self, kind: type, bits: int, top: int) -> np.ndarray | None:
        """[vertex, own]: length << bits | via + 1, 1 << top where there is no path; None if a length or weight may be too
        great for that. What an edge brings is the sum, by the higher of the via and its start."""
        n, at, low, far = len(self.vertex), self.first + self.own, (1 << bits) - 1, 1 << top
        if self.weight.max(initial=0) >= far >> bits + 1:
            return None
        cells = np.full((n, len(at)), far, dtype=kind)
        cells[at, self.own] = 0
        through = (cells & ~low) | np.arange(1, n + 1, dtype=kind)[:, None]
        through[at, self.own] = 0
        led, starts, degree = np.unique(self.target, return_index=True, return_counts=True)
        heavy, fresh = (self.weight << bits).astype(kind)[:, None], np.zeros(n, dtype=bool)
        order = np.argsort(-degree, kind="stable")
        each = max(1, CELLS_AT_ONCE // len(at))
        fresh[at] = True
        while len(led) and fresh.any():
            some = order[np.logical_or.reduceat(fresh[self.source], starts)[order]]
            fresh[:] = False
            # So many edges of one vertex at a time, and then so many vertices that have few.
            many = int(np.searchsorted(-degree[some], -each))
            for part in [*some[:many, None], *(some[k : k + each] for k in range(many, len(some), each))]:
                found = self._brought(through, heavy, starts[part], degree[part], each)
                v = led[part]
                old = cells[v]
                better = (found < old).any(axis=1)
                v = v[better]
                cells[v] = new = np.minimum(found[better], old[better])
                if top < 62 and ((new >= far >> 1) & (new < far)).any():
                    return None
                through[v] = (new & ~low) | np.maximum(new & low, (v[:, None] + 1).astype(kind))
                through[at, self.own] = 0
                fresh[v] = True
        return cells

    def _brought(self, through: np.ndarray, heavy: np.ndarray, starts: np.ndarray, degree: np.ndarray, each: int) -> np.ndarray:
        """The least that edges bring to some vertices: one vertex's, so many at a time, or the first of all, the second, and so
        on. degree: the most first."""
        if len(starts) == 1:
            parts = (slice(k, min(k + each, starts[0] + degree[0])) for k in range(starts[0], starts[0] + degree[0], each))
            return np.min([(through[self.source[e]] + heavy[e]).min(axis=0) for e in parts], axis=0)[None]
        found = through[self.source[starts]] + heavy[starts]
        for k in range(1, degree[0]):
            e = starts[: np.searchsorted(-degree, -k)] + k
            more = through[self.source[e]]
            more += heavy[e]
            np.minimum(found[: len(e)], more, out=found[: len(e)])
        return found

    def hops(self, cells: np.ndarray) -> np.ndarray:
        """[own, vertex]: the edge from an own vertex that its path to the other begins with, -1 where there is none."""
        n = len(self.vertex)
        via = (cells & _VIA) - 1
        at = np.where(via < 0, np.arange(n), via)
        while (at != (further := np.take_along_axis(at, at, axis=1))).any():
            at = further
        out = np.full(at.shape, -1, dtype=np.int32)
        for k in self.own:
            line = np.full(n, -1, dtype=np.int32)
            mine = slice(*np.searchsorted(self.target, [self.first + k, self.first + k + 1]))
            line[self.source[mine]] = np.arange(mine.start, mine.stop)
            out[k] = np.where((cells[k] < _FAR) & (np.arange(n) != self.first + k), line[at[k]], -1)
        return out

    def _starts(self) -> tuple[np.ndarray, type]:
        """Where each vertex's edges begin, and what holds their number."""
        starts = np.searchsorted(self.target, np.arange(len(self.vertex) + 1)).astype(np.int32)
        return starts[:-1], np.min_scalar_type(int(np.diff(starts).max()))

    def places(self, hops: np.ndarray) -> np.ndarray:
        """hops() as places among the edges of the vertex they leave, from 1 on; 0 where there is none."""
        starts, kind = self._starts()
        return np.where(hops < 0, 0, hops + 1 - starts[self.first + self.own][:, None]).astype(kind)

    def edges_at(self, tiles: list[bytes]) -> np.ndarray:
        """[own, vertex]: of places() to the own vertices, from all in their order, the edges."""
        starts, kind = self._starts()
        found = np.frombuffer(b"".join(zlib.decompress(t, -15) for t in tiles), dtype=kind).reshape(-1, len(self.own)).T
        return np.where(found == 0, -1, found + (starts - 1)).astype(np.int32)


_NET = ("vertex", "source", "target", "weight", "edge")


def _stripes_of(r: dict) -> Iterator[_Stripe]:
    """The stripes that a row of _stripes() stands for."""
    net = {c: zlib.decompress(r[c]) for c in _NET}
    for block in range(r["part"] * TOGETHER, min((r["part"] + 1) * TOGETHER, r["last"] // r["size"] + 1)):
        yield _Stripe(r | net | {"block": block})


def _by_stripes(vertices: DataFrame, edges: DataFrame, of: tuple[str, ...]) -> DataFrame:
    kinds = {"length": "double", "via": "int"}
    kind, net = edges.schema["network_id"].dataType.simpleString(), to_arrow_type(edges.schema["network_id"].dataType)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                for stripe in _stripes_of(r):
                    cells, n = stripe.grown(), len(stripe.vertex)
                    for k in range(0, len(cells), step := max(1, SENT // n)):
                        i, j = np.nonzero((some := cells[k : k + step]) < _FAR)
                        found = some[i, j]
                        columns = [stripe.vertex[stripe.first + k + i], stripe.vertex[j], *(found >> 32 if c == "length" else np.append(stripe.vertex, -1)[(found & _VIA) - 1] for c in of)]
                        types = [np.int32, np.int32, *(np.float64 if c == "length" else np.int32 for c in of)]
                        yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(r["net"], net), len(i)), *(pa.array(x.astype(t)) for x, t in zip(columns, types, strict=True))], names=["network_id", "i", "j", *of])

    return _stripes(vertices, edges).mapInArrow(rows, f"network_id {kind}, i int, j int, " + ", ".join(f"{c} {kinds[c]}" for c in of))


def all_path_edges(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """path_edges() of all shortest_paths(), worked out by stripes.

    The edge that a path begins with follows from the vias of its own start. Read from the other end it is a path's last,
    so that these cells change sides (a shuffle of tiles); then all paths from a vertex unroll from their ends. A cell is
    the edge's place among those of its vertex, of as few bits as tell these apart by how often they occur.
    """
    (v, e), rest = _parted(vertices, edges)
    kind, net = edges.schema["network_id"].dataType.simpleString(), to_arrow_type(edges.schema["network_id"].dataType)
    number = to_arrow_type(edges.schema["index"].dataType)
    wanted = pa.schema([("network_id", net), *((c, pa.int32()) for c in ("part", "block", "col", "size", "last")), ("cells", pa.binary()), *((c, pa.binary()) for c in _NET)])

    def turned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                head = {"network_id": r["net"], "part": r["part"], "block": -1}
                yield pa.RecordBatch.from_pylist([r | head], schema=wanted)
                for stripe in _stripes_of(r):
                    places = stripe.places(stripe.hops(stripe.grown()))
                    tiles = [{"network_id": r["net"], "part": b // TOGETHER, "block": b, "col": stripe.block, "size": r["size"], "cells": _coded(places[:, k : k + r["size"]])} for b, k in enumerate(range(0, places.shape[1], r["size"]))]
                    yield pa.RecordBatch.from_pylist(tiles, schema=wanted)

    def unrolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, tiles = {}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] < 0:
                    stripes = {s.block: s for s in _stripes_of(r)}
                    continue
                tiles.append(r["cells"])
                stripe = stripes[r["block"]]
                n = len(stripe.vertex)
                if len(tiles) * r["size"] < n:
                    continue
                last = stripe.edges_at(tiles)
                tiles = []
                for k in range(0, len(last), step := max(1, SENT // n)):
                    yield from _unrolled(stripe, k, last[k : k + step], pa.scalar(r["network_id"], net), number)

    fields = ", ".join(["part int, block int, col int, size int, last int, cells binary", *(f"{c} binary" for c in _NET)])
    tiles = _stripes(v, e).mapInArrow(turned, f"network_id {kind}, {fields}")
    # A part's own row first, then the tiles of its stripes, stripe by stripe.
    tiles = blocks.spread(tiles, "network_id", "part").sortWithinPartitions("network_id", "part", "block", "col")
    found = tiles.mapInArrow(unrolled, f"network_id {kind}, i int, j int, step int, vertex int, edge {edges.schema['index'].dataType.simpleString()}")
    return _all(found, rest, lambda v, e: path_edges(save(_by_tiles(v, e), "paths"), e))


def _coded(cells: np.ndarray) -> bytes:
    """Only the number of bits follows from the values: there is nothing to be found in their order."""
    c = zlib.compressobj(1, zlib.DEFLATED, -15, 8, zlib.Z_HUFFMAN_ONLY)
    return c.compress(np.ascontiguousarray(cells)) + c.flush()


def _unrolled(stripe: _Stripe, k: int, last: np.ndarray, name: pa.Scalar, number: pa.DataType) -> Iterator[pa.RecordBatch]:
    """last: the last edge of each path from some vertices, k the place of the first of them."""
    i, j = np.nonzero(last >= 0)
    if not len(i):
        return
    start, hops, at = stripe.first + k + i, np.zeros(len(i), dtype=np.int32), j
    before = np.where(last >= 0, stripe.source[np.maximum(last, 0)], np.arange(last.shape[1]))
    while (on := at != start).any():
        hops += on
        at = before[i, at]
        if hops.max(initial=0) > len(stripe.vertex):
            raise RuntimeError("A path has no end.")
    at, back = j, 0
    while len(i):
        edge = last[i, at]
        columns = (stripe.vertex[start], stripe.vertex[j], hops - 1 - back, stripe.vertex[at])
        yield pa.RecordBatch.from_arrays([pa.repeat(name, len(i)), *(pa.array(x.astype(np.int32)) for x in columns), pa.array(stripe.edge[edge], number)], names=["network_id", "i", "j", "step", "vertex", "edge"])
        at, back = stripe.source[edge], back + 1
        on = at != start
        i, j, start, hops, at = (x[on] for x in (i, j, start, hops, at))


def _over(haplotypes: DataFrame, edges: DataFrame, kind: str, cells: bool) -> DataFrame:
    """A row a stripe: (network_id, net, block, n_pairs, total, values, counts, index, first, cells): by how much paths are
    longer than distances, for pairs i > j of the stripe's i. values, counts: how often each excess occurs; cells: all of
    them, as bytes, if asked for. The network's sequences are at hand as its edges are."""
    kind_, net = edges.schema["network_id"].dataType.simpleString(), to_arrow_type(edges.schema["network_id"].dataType)
    rows = blocks.stacked(haplotypes, kind, 1 << 30).select("network_id", "n", "codes", "weights")
    stripes = blocks.spread(_stripes(haplotypes, edges).join(rows, "network_id"), "network_id", "part")
    wanted = pa.schema([("network_id", net), ("block", pa.int32()), ("n_pairs", pa.int64()), ("total", pa.int64()), ("values", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("index", pa.binary()), ("first", pa.int64()), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                weights = np.frombuffer(r["weights"], dtype=np.int64)
                lines = blocks.lines(r["n"], r["codes"], len(weights))
                for stripe in _stripes_of(r):
                    found = stripe.grown()
                    counts = (found < _FAR) & (np.arange(r["n"]) < stripe.first + stripe.own[:, None])
                    over = np.where(counts, (found >> 32) - blocks.apart(lines[stripe.first + stripe.own], lines, weights), 0)
                    if (over < 0).any():
                        raise RuntimeError("Path length is shorter than allowed.")
                    values, often = np.unique(over[over > 0], return_counts=True)
                    small = over.astype(np.min_scalar_type(int(over.max(initial=0)))).tobytes() if cells else b""
                    yield pa.RecordBatch.from_pylist([{"network_id": r["net"], "block": stripe.block, "n_pairs": int(counts.sum()), "total": int(over.sum()), "values": values.tolist(), "counts": often.tolist(), "index": stripe.vertex.tobytes() if cells else b"", "first": stripe.first, "cells": small}], schema=wanted)

    return stripes.mapInArrow(run, f"network_id {kind_}, block int, n_pairs long, total long, values array<bigint>, counts array<bigint>, index binary, first long, cells binary")


def _plain(haplotypes: DataFrame, edges: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    d = blocks.distances(blocks.stacked(haplotypes, kind))
    return _by_tiles(haplotypes.select("network_id", "index"), edges), d


def total_excess(haplotypes: DataFrame, edges: DataFrame, kind: str = "dna") -> DataFrame:
    """(network_id, excess): graph.total_excess() of haplotypes(network_id, index, seq) and the network between them."""
    (h, e), rest = _parted(haplotypes, edges)
    found = _over(h, e, kind, False).where("n_pairs > 0").groupBy("network_id").agg(F.sum("total").cast("double").alias("excess"))
    return _all(found, rest, lambda h, e: graph.total_excess(*_plain(h, e, kind)))


def excess_pairs(haplotypes: DataFrame, edges: DataFrame, kind: str = "dna") -> DataFrame:
    """(network_id, i, j, excess, place): graph.excess_pairs() of haplotypes(network_id, index, seq) and the network between them.

    A pair's place is what has a smaller excess, what has the same in stripes before, and its place in its own: only counts
    are put in order, no pairs.
    """
    (h, e), rest = _parted(haplotypes, edges)
    kind_, net = edges.schema["network_id"].dataType.simpleString(), to_arrow_type(edges.schema["network_id"].dataType)
    stripes = save(_over(h, e, kind, True), "excess")
    each = stripes.select("network_id", "block", F.explode(F.arrays_zip("values", "counts")).alias("c")).select("network_id", "block", "c.*")
    before = F.coalesce(F.sum("counts").over(Window.partitionBy("network_id").orderBy("values", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = each.withColumn("before", before).groupBy("network_id", "block").agg(F.sort_array(F.collect_list(F.struct("values", "before"))).alias("places"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                vertex = np.frombuffer(r["index"], dtype=np.int64)
                top = np.min_scalar_type(r["places"][-1]["values"])
                over = np.frombuffer(r["cells"], dtype=top).reshape(-1, len(vertex))
                for p in r["places"]:
                    i, j = np.nonzero(over == p["values"])
                    place = p["before"] + np.arange(len(i))
                    yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(r["net"], net), len(i)), pa.array(vertex[r["first"] + i].astype(np.int32)), pa.array(vertex[j].astype(np.int32)), pa.array(np.full(len(i), float(p["values"]))), pa.array(place.astype(np.int32))], names=["network_id", "i", "j", "excess", "place"])

    joined = stripes.select("network_id", "block", "index", "first", "cells").join(places, ["network_id", "block"]).withColumn("net", F.col("network_id"))
    found = blocks.spread(joined, "network_id", "block").mapInArrow(rows, f"network_id {kind_}, i int, j int, excess double, place int")
    return _all(found, rest, lambda h, e: graph.excess_pairs(*_plain(h, e, kind)))
