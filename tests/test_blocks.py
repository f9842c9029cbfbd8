"""All pairs by blocks: spanning networks, distances, paths and what is too long in them, against plain ways."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave import shared
from haploweave.operators import alignment as A
from haploweave.operators import blocks, near, paths
from haploweave.operators import graph as G
from haploweave.plans.msn import spanning_links


def scattered(rng, n, sites, states="ACGT"):
    return ["".join(rng.choice(states) for _ in range(sites)) for _ in range(n)]


def differ(x, y):
    return sum(a != b and a not in "-N?" and b not in "-N?" for a, b in zip(x, y, strict=True))


def sequences(spark, nets):
    return spark.createDataFrame([(n, i, q) for n, v in nets.items() for i, q in enumerate(v)], "network_id string, index int, seq string")


@pytest.mark.parametrize("epsilon", [0, 2])
def test_spanning_network_far_apart(spark, epsilon):
    """Sequences that have nothing in common, over several blocks: a few rounds, not a search for each distance."""
    rng = random.Random(8)
    nets = {"a": scattered(rng, 50, 64, "ACGTN"), "b": scattered(rng, 17, 64)}
    want = sorted((n, i, j, d) for n, v in nets.items() for i, j, d in spanning_links(np.array([[differ(x, y) for y in v] for x in v]), epsilon))
    assert sorted(map(tuple, blocks.links(sequences(spark, nets), epsilon, block=16).collect())) == want
    before = len(shared._given)
    assert near.spanning_network(sequences(spark, nets), epsilon).count() == len(want)
    assert len(shared._given) - before < 12


def test_distances_are_products(spark):
    """Weights, unknown and lower-case states, more blocks than one; no state is looked at pair by pair in the plan."""
    rng = random.Random(9)
    seqs = scattered(rng, 23, 9, "ACGTNn-a")
    weights = [rng.randint(1, 5) for _ in range(9)]
    table = spark.createDataFrame([("n", i, q, weights) for i, q in enumerate(seqs)], "network_id string, hap_idx int, pattern_seq string, weights array<long>")
    unknown = "-?NYRMSVWKDHB" + "nyrmsvwkdhb"
    want = sorted(("n", i, j, sum(w for a, b, w in zip(seqs[i], seqs[j], weights, strict=True) if a != b and a not in unknown and b not in unknown)) for i in range(23) for j in range(i))
    found = A.distances(table, block=8)
    assert sorted(map(tuple, found.collect())) == want
    assert "zip_with" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("threshold", [2, 3, 9])
def test_components_within(spark, threshold):
    """As by all pairs, by the index and by blocks; pairs that are not near aren't made."""
    rng = random.Random(threshold)
    nets = {"a": sorted(set(scattered(rng, 40, 12, "01"))), "b": ["000000000000"], "c": ["000000000000", "111111111111"]}
    want = {}
    for n, v in nets.items():
        up = list(range(len(v)))
        for i in range(len(v)):
            for j in range(i):
                if differ(v[i], v[j]) < threshold:
                    up = [min(up[i], up[j]) if x in (up[i], up[j]) else x for x in up]
        want |= {(n, i): x for i, x in enumerate(up)}
    found = near.components_within(sequences(spark, nets), threshold, "binary")
    assert {(r.network_id, r["index"]): r.component for r in found.collect()} == want


def graph_of(spark, nets):
    v = spark.createDataFrame([(n, i) for n, (k, _) in nets.items() for i in range(k)], "network_id string, index int")
    e = spark.createDataFrame([(n, k, *x) for n, (_, edges) in nets.items() for k, x in enumerate(edges)], "network_id string, index int, from int, to int, weight int")
    return v, e


def grids(rng):
    """More vertices than a stripe has; parallel and weightless edges, loops, parts, a vertex alone, ties all over."""
    some = [(i, rng.randrange(i), rng.randint(0, 3)) for i in range(1, 280)] + [(rng.randrange(280), rng.randrange(280), rng.randint(0, 5)) for _ in range(260)]
    return {"a": (300, some + [(290, 291, 2), (291, 292, 1)]), "b": (1, []), "c": (9, [(i, i + 1, 1) for i in range(8)])}


def test_paths_by_stripes(spark):
    """The same lengths, vias and paths as by tiles; no tile is shuffled for lengths."""
    v, e = graph_of(spark, grids(random.Random(3)))
    tiles, found = paths.shortest_paths(v, e, tile=64).cache(), paths.shortest_paths(v, e)
    assert sorted(map(tuple, found.select(tiles.columns).collect())) == sorted(map(tuple, tiles.collect()))
    assert "lengths" not in found._jdf.queryExecution().toString()
    half = paths.shortest_paths(v, e.withColumn("weight", F.col("weight") + 0.5))
    assert half.where("network_id = 'c' and i = 0 and j = 8").first().length == 12
    plain, steps = paths.path_edges(tiles, e), paths.all_path_edges(v, e)
    assert sorted(map(tuple, steps.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))


def test_paths_take_little_disk(spark):
    """Tiles of last edges, and their network's edges beside them, take less than a byte of the shuffle for each pair."""
    rng = random.Random(5)
    n = 900
    v, e = graph_of(spark, {"a": (n, [(i, rng.randrange(max(0, i - 99), i), rng.randint(1, 3)) for i in range(1, n) for _ in range(3)])})
    folders = list(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    held = lambda: sum(os.path.getsize(os.path.join(d, f)) for x in folders for d, _, names in os.walk(x.getPath()) for f in names)
    v, e = shared.save(v, "vertices"), shared.save(e, "edges")
    before = held()
    assert paths.all_path_edges(v, e).where("step = 0").count() == n * (n - 1)
    assert 0 < held() - before < n * n


def test_paths_by_parts_of_stripes(spark, monkeypatch):
    """More stripes than go together, vertices of over 255 edges, and networks that share a task."""
    rng = random.Random(6)
    monkeypatch.setattr(paths, "CELLS", 16 * 300)
    wheel = [(0, k, rng.randint(1, 3)) for k in range(1, 300)] + [(k, k + 1, rng.randint(0, 3)) for k in range(1, 299)]
    v, e = graph_of(spark, {"wheel": (300, wheel), "b": (1, []), "c": (70, [(i, i // 2, 1) for i in range(1, 70)]), "d": (40, [(i, i + 1, 1) for i in range(20)])})
    plain, steps = paths.path_edges(paths.shortest_paths(v, e, tile=64), e), paths.all_path_edges(v, e)
    assert sorted(map(tuple, steps.select(plain.columns).collect())) == sorted(map(tuple, plain.collect()))
    assert "collect_list" not in (plan := steps._jdf.queryExecution().toString()) and "Join" not in plan.split("== Optimized Logical Plan ==")[0]


def test_excess_by_stripes(spark):
    """As by joins of all paths and distances, places included; more sequences than a stripe has; no pair is sorted."""
    rng = random.Random(4)
    nets = {"a": sorted(set(scattered(rng, 290, 10, "01"))), "b": ["01", "10"], "c": ["0"]}
    table = sequences(spark, nets)
    links = {n: [(i, rng.randrange(i), 0) for i in range(1, len(v))] for n, v in nets.items()}
    e = graph_of(spark, {n: (0, [(i, j, differ(nets[n][i], nets[n][j])) for i, j, _ in x]) for n, x in links.items()})[1]
    d = blocks.distances(blocks.stacked(table, "binary"))
    found = paths.shortest_paths(table, e).cache()
    pairs = paths.excess_pairs(table, e, "binary")
    assert sorted(map(tuple, pairs.collect())) == sorted(map(tuple, G.excess_pairs(found, d).select(pairs.columns).collect()))
    assert sorted(map(tuple, paths.total_excess(table, e, "binary").collect())) == sorted(map(tuple, G.total_excess(found, d).collect()))
    with pytest.raises(Exception, match="shorter than allowed"):
        paths.total_excess(table, e.withColumn("weight", F.lit(0)), "binary").collect()


def test_vias_by_stripes(spark):
    """Of the shortest paths' highest vertices the lowest, by stripes: no tile is shuffled."""
    v, e = graph_of(spark, {"a": (6, [(0, 5, 1), (5, 1, 1), (0, 2, 1), (2, 1, 1), (1, 4, 2), (0, 4, 4)])})
    found = paths.shortest_paths(v, e)
    assert {(r.i, r.j): r.via for r in found.where("i = 0").collect()} == {(0, 0): -1, (0, 1): 2, (0, 2): -1, (0, 4): -1, (0, 5): -1}
    assert "vias binary" not in found._jdf.queryExecution().toString() and "lengths" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("heaviest", [3, 6_000_000, 1 << 28])
def test_stripes_in_narrow_cells(monkeypatch, heaviest):
    """As by the triple loop, in 32 bits where lengths fit and in 64 where a weight or only a length doesn't; vertices of many
    edges are taken in parts; an unconnected vertex stays so."""
    rng = np.random.default_rng(heaviest)
    n = 40
    pairs = [(0, k) for k in range(1, n - 1)] + [(k, k + 1) for k in range(n - 2)] + [tuple(x) for x in rng.integers(1, n - 1, (60, 2)) if x[0] != x[1]]
    edges = {(int(a), int(b)): int(w) for (a, b), w in zip(pairs, rng.integers(heaviest // 2 if heaviest > 3 else 0, heaviest + 1, len(pairs)), strict=True)}
    edges |= {(b, a): w for (a, b), w in edges.items()}
    length, via = np.full((n, n), np.inf), np.full((n, n), -1)
    np.fill_diagonal(length, 0)
    for x, w in edges.items():
        length[x] = w
    for k in range(n):
        way = length[:, k, None] + length[None, k, :]
        via[way < length] = k
        length = np.minimum(length, way)
    rows = sorted((b, a, w) for (a, b), w in edges.items())
    target, source, weight = (np.array(x, dtype=np.int64).tobytes() for x in zip(*rows, strict=True))
    one = {"vertex": np.arange(n).tobytes(), "source": source, "target": target, "weight": weight, "edge": np.arange(len(rows)).tobytes(), "size": 16, "block": 1}
    for at_once in (16 * 5, 1 << 16):
        monkeypatch.setattr(paths, "CELLS_AT_ONCE", at_once)
        stripe = paths._Stripe(one)
        assert (stripe._cells(np.int32, 6, 30) is None) == (heaviest > 3)
        found = stripe.grown()
        known = found < paths._FAR
        assert (known == np.isfinite(length[16:32])).all()
        assert ((found >> 32)[known] == length[16:32][known]).all() and ((found & paths._VIA)[known] - 1 == via[16:32][known]).all()


def test_paths_send_what_is_asked_for(spark):
    """Neither lengths nor vias are sent where the other is asked for."""
    v, e = graph_of(spark, {"a": (4, [(0, 1, 1), (1, 2, 1), (0, 2, 5)])})
    found = {c: paths.shortest_paths(v, e, of=(c,)) for c in ("length", "via")}
    assert "length" not in found["via"]._jdf.queryExecution().toString() and "via" not in found["length"]._jdf.queryExecution().toString()
    whole = paths.shortest_paths(v, e)
    for c, d in found.items():
        assert sorted(map(tuple, d.collect())) == sorted(map(tuple, whole.select(d.columns).collect()))
        assert d.columns == paths.shortest_paths(v, e, tile=64, of=(c,)).columns
