"""Neighbour-joining trees by rounds over all networks, against a kernel of one network."""

import random

import numpy as np
import pytest

from haploweave.operators.joining import joining_trees
from haploweave.plans.intnj import _joining_tree
from haploweave.plans.network import Haplotypes


def _trees(spark, networks: dict[str, np.ndarray], slices: int = 5):
    vertices = spark.createDataFrame([(net, i) for net, d in networks.items() for i in range(len(d))], "network_id string, index int").repartition(slices)
    pairs = [(net, i, j, float(d[i, j])) for net, d in networks.items() for i in range(len(d)) for j in range(i)]
    random.Random(slices).shuffle(pairs)
    distances = spark.createDataFrame(pairs, "network_id string, i int, j int, d double").repartition(slices)
    found: dict[str, list] = {net: [] for net in networks}
    for r in joining_trees(vertices, distances).collect():
        found[r.network_id].append((r["index"], r["from"], r["to"], r.weight))
    return {net: sorted(rows) for net, rows in found.items()}


def _sequences(n: int, sites: int, seed: int) -> list[str]:
    r = random.Random(seed)
    return ["".join(x) for x in sorted({tuple(r.choice("01") for _ in range(sites)) for _ in range(n)}, key=lambda _: r.random())]


def test_branches_are_the_kernels(spark):
    """Few sites: most criteria tie. Distances, hence sums, stay exact only in the first round."""
    sets = {f"{n}-{sites}": _sequences(n, sites, n) for n, sites in ((1, 4), (2, 9), (3, 9), (4, 6), (9, 4), (17, 8), (24, 40))}
    haps = {net: Haplotypes([str(i) for i in range(len(s))], s, [1] * len(s[0]), "binary") for net, s in sets.items()}
    found = _trees(spark, {net: h.d.astype(float) for net, h in haps.items()})
    for net, h in haps.items():
        g = _joining_tree(h)
        assert found[net] == [(e.index, e.a.index, e.b.index, float(e.weight)) for e in g.edges], net
    assert found["1-4"] == [] and len(found["24-40"]) == 2 * len(sets["24-40"]) - 3


def test_additive_distances_give_their_tree(spark):
    """Lengths in a tree are met again along the branches, for any spread of the rows."""
    r = random.Random(3)
    n = 12
    links = [(k, r.randrange(k), float(r.randint(1, 9))) for k in range(1, n)]
    d = np.full((n, n), np.inf)
    np.fill_diagonal(d, 0)
    for a, b, w in links:
        d[a, b] = d[b, a] = w
    for k in range(n):
        d = np.minimum(d, d[:, k, None] + d[None, k])
    one, two = (_trees(spark, {"t": d}, slices)["t"] for slices in (1, 7))
    assert one == two
    size = 2 * n - 2
    along = np.full((size, size), np.inf)
    np.fill_diagonal(along, 0)
    for _, a, b, w in one:
        along[a, b] = along[b, a] = w
    for k in range(size):
        along = np.minimum(along, along[:, k, None] + along[None, k])
    assert np.allclose(along[:n, :n], d)


def test_no_networks_and_missing_pairs(spark):
    none = spark.createDataFrame([], "network_id string, index int"), spark.createDataFrame([], "network_id string, i int, j int, d double")
    assert joining_trees(*none).collect() == []
    three = spark.createDataFrame([("n", i) for i in range(3)], "network_id string, index int")
    some = spark.createDataFrame([("n", 1, 0, 1.0), ("n", 2, 0, 1.0)], "network_id string, i int, j int, d double")
    with pytest.raises(Exception, match="all its pairs"):
        joining_trees(three, some).collect()
