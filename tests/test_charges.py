"""Charges by cells against all pairs; layouts in rounds."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave.operators import charges as C
from haploweave.plans.layout import Forces

PLACED = "network_id string, index int, x double, y double, radius double"


def places(kind, n, rng):
    if kind == "even":
        return rng.random((n, 2)) * 1000 * max(1, n**0.5 / 20)
    if kind == "dense":  # all within each other's reach, many capped
        return rng.random((n, 2)) * 30
    if kind == "clusters":  # a third of all on a small spot, some far off
        p = rng.random((n, 2)) * 2000
        p[: n // 3] = 500 + rng.normal(size=(n // 3, 2))
        p[-3:] += 1e5
        return p
    return np.stack([np.linspace(0, 5000, n), np.zeros(n)], 1)


def exact(p, sizes):
    """Forces of all pairs, by the kernel of one network."""
    forces = Forces(sizes, [], np.random.default_rng(0))
    forces.apart = lambda p: p.copy()
    return forces(p)[1]


@pytest.mark.parametrize("kind", ["even", "dense", "clusters", "line"])
def test_charges_against_all_pairs(spark, kind):
    rng = np.random.default_rng(5)
    sizes, rows, wanted = {}, [], {}
    for net, n in (("a", 700), ("b", 90), ("c", 1), ("d", 2)):
        p, s = places(kind, n, rng), rng.choice([4 / 9, 1, 1, 2, 9], n)
        sizes[net], wanted[net] = 7.5 * np.sqrt(s), exact(p, s)
        rows += [(net, i, *map(float, p[i]), float(sizes[net][i])) for i in range(n)]
    found = C.charges(spark.createDataFrame(rows, PLACED).repartition(5), leaf=8).toPandas()
    assert len(found) == len(rows)
    for net, part in found.groupby("network_id"):
        part, n = part.sort_values("index"), len(wanted[net])
        assert part["n_met"].tolist() == [n - 1] * n
        assert np.allclose(part["radii_met"], sizes[net].sum() - sizes[net])
        off = part[["fx", "fy"]].to_numpy() - wanted[net]
        scale = np.sqrt((wanted[net] ** 2).sum(1).mean())
        assert np.sqrt((off**2).sum(1).mean()) <= 0.003 * scale + 1e-12
        assert np.sqrt((off**2).sum(1).max()) <= 0.03 * scale + 1e-12


@pytest.mark.parametrize(("kind", "laws"), [("even", {0, C.FAR}), ("dense", {0, C.WITHIN}), ("clusters", {0, C.FAR, C.WITHIN, C.CAPPED})])
def test_laws_of_cells(spark, kind, laws):
    p = places(kind, 700, np.random.default_rng(5))
    v = spark.createDataFrame([("a", i, *map(float, p[i]), 7.5) for i in range(700)], PLACED)
    rounds, _ = C._meetings(C._cells(C._gridded(v, 8)), 2, 8)
    kinds = [r["kind"] for part in rounds for r in part.select("kind").distinct().collect()]
    assert laws <= set(kinds)


def test_charges_of_odd_places(spark):
    rows = [("n", 0, 1.0, 1.0, 5.0), ("n", 1, 1.0, 1.0, 5.0), ("n", 2, None, 1.0, 5.0), ("n", 3, float("nan"), 1.0, 5.0), ("n", 4, 1.0, float("inf"), 5.0), ("n", 5, 1.0, 2.0, None)]
    found = {r["index"]: (r.fx, r.fy, r.n_met) for r in C.charges(spark.createDataFrame(rows, PLACED)).collect()}
    assert found == {0: (0.0, 0.0, 1), 1: (0.0, 0.0, 1)}
    assert C.charges(spark.createDataFrame([], PLACED)).count() == 0


def test_springs(spark):
    p, sizes = np.random.default_rng(1).random((30, 2)) * 300, np.ones(30)
    edges = [(i, (i * 7 + 1) % 30, float(i % 4)) for i in range(30)] + [(3, 3, 1.0), (2, 5, None)]
    v = spark.createDataFrame([("n", i, *map(float, p[i]), 7.5) for i in range(30)], PLACED)
    e = spark.createDataFrame([("n", *x) for x in edges], "network_id string, `from` int, `to` int, weight double")
    found = C.springs(v, e).toPandas().sort_values("index")
    forces = Forces(sizes, edges, np.random.default_rng(0))
    wanted = forces(p)[1] - exact(p, sizes)
    assert np.allclose(found[["fx", "fy"]].to_numpy(), wanted[found["index"]])


def test_relax(spark):
    v = spark.range(40).select(F.lit("n").alias("network_id"), F.col("id").cast("int").alias("index"), F.lit(7.5).alias("radius"))
    e = spark.range(39).select(F.lit("n").alias("network_id"), F.col("id").cast("int").alias("from"), (F.col("id") + 1).cast("int").alias("to"), F.lit(1.0).alias("weight"))
    out = C.relax(v, e, rounds=6).toPandas().sort_values("index")
    again = C.relax(v.repartition(7), e, rounds=6).toPandas().sort_values("index")
    p = out[["x", "y"]].to_numpy()
    assert len(p) == 40 and np.isfinite(p).all() and np.allclose(p, again[["x", "y"]].to_numpy())
    assert np.allclose((p.min(0) + p.max(0)) / 2, 500)
    gaps = np.sqrt(((p[1:] - p[:-1]) ** 2).sum(1))
    assert np.median(gaps) < 200  # neighbours on the chain are near each other; at the start half were 500 apart
    assert len(np.unique(np.round(p, 3), axis=0)) == 40
