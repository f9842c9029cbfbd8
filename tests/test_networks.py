"""Networks against golden edge lists (if a folder of them is named) and against literal definitions."""

import glob
import os
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from haploweave.plans import build, ilp
from haploweave.plans.intnj import _joining_tree, _path_rows, intnj
from haploweave.plans.mjn import mjn, pruned, quasi_medians, triplets
from haploweave.plans.model import haplotypes_of, keep_sites
from haploweave.plans.msn import msn, spanning_links
from haploweave.plans.network import Graph, Haplotypes, NetworkError
from haploweave.plans.tcs import tcs
from haploweave.sources.nexus import parse

#: A folder of *.nex files with expected/<name>_<algorithm>.txt beside them: from label, weight, to label, in edge order.
GOLDEN = os.environ.get("GOLDEN_NETWORKS", "")
BUILD = {"MSN": msn, "MJN": mjn, "TCS": tcs, "IntNJ": intnj}


def haps(*seqs, kind="dna", weights=None):
    return Haplotypes([f"h{i}" for i in range(len(seqs))], list(seqs), weights or [1] * len(seqs[0]), kind)


def golden():
    found = sorted(glob.glob(f"{GOLDEN}/expected/*_*.txt")) if GOLDEN else []
    return [(f"{GOLDEN}/{name}.nex", a, path) for path in found for name, _, a in [os.path.basename(path)[:-4].rpartition("_")] if a in BUILD]


@pytest.mark.parametrize(("source", "algorithm", "wanted"), golden() or [pytest.param("", "", "", marks=pytest.mark.skip(reason="GOLDEN_NETWORKS isn't set"))])
def test_golden(source, algorithm, wanted):
    with open(source) as f:
        h = haplotypes_of(parse(f.read()))
    if algorithm == "IntNJ" and len(h) > 100:
        pytest.skip("the integer program has many optima")
    with open(wanted) as f:
        lines = [x.rstrip("\n") for x in f if x.strip()]
    assert [f"{a}\t{w:g}\t{b}" for a, w, b in BUILD[algorithm](h).edge_list()] == lines


def test_known_networks():
    """Worked out by hand: three haplotypes two steps apart meet in one median; a line of four stays a line."""
    star, line = haps("AAT", "ATA", "TAA"), haps("AAAA", "AAAC", "AACC", "ACCC")
    assert mjn(star).edge_list() == [("3", 1, "h0"), ("3", 1, "h1"), ("3", 1, "h2")]
    assert msn(star).edge_list() == [("h1", 2, "h0"), ("h2", 2, "h0"), ("h2", 2, "h1")]
    for build in (msn, mjn):
        assert build(line).edge_list() == [("h1", 1, "h0"), ("h2", 1, "h1"), ("h3", 1, "h2")]
    assert tcs(line).edge_list() == [("h0", 1, "h1"), ("h1", 1, "h2"), ("h2", 1, "h3")]
    assert sorted(sorted((a, b)) for a, _, b in intnj(line).edge_list()) == [["h0", "h1"], ["h1", "h2"], ["h2", "h3"]]


def literal_spanning(d, eps):
    """Pair by pair: is there a path of links shorter than the pair's less eps?"""
    n = len(d)

    def joined(limit, strict, i, j):
        seen, todo = {i}, [i]
        while todo:
            x = todo.pop()
            for y in range(n):
                if y not in seen and (d[x][y] < limit if strict else d[x][y] <= limit):
                    seen.add(y)
                    todo.append(y)
        return j in seen

    top = next(t for t in sorted({d[i][j] for i in range(n) for j in range(i)}) if all(joined(t, False, 0, j) for j in range(n)))
    pairs = sorted((d[i][j], i, j) for i in range(n) for j in range(i))
    return [(i, j, t) for t, i, j in pairs if t <= top + eps and not joined(t - eps, True, i, j)]


@pytest.mark.parametrize("eps", [0, 1, 2])
def test_spanning_random(eps):
    rng = np.random.default_rng(eps)
    for _ in range(30):
        n = int(rng.integers(2, 9))
        d = np.triu(rng.integers(1, 8, (n, n)), 1)
        d = d + d.T
        assert spanning_links(d, eps) == literal_spanning(d.tolist(), eps)
    assert spanning_links(d, -1) == []


@pytest.mark.parametrize("build", [mjn, tcs, intnj])
def test_inferred_vertex(build):
    g = build(haps("AACC", "ACAC", "ACCA"))
    assert any(v.origin is None for v in g.vertices)
    assert [v.label for v in g.vertices if v.origin is None] == [str(v.index) for v in g.vertices if v.origin is None]


@pytest.mark.parametrize("build", [msn, mjn, tcs, intnj])
def test_one_and_two(build):
    assert build(haps("A")).edge_list() == []
    assert build(haps("AA", "AC")).edge_list() in ([("h1", 1, "h0")], [("h0", 1, "h1")])


def test_zero_distance_is_one_step_in_tcs():
    h = haps("AN", "AC", "GC")
    assert h.d[0, 1] == 0
    assert ("h0", 1, "h1") in tcs(h).edge_list()


def test_graph_guards_and_paths():
    g, other = Graph(), Graph()
    a, b, c = (g.add() for _ in range(3))
    heavy, light, last = g.link(a, b, 3), g.link(a, b, 1), g.link(b, c, 2)
    far = other.add()
    assert g.path_edges(a, c) == [light, last] and g.path_edges(a, a) == [] and last.other(c) is b
    assert g.vertex(2) is c and g.edge(0) is heavy
    for wrong in (lambda: last.other(a), lambda: last.other(far), lambda: g.vertex(3), lambda: g.edge(-1), lambda: g.link(a, far), lambda: g.relink(last, a, far), lambda: g.drop(far)):
        with pytest.raises(NetworkError):
            wrong()
    g.unlink(heavy)
    with pytest.raises(NetworkError):
        g.unlink(heavy)
    assert (light.index, last.index) == (0, 1)


def test_protein_and_lengths():
    with pytest.raises(NetworkError):
        haps("AA", "AC", kind="aa")
    with pytest.raises(NetworkError):
        Haplotypes(["a"], ["AC"], [1])


def test_medians_and_triplets():
    assert quasi_medians("AAC", "AGC", "ATC") == ["AAC", "AGC", "ATC"]
    assert quasi_medians("AA", "AC", "GC") == ["AC"]
    assert triplets([(1, 0, 1), (2, 1, 1), (3, 2, 1)]) == [(2, 1, 0), (3, 2, 1)]
    seqs, links, any_ = pruned(["a", "b", "c", "d"], [(2, 0, 1), (3, 2, 1)], 2)
    assert (seqs, links, any_) == (["a", "b"], [], True)


def test_intnj_paths_meet_distances():
    random.seed(5)
    seqs = list({"".join(random.choice("ACGT") for _ in range(8)) for _ in range(9)})
    h = haps(*seqs)
    for alpha in (0, 0.5, 1):
        d = intnj(h, alpha).paths()[: len(h), : len(h)]
        assert (d >= h.d).all()


def test_integer_lengths_star():
    paths = np.array([[1, 1, 0], [1, 0, 1], [0, 1, 1]], dtype=bool)
    assert ilp.least_lengths(paths, np.array([1, 1, 1])).tolist() == [1, 1, 0]


def test_integer_lengths_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(20):
        m, k = 4, 5
        paths = rng.random((k, m)) < 0.5
        paths[paths.sum(1) == 0, 0] = True
        need = rng.integers(0, 4, k)
        cost = 10**6 + np.arange(m)
        grid = np.stack(np.meshgrid(*[np.arange(4)] * m), -1).reshape(-1, m)
        ok = grid[(grid @ paths.T >= need).all(1)]
        assert ilp.least_lengths(paths, need) @ cost == (ok @ cost).min()


def test_integer_lengths_price_few_paths(monkeypatch):
    """All paths are priced now and then, not at each pivot; the least sum is that of pricing all each time."""
    rng = random.Random(6)
    h = haps(*sorted({"".join(rng.choice("01") for _ in range(7)) for _ in range(90)}), kind="binary")
    rows, i, j = _path_rows(_joining_tree(h), len(h))
    cost = 10**6 + np.arange(rows.shape[1])
    calls = {"prices": 0, "short": 0}
    for name in calls:
        monkeypatch.setattr(ilp._Dual, name, lambda self, *a, f=getattr(ilp._Dual, name), name=name: calls.update({name: calls[name] + 1}) or f(self, *a))
    found = []
    for held in (len(rows), ilp.HELD, 3):
        monkeypatch.setattr(ilp, "HELD", held)
        calls.update(prices=0, short=0)
        lengths = ilp.least_lengths(rows, h.d[i, j])
        assert (rows @ lengths >= h.d[i, j]).all()
        found.append(int(cost @ lengths))
        if held == 256:
            assert 5 * calls["short"] < calls["prices"]
    assert len(set(found)) == 1


def test_networks_are_dealt_out(spark):
    """Small networks aren't put together in one task, however few bytes they have."""
    table = spark.createDataFrame([(str(n), i, f"h{i}", q, [1, 1, 1]) for n in range(8) for i, q in enumerate(("000", "011", "101"))], "network_id string, hap_idx int, name string, pattern_seq string, weights array<long>")
    found = build.elements(table, "IntNJ", kind="binary").withColumn("task", F.spark_partition_id())
    assert found.select("task").distinct().count() > 3


def test_mask_threshold():
    assert keep_sites(["A" * 19 + "N", "A" * 20]) == [True] * 20  # exactly 5 %
    assert keep_sites(["A" * 18 + "N", "A" * 19]) == [True] * 18 + [False]
    assert keep_sites([]) == []
    with pytest.raises(NetworkError):
        keep_sites(["A", "AC"])


def test_paths():
    from haploweave.plans.network import Graph

    g = Graph()
    a, b, c, d, e = (g.add(x) for x in "abcde")
    for x, y, w in ((a, b, 1), (b, c, 1), (a, c, 5), (c, d, 1)):
        g.link(x, y, w)
    assert [v.label for v in g.path(a, d)] == ["a", "b", "c", "d"] and g.path(a, e) == [] and g.path(a, a) == [a, a]
    assert g.paths()[0, 3] == 3 and np.isinf(g.paths()[0, 4])
    g.drop(b)
    assert [(x.label, w, y) for x, w, y in ((e.a, e.weight, e.b.label) for e in g.edges)] == [("a", 5, "c"), ("c", 1, "d")] and c.index == 1
