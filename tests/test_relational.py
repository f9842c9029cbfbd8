"""The DataFrame steps on small inputs, and all queries with SQL against it."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave.functions.palette import TABLEAU10, assigned, rgb, trait_colours, with_lightness
from haploweave.functions.states import coordinate, datatype, expand_match
from haploweave.operators import alignment as A
from haploweave.operators import graph as G
from haploweave.operators import medians, near, paths
from haploweave.plans import build, layout
from haploweave.plans.msn import spanning_links

DATA = "/root/testdata/sf0.001"


def rows(spark, *seqs, net="n"):
    return spark.createDataFrame([(net, i, chr(97 + i), s) for i, s in enumerate(seqs)], "network_id string, taxon_idx int, taxon string, seq string")


def test_condense_traits(spark):
    a = rows(spark, "ACGT", "ACGT", "ATGT")
    h = A.condense(a)
    assert [(r.hap_idx, r.name, r.originals, r.frequency) for r in h.orderBy("hap_idx").collect()] == [(0, "a", [0, 1], 2.0), (1, "c", [2], 1.0)]
    traits = spark.createDataFrame([("n", "a", 0, 1.0), ("n", "b", 0, 2.0), ("n", "b", 1, 1.0), ("n", "c", 1, 4.0), ("n", "c", 7, 9.0)], "network_id string, taxon string, trait_idx int, count double")
    labels = spark.createDataFrame([("n", 0, "x"), ("n", 1, "y")], "network_id string, trait_idx int, label string")
    out = A.with_traits(h, A.haplotype_traits(a, h, traits, labels))
    assert [(r.traits, r.frequency) for r in out.orderBy("hap_idx").collect()] == [([3.0, 1.0], 4.0), ([0.0, 4.0], 4.0)]
    s = {r.trait_idx: (r.n_sequences, r.n_samples) for r in A.trait_summary(traits).collect()}
    assert s[0] == (2, 3.0) and s[1] == (2, 5.0)


@pytest.mark.parametrize(("seqs", "weights", "d"), [(("AAAA", "CCCC"), [4], 4), (("A-R", "G-Y", "G-Y"), [1], 1)])
def test_patterns(spark, seqs, weights, d):
    h = A.condense(rows(spark, *seqs))
    c = A.condensed(h, A.site_patterns(h))
    assert c.first().weights == weights
    assert [r.d for r in A.distances(c).collect()] == [d]


def test_distances_in_blocks(spark):
    a = rows(spark, *(format(i, "08b").replace("0", "A").replace("1", "C") for i in range(1, 40)))
    h = A.condense(a)
    c = A.condensed(h, A.site_patterns(h)).cache()
    want = sorted(map(tuple, A.distances(c).collect()))
    assert len(want) == 39 * 38 // 2 and sorted(map(tuple, A.distances(c, block=7).collect())) == want
    assert all(d == ((i + 1) ^ (j + 1)).bit_count() for _, i, j, d in want)


def test_all_masked_and_lengths(spark):
    a = rows(spark, "NN", "AC")
    m = A.site_mask(a)
    assert A.masked_sites(m).first().masked == [0, 1]
    assert {r.seq for r in A.apply_mask(a, m).collect()} == {""}
    with pytest.raises(Exception, match="not the same length"):
        A.checked(rows(spark, "A", "AC")).collect()
    with pytest.raises(Exception, match="no character sequence"):
        taxa = spark.createDataFrame([("n", 0, "z")], "network_id string, taxon_idx int, taxon string")
        A.ordered_sequences(taxa, a).collect()


def graph(spark, edges, n):
    v = spark.createDataFrame([("g", i) for i in range(n)], "network_id string, index int")
    e = spark.createDataFrame([("g", k, a, b, w) for k, (a, b, w) in enumerate(edges)], "network_id string, index int, from int, to int, weight int")
    return v, e


def test_graph(spark):
    v, e = graph(spark, [(0, 1, 2), (1, 2, 3)], 4)
    lengths = {(r.i, r.j): r.length for r in paths.shortest_paths(v, e).collect()}
    assert lengths[0, 2] == 5 and (0, 3) not in lengths
    assert {r["index"]: r.component for r in G.components(v, e).collect()} == {0: 0, 1: 0, 2: 0, 3: 3}
    nv, ne = G.remove_vertices(v, e, v.where("index = 1"))
    assert nv.count() == 3 and ne.count() == 0
    assert {r["index"]: r.degree for r in G.degrees(v, e).collect()} == {0: 1, 1: 2, 2: 1, 3: 0}
    more = G.add_edges(e, spark.createDataFrame([("g", 0, 3)], "network_id string, from int, to int"))
    assert [(r["index"], r["from"], r.to, r.weight) for r in more.orderBy("index").collect()][-1] == (2, 0, 3, 1)


def test_long_path_components(spark):
    v, e = graph(spark, [(i, i + 1, 1) for i in range(40)], 41)
    assert {r.component for r in G.components(v, e).collect()} == {0}


def test_kernels_agree_with_files(spark):
    h = build.haplotypes(rows(spark, "AACC", "ACAC", "ACCA"))
    for algorithm in build.ALGORITHMS:
        found = build.elements(h, algorithm)
        assert build.vertices(found).where("not inferred").count() == 3
        assert build.labelled_edges(found).count() >= 2
    with pytest.raises(ValueError, match="Unknown algorithm"):
        build.elements(h, "other")


def test_layout(spark):
    v, e = graph(spark, [(i, (i + 1) % 5, w) for i, w in enumerate([1, 2, 1, 3, 1])], 5)
    v = v.withColumns({"frequency": (F.col("index") + 1).cast("double"), "inferred": F.lit(False)})
    out = layout.lay_out(v, e).collect()
    assert len({(round(r.x, 3), round(r.y, 3)) for r in out}) == 5
    assert all(r.radius > 0 and abs(r.x) < 1e6 for r in out)
    xs = [r.x for r in out]
    assert abs((min(xs) + max(xs)) / 2 - 500) < 1e-6
    assert sorted(map(tuple, out)) == sorted(map(tuple, layout.lay_out(v, e).collect()))


def test_columns(spark):
    df = spark.createDataFrame([("12.5S", "Protein", ".C.T")], "a string, b string, c string")
    r = df.select(coordinate(F.col("a")), datatype(F.col("b")), expand_match(F.col("c"), F.lit("AGG"))).first()
    assert tuple(r) == (-12.5, "aa", "ACGT")


def test_palette():
    assert trait_colours(5) == list(TABLEAU10[:5])
    assert len(set(trait_colours(30))) == 30 and trait_colours(12)[0] == "#8dd3c7"
    assert assigned(["#000000"], 1) == ["#000000"] and with_lightness("red", 0.5) == "red"
    # Greys of known lightness; hues keep their order of channels.
    assert with_lightness("#808080", 1.0) == "#ffffff" and with_lightness("#808080", 0.0) == "#000000"
    assert all(sorted(range(3), key=rgb(c).__getitem__) == sorted(range(3), key=rgb(with_lightness(c, 0.6)).__getitem__) for c in ("#4e79a7", "#f28e2c", "#59a14f"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables aren't here")
def _names():
    from haploweave.plans import documents, queries

    some = ("mask_apply", "site_patterns", "pairwise_distance", "trait_frequencies", "msn_edges_eps1", "feasible_triplets", "joining_branches", "pie_angles")
    return [(queries, n) for n in some] + [(documents, n) for n in documents.SQL]


@pytest.mark.parametrize(("module", "name"), _names(), ids=lambda x: x if isinstance(x, str) else "")
def test_queries_against_sql(spark, module, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = module.QUERIES[name](spark, DATA)
    cur = con.execute(module.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns), name
    assert sorted(map(str, map(tuple, df.select(*names).collect()))) == sorted(map(str, cur.fetchall())), name


@pytest.mark.parametrize("name", ["nexus_characters", "nexus_files"])
def test_sequences_against_sql(spark, tmp_path, name):
    """Components at the bounds of states and the floats beside them, vectors that are null, too short or too long, hold nulls or
    no numbers, or have no label."""
    import duckdb
    import numpy as np

    from haploweave.plans import documents

    bounds = [np.float32(s * x) for x in (0, 0.0005, 0.001, 0.1) for s in (-1, 1)]
    whole = [float(y) for x in bounds for y in (x, np.nextafter(x, np.float32(-1)), np.nextafter(x, np.float32(1)))]
    whole += [0.2, -0.2, 0.05, -0.05, 0.0007, float("nan"), float("inf"), float("-inf")] * 5
    rows = [(0, whole, 1), (1, None, 1), (2, whole[:40], 1), (3, whole[::-1] + [0.2], 1), (4, [None] * 5 + whole[5:], 1), (5, [], 1), (6, whole, None), (7, whole[::-1], None), (8, None, 2), (9, whole, 2)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    cur = con.execute(documents.SQL[name])
    found = documents.QUERIES[name](spark, str(tmp_path)).select(*(d[0] for d in cur.description)).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, cur.fetchall())) and len(found) == len(rows)


def test_excess_and_shared_edges(spark):
    v, e = graph(spark, [(0, 1, 2), (1, 2, 3), (2, 1, 9)], 3)
    d = spark.createDataFrame([("g", 1, 0, 2), ("g", 2, 0, 1), ("g", 2, 1, 3)], "network_id string, i int, j int, d int")
    found = paths.shortest_paths(v, e)
    assert G.total_excess(found, d).first().excess == 4
    assert [tuple(r) for r in G.excess_pairs(found, d).collect()] == [("g", 2, 0, 4.0, 0)]
    assert sorted((r.a, r.b, r.edge) for r in G.shared_edges(e).collect()) == [(0, 1, 0), (1, 2, 1)]
    with pytest.raises(Exception, match="shorter than allowed"):
        G.total_excess(found, d.withColumn("d", F.lit(99))).collect()


def test_known_taxa(spark):
    taxa = rows(spark, "A", "C").select("network_id", "taxon")
    good = spark.createDataFrame([("n", "a", 1)], "network_id string, taxon string, x int")
    assert [tuple(r) for r in A.known_taxa(good, taxa).collect()] == [("n", "a", 1)]
    with pytest.raises(Exception, match="not defined: q"):
        A.known_taxa(good.withColumn("taxon", F.lit("q")), taxa).collect()


def grown(rng, n, sites, edits, states="ACGT"):
    """Different sequences, each an earlier one with a few edits."""
    found = ["".join(rng.choice("ACGT") for _ in range(sites))]
    while len(found) < n:
        letters = list(rng.choice(found))
        for _ in range(rng.randint(1, edits)):
            letters[rng.randrange(sites)] = rng.choice(states)
        if "".join(letters) not in found:
            found.append("".join(letters))
    return found


def differ(x, y):
    return sum(a != b and a not in "-N?" and b not in "-N?" for a, b in zip(x, y, strict=True))


@pytest.mark.parametrize("epsilon", [0, 1])
def test_spanning_network(spark, epsilon):
    """Equal to the bottleneck formula over all pairs: unknown states, far groups, single haplotypes, ties."""
    rng = random.Random(epsilon)
    nets = {"p": grown(rng, 40, 20, 2), "q": grown(rng, 25, 20, 3, "ACGTN-"), "r": grown(rng, 6, 70, 1) + grown(rng, 5, 70, 2), "s": ["ACGT"], "t": ["AAAA", "CCCC"]}
    table = spark.createDataFrame([(n, i, q) for n, v in nets.items() for i, q in enumerate(v)], "network_id string, index int, seq string")
    want = sorted((n, k, *link) for n, v in nets.items() for k, link in enumerate(spanning_links(np.array([[differ(x, y) for y in v] for x in v]), epsilon)))
    assert sorted(map(tuple, near.spanning_network(table.repartition(3), epsilon).collect())) == want
    assert near.spanning_network(table.limit(0)).count() == 0
    with pytest.raises(Exception, match="no code: Z"):
        near.spanning_network(table.withColumn("seq", F.concat("seq", F.lit("Z")))).count()


def test_packed_difference(spark):
    rng = random.Random(7)
    pairs = [("".join(rng.choice("ACGTUN-RY") for _ in range(n)), "".join(rng.choice("ACGTUN-RY") for _ in range(n))) for n in (0, 1, 59, 60, 61, 150) for _ in range(8)]
    table = spark.createDataFrame(pairs, "x string, y string")
    got = table.select("x", "y", near.difference(near.packed(F.col("x")), near.packed(F.col("y"))).alias("d")).collect()
    assert all(r.d == sum(a != b and a in "ACGTU" and b in "ACGTU" for a, b in zip(r.x, r.y, strict=True)) for r in got)


def test_near_pairs_none_missed(spark):
    """The index of every radius finds what looking at all pairs finds, and nothing else."""
    rng = random.Random(5)
    seqs = grown(rng, 60, 24, 4)
    table = spark.createDataFrame([("n", i, q) for i, q in enumerate(seqs)], "network_id string, index int, seq string")
    sides = near.prepared(table).withColumns({"component": F.col("index"), "outer": F.col("index") != 3}).cache()
    for low, high in ((-1, 1), (0, 2), (2, 4), (3, 7), (0, 24)):
        want = sorted(("n", i, j, d) for i in range(60) for j in range(i) if low < (d := differ(seqs[i], seqs[j])) <= high)
        assert sorted(map(tuple, near.near_pairs(sides, low, high).collect())) == want


def test_paths_of_many_tiles(spark):
    """Lengths, vias and paths against the triple loop: tiles of 4, parallel and weightless edges, parts, two networks."""
    rng = random.Random(6)
    nets = {"a": (23, [(rng.randrange(20), rng.randrange(20), rng.randint(0, 4)) for _ in range(34)]), "b": (9, [(i, i + 1, 1) for i in range(8)])}
    v = spark.createDataFrame([(n, i) for n, (k, _) in nets.items() for i in range(k)], "network_id string, index int")
    e = spark.createDataFrame([(n, k, *x) for n, (_, edges) in nets.items() for k, x in enumerate(edges)], "network_id string, index int, from int, to int, weight int")
    found = paths.shortest_paths(v, e, tile=4).cache()
    got = {(r.network_id, r.i, r.j): (r.length, r.via) for r in found.collect()}
    want, ways = {}, {}
    for net, (n, edges) in nets.items():
        length, via = [[0 if i == j else float("inf") for j in range(n)] for i in range(n)], [[-1] * n for _ in range(n)]
        for a, b, w in edges:
            length[a][b] = length[b][a] = min(length[a][b], w)
        for k in range(n):
            for i in range(n):
                for j in range(n):
                    if length[i][k] + length[k][j] < length[i][j]:
                        length[i][j], via[i][j] = length[i][k] + length[k][j], k

        def way(i, j, via=via):
            return [j] if via[i][j] < 0 else way(i, via[i][j]) + way(via[i][j], j)

        for i in range(n):
            for j in range(n):
                if length[i][j] < float("inf"):
                    want[net, i, j] = (length[i][j], via[i][j])
                    if i != j:
                        ways[net, i, j] = way(i, j)
    assert got == want
    rows = {}
    for r in paths.path_edges(found, e).collect():
        rows.setdefault((r.network_id, r.i, r.j), []).append((r.step, r.vertex, r.edge))
    assert {k: [x for _, x, _ in sorted(p)] for k, p in rows.items()} == ways
    for (net, i, j), p in rows.items():
        assert [s for s, _, _ in sorted(p)] == list(range(len(p)))
        assert sum(nets[net][1][x][2] for _, _, x in p) == want[net, i, j][0]


def test_contract(spark):
    """Chains of all lengths, in both directions, a loop back to its start, a ring without an end, parallel chains."""
    chain = [(0, 10, 1), (11, 10, 2), (11, 12, 3), (12, 1, 4)]  # 0 to 1 over three
    more = [(0, 1, 7), (1, 20, 1), (20, 0, 1), (2, 30, 1), (30, 31, 1), (31, 2, 5), (40, 41, 1), (41, 42, 1), (42, 40, 1), (2, 1, 9)]
    long = [(0, 100, 1)] + [(k, k + 1, 1) for k in range(100, 170)] + [(170, 2, 1)]
    e = [("g", k, a, b, w) for k, (a, b, w) in enumerate(chain + more + long)]
    table = spark.createDataFrame(e, "network_id string, index int, from int, to int, weight int")
    v = spark.createDataFrame([("g", i, i < 3) for i in {x for r in e for x in r[2:4]}], "network_id string, index int, keep boolean")
    got = sorted((*sorted((r["from"], r.to)), r.weight, r.n_edges) for r in G.contract(v, table).collect())
    assert got == [(0, 1, 2.0, 2), (0, 1, 7.0, 1), (0, 1, 10.0, 4), (0, 2, 72.0, 72), (1, 2, 9.0, 1), (2, 2, 7.0, 3)]
    assert G.contract(v, table.limit(0)).count() == 0


def test_peel(spark):
    v = spark.createDataFrame([("g", i, i in (0, 4)) for i in range(9)], "network_id string, index int, keep boolean")
    e = spark.createDataFrame([("g", k, a, b, 1) for k, (a, b) in enumerate([(0, 1), (1, 2), (2, 3), (2, 4), (3, 5), (5, 6), (7, 8)])], "network_id string, index int, from int, to int, weight int")
    left, links = G.peel(v, e)
    assert sorted(r["index"] for r in left.collect()) == [0, 1, 2, 4] and sorted(r["index"] for r in links.collect()) == [0, 1, 3]


def test_median_joining(spark, epsilon=1):
    """The same sequences and links between them as the kernel of one task, for several networks at once, with weights."""
    rng = random.Random(40 + epsilon)
    nets = {"a": grown(rng, 6, 8, 2), "b": ["AAAA", "CCAA", "ACCA", "CACG"], "c": ["AC"], "d": ["AGT", "CTT", "GAT"]}
    rows_ = [(n, i, f"{n}{i}", q) for n, seqs in nets.items() for i, q in enumerate(seqs)]
    haps = A.condense(spark.createDataFrame(rows_, "network_id string, taxon_idx int, taxon string, seq string"))
    c = A.condensed(haps, A.site_patterns(haps)).cache()
    v, e = (t.collect() for t in medians.median_joining(c, epsilon))
    seq = {(r.network_id, r["index"]): r.pattern_seq for r in v}
    got = {(n, frozenset((seq[n, r["from"]], seq[n, r.to])), r.weight) for r in e for n in [r.network_id]}
    found = build.elements(c, "MJN", epsilon)
    kernel = {(r.network_id, r["index"]): (r.sequence, r.inferred) for r in build.vertices(found).collect()}
    haps_seq = {(r.network_id, r.hap_idx): r.pattern_seq for r in c.collect()}
    for k, r in {(r.network_id, r["index"]): r for r in build.vertices(found).collect()}.items():
        kernel[k] = (haps_seq[r.network_id, r.hap_idx] if not r.inferred else r.sequence, r.inferred)
    assert sorted((n, s, i) for (n, _), (s, i) in kernel.items()) == sorted((r.network_id, r.pattern_seq, r.inferred) for r in v)
    assert got == {(r.network_id, frozenset((kernel[r.network_id, r["from"]][0], kernel[r.network_id, r.to][0])), r.weight) for r in build.edges(found).collect()}
    assert any(r.inferred for r in v)


def test_patterns_brute_force(spark):
    """Patterns of random alignments, unknown states among them, against comparing whole columns."""
    rng = random.Random(12)
    for alphabet in ("AC", "ACGT", "ACN-", "N-?"):
        seqs = sorted({"".join(rng.choice(alphabet) for _ in range(14)) for _ in range(5)})
        haps = spark.createDataFrame([("n", i, q) for i, q in enumerate(seqs)], "network_id string, hap_idx int, seq string").repartition(3)
        forms, want = [], {}
        for k in range(14):
            column = [q[k] for q in seqs]
            if all(c in "N-?" for c in column):
                continue
            form = tuple(c if c in "N-?" else column.index(c) for c in column)
            if form not in forms:
                forms.append(form)
            want[k] = forms.index(form)
        assert {r.site: r.pattern_idx for r in A.site_patterns(haps).collect()} == want
