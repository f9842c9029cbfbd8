"""Queries over a folder's tables: alignments derived from `embeddings`, traits from `events`, and every step on them.

A network for each label, a taxon for each vector. dna(): a state for each component, by its range, unknown close to
zero. binary(sites): a state for each of so many sums over components, by its sign, so that every component counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.states import characters, expand_match, nucleotide_class
from ..operators import alignment as A
from ..operators import graph as G
from ..operators import joining, medians, near, paths
from ..shared import save
from . import build, layout

#: Sites of the alignments: few where sequences are to be equal, more where they are to differ.
FEW, MORE, NETWORK, DNA = 6, 16, 8, 64


def _taxa(spark: SparkSession, folder: str) -> DataFrame:
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    return _placed_in_label(e).select(F.col("label").alias("network_id"), "taxon_idx", F.col("vec_id").cast("string").alias("taxon"), "embedding")


def _placed_in_label(rows: DataFrame, span: int = 1 << 16) -> DataFrame:
    """rows with taxon_idx: the place by vec_id within the label. Counted within spans of ids, after what lies in lower ones,
    so that a label of any size is numbered in many tasks."""
    rows = rows.withColumn("span", F.floor(F.col("vec_id") / span))
    counts = rows.groupBy(F.col("label").alias("l"), F.col("span").alias("s")).agg(F.count("*").alias("n"))
    lower = F.coalesce(F.sum("n").over(Window.partitionBy("l").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("label", "span").orderBy("vec_id")) - 1)
    joined = placed.join(counts.select("l", "s", lower.alias("lower")), F.col("label").eqNullSafe(F.col("l")) & F.col("span").eqNullSafe(F.col("s")))
    return joined.withColumn("taxon_idx", (F.col("lower") + F.col("place")).cast("int")).drop("span", "l", "s", "lower", "place")


def dna(spark: SparkSession, folder: str) -> DataFrame:
    """Always of DNA sites, whatever a vector holds: what it lacks is no number below a bound. Bounds are of the components' own
    type: the float next to -0.1 is -0.1, not below it."""
    rows = _taxa(spark, folder)
    number = rows.schema["embedding"].dataType.elementType
    below = lambda x, bound: x < F.lit(bound).cast(number)
    state = lambda x: F.when(below(F.abs(x), 0.0005), "-").when(below(F.abs(x), 0.001), "N").when(below(x, -0.1), "A").when(below(x, 0.0), "C").when(below(x, 0.1), "G").otherwise("T")
    sites = F.transform(F.sequence(F.lit(0), F.lit(DNA - 1)), lambda k: state(F.get("embedding", k)))
    return rows.select("network_id", "taxon_idx", "taxon", F.array_join(sites, "").alias("seq"))


def binary(spark: SparkSession, folder: str, sites: int) -> DataFrame:
    def state(k: F.Column) -> F.Column:
        some = F.filter(F.transform("embedding", lambda x, i: F.when(i % sites == k, x.cast("double"))), lambda x: x.isNotNull())
        return F.when(F.aggregate(some, F.lit(0.0), lambda a, x: a + x) >= 0, "1").otherwise("0")

    bits = F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), state)
    return _taxa(spark, folder).select("network_id", "taxon_idx", "taxon", F.array_join(bits, "").alias("seq"))


def _haps(spark: SparkSession, folder: str, sites: int) -> DataFrame:
    return A.condense(binary(spark, folder, sites))


def _condensed(spark: SparkSession, folder: str, sites: int) -> DataFrame:
    haps = _haps(spark, folder, sites)
    return A.condensed(haps, A.site_patterns(haps, "binary"))


def _distances(spark: SparkSession, folder: str, sites: int = MORE) -> DataFrame:
    return A.distances(_condensed(spark, folder, sites), "binary").select("network_id", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "d")


def _msn(spark: SparkSession, folder: str, sites: int = MORE) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of the spanning networks."""
    haps = _haps(spark, folder, sites).select("network_id", F.col("hap_idx").alias("index"), "seq")
    e = near.spanning_network(haps, kind="binary")
    haps = haps.drop("seq")
    return haps, e.select("network_id", F.col("edge_idx").cast("int").alias("index"), F.col("later").cast("int").alias("from"), F.col("earlier").cast("int").alias("to"), "weight")


def _traits(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Counts of event types by user, their labels, and the users as one alignment of sequences of three states."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    one = F.lit("events").alias("network_id")
    kinds = e.select("event_type").distinct().select(one, (F.row_number().over(Window.orderBy("event_type")) - 1).alias("trait_idx"), F.col("event_type").alias("label"))
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("count"))
    traits = counts.join(kinds, counts.event_type == kinds.label).select("network_id", F.col("user_id").cast("string").alias("taxon"), "trait_idx", "count")
    users = e.select("user_id").distinct()
    seq = F.concat(*[F.element_at(F.array(*map(F.lit, "ACG")), (F.col("user_id") % m % 3 + 1).cast("int")) for m in (3, 5, 7)])
    # Users in the order of their ids: the ids are places enough, and nothing needs to be numbered in one task.
    rows = users.select(one, F.col("user_id").cast("int").alias("taxon_idx"), F.col("user_id").cast("string").alias("taxon"), seq.alias("seq"))
    return traits, kinds, rows


def alignment_long(spark: SparkSession, folder: str) -> DataFrame:
    return A.sites(dna(spark, folder)).select("network_id", "taxon_idx", F.col("site").cast("int").alias("site"), "state")


def match_char_expand(spark: SparkSession, folder: str) -> DataFrame:
    rows = dna(spark, folder)
    top = rows.where("taxon_idx = 0").select("network_id", F.col("seq").alias("top"))
    both = rows.join(top, "network_id")
    dotted = F.array_join(F.zip_with(characters("seq"), characters("top"), lambda c, t: F.when(c == t, ".").otherwise(c)), "")
    both = both.withColumn("dotted", F.when(F.col("taxon_idx") == 0, F.col("seq")).otherwise(dotted))
    return both.select("network_id", "taxon_idx", expand_match(F.col("dotted"), F.col("top")).alias("seq"))


def ambiguity_flags(spark: SparkSession, folder: str) -> DataFrame:
    return A.ambiguity_flags(dna(spark, folder))


def site_mask(spark: SparkSession, folder: str) -> DataFrame:
    return A.site_mask(dna(spark, folder))


def masked_sites(spark: SparkSession, folder: str) -> DataFrame:
    found = A.masked_sites(A.site_mask(dna(spark, folder)))
    return found.select("network_id", F.array_join(F.col("masked").cast("array<string>"), ",").alias("masked"))


def mask_apply(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.checked(dna(spark, folder))
    return A.apply_mask(rows, A.site_mask(rows))


def condense_haplotypes(spark: SparkSession, folder: str) -> DataFrame:
    h = _haps(spark, folder, FEW)
    return h.select("network_id", "hap_idx", "name", "seq", F.array_join(F.col("originals").cast("array<string>"), ",").alias("originals"), "frequency")


def site_patterns(spark: SparkSession, folder: str) -> DataFrame:
    h = A.condense(dna(spark, folder))
    return A.site_patterns(h).select("network_id", "site", F.col("pattern_idx").cast("int").alias("pattern_idx"))


def pattern_weights(spark: SparkSession, folder: str) -> DataFrame:
    h = A.condense(binary(spark, folder, MORE))
    return A.pattern_weights(A.site_patterns(h, "binary")).select("network_id", "pattern_idx", "site", "weight")


def pairwise_distance(spark: SparkSession, folder: str) -> DataFrame:
    h = A.condense(dna(spark, folder))
    return A.distances(A.condensed(h, A.site_patterns(h)))


def haplotype_traits(spark: SparkSession, folder: str) -> DataFrame:
    traits, labels, rows = _traits(spark, folder)
    return A.haplotype_traits(rows, A.condense(rows), traits, labels)


def trait_frequencies(spark: SparkSession, folder: str) -> DataFrame:
    traits, labels, rows = _traits(spark, folder)
    haps = A.condense(rows)
    out = A.with_traits(haps, A.haplotype_traits(rows, haps, traits, labels))
    return out.select("network_id", "hap_idx", "name", "frequency", F.array_join(F.transform("traits", lambda x: x.cast("long").cast("string")), ",").alias("traits"))


def trait_summary(spark: SparkSession, folder: str) -> DataFrame:
    return A.trait_summary(_traits(spark, folder)[0])


def msn_edges_eps0(spark: SparkSession, folder: str) -> DataFrame:
    return near.spanning_network(_sequences(_haps(spark, folder, MORE)), kind="binary")


def msn_edges_eps1(spark: SparkSession, folder: str) -> DataFrame:
    return near.spanning_network(_sequences(_haps(spark, folder, NETWORK)), 1, "binary")


def spanning_network(spark: SparkSession, folder: str) -> DataFrame:
    """Spanning networks of all components as nucleotides."""
    return near.spanning_network(_sequences(A.condense(dna(spark, folder))))


def _sequences(haps: DataFrame) -> DataFrame:
    return haps.select("network_id", F.col("hap_idx").alias("index"), "seq")


def components_at_threshold(spark: SparkSession, folder: str) -> DataFrame:
    return near.components_within(_sequences(_haps(spark, folder, MORE)), 3, "binary")


def shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    return paths.shortest_paths(*_msn(spark, folder), of=("length",))


def path_vias(spark: SparkSession, folder: str) -> DataFrame:
    """For each pair the vertex that its shortest path goes by, as the triple loop notes it."""
    return paths.shortest_paths(*_msn(spark, folder), of=("via",))


def path_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest path between every two vertices, edge by edge."""
    return paths.all_path_edges(*_msn(spark, folder))


def _visits(spark: SparkSession, folder: str, kept: F.Column) -> tuple[DataFrame, DataFrame]:
    """Events as vertices, each linked to its user's one before by as much as their ids differ."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    one = F.lit("events").alias("network_id")
    before = e.select("event_id", F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).alias("before")).where("before is not null")
    edges = before.select(one, F.col("event_id").alias("index"), F.col("before").alias("from"), F.col("event_id").alias("to"), (F.col("event_id") - F.col("before")).alias("weight"))
    return e.select(one, F.col("event_id").alias("index"), kept.alias("keep")), edges


def contracted_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Users' events with those between two others taken out, but for purchases."""
    return G.contract(*_visits(spark, folder, F.col("event_type") == "purchase"))


def peeled_leaves(spark: SparkSession, folder: str) -> DataFrame:
    """Events that stay when clicks at the ends of users' chains go, again and again."""
    return G.peel(*_visits(spark, folder, F.col("event_type") != "click"))[0].select("network_id", "index")


def joining_branches(spark: SparkSession, folder: str) -> DataFrame:
    """Branches of the neighbour-joining trees."""
    haps = _condensed(spark, folder, FEW)
    vertices = save(haps.select("network_id", F.col("hap_idx").alias("index")), "haps")
    trees = joining.joining_trees(vertices, save(_distances(spark, folder, FEW), "pairs"))
    return trees.select("network_id", F.col("index").alias("branch"), "from", "to", F.round("weight", 6).alias("weight"))


def median_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Condensed sequences of the median-joining networks, sampled and inferred."""
    return medians.median_joining(_condensed(spark, folder, FEW), kind="binary")[0].select("network_id", "pattern_seq", "inferred")


def total_excess(spark: SparkSession, folder: str) -> DataFrame:
    return paths.total_excess(_sequences(_haps(spark, folder, MORE)), _msn(spark, folder)[1], "binary")


def excess_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return paths.excess_pairs(_sequences(_haps(spark, folder, MORE)), _msn(spark, folder)[1], "binary")


def shared_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.shared_edges(_msn(spark, folder)[1])


def vertex_degree(spark: SparkSession, folder: str) -> DataFrame:
    return G.degrees(*_msn(spark, folder))


def incident_edges(spark: SparkSession, folder: str) -> DataFrame:
    return G.endpoints(_msn(spark, folder)[1])


def feasible_triplets(spark: SparkSession, folder: str) -> DataFrame:
    return G.feasible_triplets(_msn(spark, folder)[1])


def remove_vertex(spark: SparkSession, folder: str) -> DataFrame:
    """The edges without each network's vertex 1."""
    v, e = _msn(spark, folder)
    return G.remove_vertices(v, e, v.where("index = 1"))[1]


def nj_q_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return G.nj_scores(_distances(spark, folder, NETWORK))


def nj_first_pair(spark: SparkSession, folder: str) -> DataFrame:
    q = G.nj_scores(_distances(spark, folder, NETWORK))
    return q.groupBy("network_id").agg(F.min(F.struct("q", "i", "j")).alias("m")).select("network_id", "m.i", "m.j", "m.q")


def pair_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return G.pair_buckets(_distances(spark, folder, NETWORK))


def pie_angles(spark: SparkSession, folder: str) -> DataFrame:
    traits, labels, rows = _traits(spark, folder)
    p = G.pie_slices(A.haplotype_traits(rows, A.condense(rows), traits, labels))
    return p.select("network_id", "hap_idx", "trait_idx", F.round("start", 6).alias("start"), F.round("stop", 6).alias("stop"))


def _placed(spark: SparkSession, folder: str) -> DataFrame:
    """Haplotypes as vertices; the first two components of their first taxon are the coordinates."""
    h = _haps(spark, folder, FEW)
    taxa = _taxa(spark, folder).select("network_id", "taxon_idx", F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"))
    first = h.withColumn("taxon_idx", F.col("originals")[0]).join(taxa, ["network_id", "taxon_idx"])
    return G.radii(first.select("network_id", F.col("hap_idx").alias("index"), "x", "y", "frequency", F.lit(False).alias("inferred")))


def vertex_radius(spark: SparkSession, folder: str) -> DataFrame:
    return _placed(spark, folder).select("network_id", "index", F.round("radius", 6).alias("radius"))


def graph_bounds(spark: SparkSession, folder: str) -> DataFrame:
    b = G.bounds(_placed(spark, folder))
    return b.select("network_id", *(F.round(c, 5).alias(c) for c in ("min_x", "min_y", "max_x", "max_y")))


def nucleotide_classes(spark: SparkSession, folder: str) -> DataFrame:
    rows = A.sites(dna(spark, folder))
    mask = A.site_mask(dna(spark, folder))
    both = rows.join(mask, ["network_id", "site"]).withColumn("cls", nucleotide_class(F.col("state"), ~F.col("keep")))
    return both.groupBy("network_id", "site", "cls").agg(F.count("*").alias("n")).select("network_id", F.col("site").cast("int").alias("site"), "cls", "n")


def _network(algorithm: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return build.labelled_edges(build.elements(_condensed(spark, folder, NETWORK), algorithm, kind="binary"))

    query.__doc__ = f"Edge lists of the {algorithm} networks."
    return query


def layout_xy(spark: SparkSession, folder: str) -> DataFrame:
    haps = _condensed(spark, folder, FEW)
    found = build.elements(haps, "MSN", kind="binary")
    return layout.lay_out(build.with_frequencies(build.vertices(found), haps), build.edges(found))


_PLAIN = (alignment_long, match_char_expand, ambiguity_flags, site_mask, masked_sites, mask_apply, condense_haplotypes, site_patterns, pattern_weights, pairwise_distance, haplotype_traits, trait_frequencies, trait_summary, msn_edges_eps0, msn_edges_eps1, spanning_network, components_at_threshold, shortest_paths, path_vias, path_edges, contracted_chains, peeled_leaves, joining_branches, median_sequences, total_excess, excess_pairs, shared_edges, vertex_degree, incident_edges, feasible_triplets, remove_vertex, nj_q_matrix, nj_first_pair, pair_buckets, pie_angles, vertex_radius, graph_bounds, nucleotide_classes, layout_xy)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _PLAIN} | {f"{a.lower()}_edges": _network(a) for a in build.ALGORITHMS}

# ---- the same in SQL

_T = "t AS (SELECT label AS network_id, (row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1)::INT AS taxon_idx, vec_id::VARCHAR AS taxon, embedding AS e FROM embeddings)"
_DNA = f"""{_T},
cells AS (SELECT network_id, taxon_idx, taxon, e[k + 1] AS x, k::INT AS site FROM t, (SELECT unnest(range(0, 64)) AS k)),
s AS (SELECT network_id, taxon_idx, taxon, site, CASE WHEN abs(x) < 0.0005 THEN '-' WHEN abs(x) < 0.001 THEN 'N' WHEN x < -0.1 THEN 'A' WHEN x < 0 THEN 'C'
  WHEN x < 0.1 THEN 'G' ELSE 'T' END AS state FROM cells),
q AS (SELECT network_id, taxon_idx, taxon, string_agg(state, '' ORDER BY site) AS seq FROM s GROUP BY ALL)"""
_AMB = "('-', '?', 'N', 'Y', 'R', 'M', 'S', 'V', 'W', 'K', 'D', 'H', 'B')"
_FLAGS = f"f AS (SELECT network_id, site, bool_or(state IN {_AMB}) AS undefined FROM s GROUP BY ALL)"
_MASK = f"{_FLAGS}, m AS (SELECT network_id, site, NOT undefined OR 100.0 * sum(undefined::INT) OVER (PARTITION BY network_id) / count(*) OVER (PARTITION BY network_id) <= 5 AS keep FROM f)"


def _bin(sites: int) -> str:
    return f"""{_T},
s AS (SELECT network_id, taxon_idx, taxon, k::INT AS site, CASE WHEN sum(x::DOUBLE ORDER BY p) >= 0 THEN '1' ELSE '0' END AS state
  FROM (SELECT network_id, taxon_idx, taxon, p % {sites} AS k, p, e[p + 1] AS x FROM t, (SELECT unnest(range(0, 64)) AS p)) GROUP BY ALL),
q AS (SELECT network_id, taxon_idx, taxon, string_agg(state, '' ORDER BY site) AS seq FROM s GROUP BY ALL)"""


_HAPS = """g AS (SELECT network_id, seq, min(taxon_idx) AS lead, arg_min(taxon, taxon_idx) AS name, string_agg(taxon_idx::VARCHAR, ',' ORDER BY taxon_idx) AS originals, count(*)::DOUBLE AS frequency FROM q GROUP BY ALL),
h AS (SELECT network_id, (row_number() OVER (PARTITION BY network_id ORDER BY lead) - 1)::INT AS hap_idx, name, seq, originals, lead, frequency FROM g)"""


def _pats(sites: int, amb: str) -> str:
    return f"""col AS (SELECT network_id, k::INT AS site, list(substr(seq, k + 1, 1) ORDER BY hap_idx) AS states FROM h, (SELECT unnest(range(0, {sites})) AS k) GROUP BY ALL),
form AS (SELECT network_id, site, list_transform(states, lambda c: CASE WHEN c IN {amb} THEN c ELSE list_position(states, c)::VARCHAR END) AS form
  FROM col WHERE len(list_filter(states, lambda c: c NOT IN {amb})) > 0),
lead AS (SELECT network_id, site, min(site) OVER (PARTITION BY network_id, form) AS first FROM form),
p AS (SELECT network_id, site, (dense_rank() OVER (PARTITION BY network_id ORDER BY first) - 1)::INT AS pattern_idx FROM lead)"""


def _dist(sites: int, amb: str = "('-', '?')") -> str:
    """d: distances over all sites; sites of equal patterns count as often as they occur."""
    return f"""d AS (SELECT a.network_id, a.hap_idx AS i, b.hap_idx AS j, len(list_filter(range(1, {sites + 1}), lambda k: substr(a.seq, k, 1) <> substr(b.seq, k, 1)
  AND substr(a.seq, k, 1) NOT IN {amb} AND substr(b.seq, k, 1) NOT IN {amb}))::BIGINT AS d FROM h a JOIN h b ON a.network_id = b.network_id AND a.hap_idx > b.hap_idx)"""


def _msn_sql(sites: int, epsilon: int) -> str:
    return f"{_bin(sites)}, {_HAPS}, {_dist(sites)}, {_links(epsilon)}"


def _links(epsilon: int) -> str:
    """Minimax distances by closing over thresholds; a pair is linked if none shorter than its own less epsilon joins it."""
    return f"""both_ AS (SELECT network_id, i, j, d FROM d UNION ALL SELECT network_id, j, i, d FROM d),
ts AS (SELECT DISTINCT network_id, d AS t FROM d),
r(network_id, t, x, y) AS (SELECT network_id, t, i, i FROM ts JOIN (SELECT DISTINCT network_id, i FROM both_) USING (network_id)
  UNION SELECT r.network_id, r.t, r.x, b.j FROM r JOIN both_ b ON b.network_id = r.network_id AND b.i = r.y AND b.d <= r.t),
bn AS (SELECT network_id, x AS i, y AS j, min(t) AS b FROM r WHERE x > y GROUP BY ALL),
w AS (SELECT network_id, max(b) AS w FROM bn GROUP BY ALL),
e AS (SELECT d.network_id, d.i AS later, d.j AS earlier, d.d AS weight FROM d JOIN bn USING (network_id, i, j) JOIN w USING (network_id) WHERE bn.b >= d.d - {epsilon} AND d.d <= w.w + {epsilon})"""


_MSN = _msn_sql(MORE, 0) + ", ed AS (SELECT network_id, (row_number() OVER (PARTITION BY network_id ORDER BY weight, later, earlier) - 1)::INT AS index, later AS a, earlier AS b, weight FROM e)"
_EDGES = "SELECT network_id, row_number() OVER (PARTITION BY network_id ORDER BY weight, later, earlier) - 1 AS edge_idx, later::BIGINT AS later, earlier::BIGINT AS earlier, weight FROM e"
_ENDS = "ends AS (SELECT network_id, a AS vertex, index AS edge, b AS other, weight FROM ed UNION ALL SELECT network_id, b, index, a, weight FROM ed)"
_EV = """k AS (SELECT event_type AS label, (row_number() OVER (ORDER BY event_type) - 1)::INT AS trait_idx FROM (SELECT DISTINCT event_type FROM events)),
c AS (SELECT user_id, event_type, count(*)::DOUBLE AS n FROM events GROUP BY ALL),
u AS (SELECT user_id, (row_number() OVER (ORDER BY user_id) - 1)::INT AS taxon_idx, substr('ACG', (user_id % 3 % 3 + 1)::INT, 1) || substr('ACG', (user_id % 5 % 3 + 1)::INT, 1) || substr('ACG', (user_id % 7 % 3 + 1)::INT, 1) AS seq
  FROM (SELECT DISTINCT user_id FROM events)),
g AS (SELECT seq, min(taxon_idx) AS lead, arg_min(user_id, taxon_idx)::VARCHAR AS name FROM u GROUP BY seq),
h AS (SELECT seq, name, (row_number() OVER (ORDER BY lead) - 1)::INT AS hap_idx FROM g),
ht AS (SELECT hap_idx, k.trait_idx, coalesce(sum(n), 0) AS count FROM h CROSS JOIN k JOIN u USING (seq) LEFT JOIN c ON c.user_id = u.user_id AND c.event_type = k.label GROUP BY ALL)"""
_NJ = f"""full_ AS (SELECT network_id, i AS a, d FROM d UNION ALL SELECT network_id, j, d FROM d), su AS (SELECT network_id, a, sum(d)::BIGINT AS s FROM full_ GROUP BY ALL),
nn AS (SELECT network_id, count(*) AS n FROM su GROUP BY ALL),
nq AS (SELECT d.network_id, d.i, d.j, ((nn.n - 2) * d.d - x.s - y.s)::BIGINT AS q FROM d JOIN su x ON x.network_id = d.network_id AND x.a = d.i JOIN su y ON y.network_id = d.network_id AND y.a = d.j JOIN nn ON nn.network_id = d.network_id)"""
#: One row a network and join: distances of what is left, as rows in order; criteria and lengths are sums term by term.
_TREES = f"""full_ AS (SELECT network_id, i AS a, j AS b, d::DOUBLE AS d FROM d UNION ALL SELECT network_id, j, i, d::DOUBLE FROM d UNION ALL SELECT network_id, hap_idx, hap_idx, 0.0::DOUBLE FROM h),
lines AS (SELECT network_id, a, list(d ORDER BY b) AS line FROM full_ GROUP BY ALL),
tr(network_id, n, nodes, d, la, lb, na, nb) AS (
SELECT network_id, count(*), range(count(*)), list(line ORDER BY a), 0.0::DOUBLE, 0.0::DOUBLE, -1::BIGINT, -1::BIGINT FROM lines GROUP BY network_id
UNION ALL
SELECT network_id, n, list_filter(list_transform(nodes, lambda x, k: CASE WHEN k = p.b THEN 2 * n - m ELSE x END), lambda x, k: k <> p.a),
  list_filter(list_transform(d, lambda line, i: list_filter(list_transform(line, lambda x, k: CASE WHEN i = p.b AND k = p.b THEN 0.0 WHEN i = p.b THEN 0.5 * (d[p.a][k] - la + d[p.b][k] - lb) WHEN k = p.b THEN 0.5 * (line[p.a] - la + line[p.b] - lb) ELSE x END), lambda x, k: k <> p.a)), lambda line, i: i <> p.a),
  la, lb, nodes[p.a], nodes[p.b]
FROM (SELECT *, greatest(0.0, 0.5 * d[p.a][p.b] + list_reduce(list_prepend(0.0::DOUBLE, flatten(list_transform(range(1, m + 1), lambda k: [d[p.a][k], -d[p.b][k]]))), lambda x, y: x + y) / (2 * (m - 2))) AS la,
  greatest(0.0, 0.5 * d[p.a][p.b] + list_reduce(list_prepend(0.0::DOUBLE, flatten(list_transform(range(1, m + 1), lambda k: [d[p.b][k], -d[p.a][k]]))), lambda x, y: x + y) / (2 * (m - 2))) AS lb
FROM (SELECT network_id, n, nodes, d, len(d) AS m, list_min(flatten(list_transform(range(2, len(d) + 1), lambda i: list_transform(range(1, i), lambda j:
  {{'q': list_reduce(list_prepend((len(d) - 2) * d[i][j], flatten(list_transform(range(1, len(d) + 1), lambda k: [d[i][k], d[j][k]]))), lambda x, y: x - y), 'a': i, 'b': j}})))) AS p
FROM tr WHERE len(d) > 2)))"""
_PLACED = f"{_bin(FEW)}, {_HAPS}, v AS (SELECT h.network_id, hap_idx AS index, e[1]::DOUBLE AS x, e[2]::DOUBLE AS y, 7.5 * sqrt(greatest(4.0 / 9, frequency)) AS radius FROM h JOIN t ON t.network_id = h.network_id AND t.taxon_idx = h.lead)"



def _paths(rounds: int = 9) -> str:
    """x: least lengths, and of the highest vertices between the ends the lowest, by squaring: paths of 2^rounds edges."""
    parts = ["""p0 AS MATERIALIZED (SELECT network_id, i, j, min(struct_pack(length := length, via := via)) AS p FROM (
  SELECT network_id, vertex AS i, other AS j, weight::DOUBLE AS length, -1 AS via FROM ends UNION ALL SELECT network_id, hap_idx, hap_idx, 0, -1 FROM h) GROUP BY ALL)"""]
    for r in range(rounds):
        parts.append(f"""p{r + 1} AS MATERIALIZED (SELECT network_id, i, j, min(p) AS p FROM (SELECT * FROM p{r} UNION ALL
  SELECT a.network_id, a.i, b.j, struct_pack(length := a.p.length + b.p.length, via := greatest(a.p.via, b.p.via, a.j)) FROM p{r} a JOIN p{r} b ON a.network_id = b.network_id AND a.j = b.i) GROUP BY ALL)""")
    return ", ".join(parts) + f", x AS (SELECT network_id, i, j, p.length AS length, p.via AS via FROM p{rounds})"


_PATHS = _paths()
_PATH_EDGES = """u(network_id, i, j, a, b) AS (SELECT network_id, i, j, i, j FROM x WHERE i <> j
  UNION ALL SELECT u.network_id, u.i, u.j, CASE k WHEN 0 THEN u.a ELSE x.via END, CASE k WHEN 0 THEN x.via ELSE u.b END
  FROM u JOIN x ON x.network_id = u.network_id AND x.i = u.a AND x.j = u.b, (VALUES (0), (1)) AS two(k) WHERE x.via >= 0),
first AS (SELECT network_id, vertex, other, arg_min(edge, (weight, edge)) AS edge FROM ends GROUP BY ALL)"""

SQL: dict[str, str] = {
    "alignment_long": f"WITH {_DNA} SELECT network_id, taxon_idx, site, state FROM s",
    "match_char_expand": f"WITH {_DNA} SELECT network_id, taxon_idx, seq FROM q",
    "ambiguity_flags": f"WITH {_DNA}, {_FLAGS} SELECT * FROM f",
    "site_mask": f"WITH {_DNA}, {_MASK} SELECT * FROM m",
    "masked_sites": f"WITH {_DNA}, {_MASK} SELECT network_id, coalesce(string_agg(site::VARCHAR, ',' ORDER BY site) FILTER (NOT keep), '') AS masked FROM m GROUP BY ALL",
    "mask_apply": f"WITH {_DNA}, {_MASK} SELECT network_id, taxon_idx, taxon, coalesce(string_agg(state, '' ORDER BY site) FILTER (keep), '') AS seq FROM s JOIN m USING (network_id, site) GROUP BY ALL",
    "condense_haplotypes": f"WITH {_bin(FEW)}, {_HAPS} SELECT network_id, hap_idx, name, seq, originals, frequency FROM h",
    "site_patterns": f"WITH {_DNA}, {_HAPS}, {_pats(64, _AMB)} SELECT * FROM p",
    "pattern_weights": f"WITH {_bin(MORE)}, {_HAPS}, {_pats(MORE, "('-', '?')")} SELECT network_id, pattern_idx, min(site) AS site, count(*) AS weight FROM p GROUP BY ALL",
    "pairwise_distance": f"WITH {_DNA}, {_HAPS}, {_dist(64, _AMB)} SELECT * FROM d",
    "haplotype_traits": f"WITH {_EV} SELECT 'events' AS network_id, hap_idx, trait_idx, count FROM ht",
    "trait_frequencies": f"WITH {_EV} SELECT 'events' AS network_id, hap_idx, name, sum(count) AS frequency, string_agg(count::BIGINT::VARCHAR, ',' ORDER BY trait_idx) AS traits FROM ht JOIN h USING (hap_idx) GROUP BY hap_idx, name",
    "trait_summary": f"WITH {_EV} SELECT 'events' AS network_id, trait_idx, count(*) AS n_sequences, sum(n) AS n_samples FROM c JOIN k ON k.label = c.event_type GROUP BY trait_idx",
    "msn_edges_eps0": f"WITH RECURSIVE {_msn_sql(MORE, 0)} {_EDGES}",
    "msn_edges_eps1": f"WITH RECURSIVE {_msn_sql(NETWORK, 1)} {_EDGES}",
    "components_at_threshold": f"""WITH RECURSIVE {_bin(MORE)}, {_HAPS}, {_dist(MORE)}, b AS (SELECT network_id, i, j FROM d WHERE d < 3 UNION ALL SELECT network_id, j, i FROM d WHERE d < 3),
r(network_id, x, y) AS (SELECT network_id, hap_idx, hap_idx FROM h UNION SELECT r.network_id, r.x, b.j FROM r JOIN b ON b.network_id = r.network_id AND b.i = r.y)
SELECT network_id, x AS index, min(y) AS component FROM r GROUP BY ALL""",
    "shortest_paths": f"""WITH RECURSIVE {_MSN}, {_ENDS}, {_PATHS} SELECT network_id, i, j, length FROM x""",
    "path_vias": f"WITH RECURSIVE {_MSN}, {_ENDS}, {_PATHS} SELECT network_id, i, j, via FROM x",
    "path_edges": f"""WITH RECURSIVE {_MSN}, {_ENDS}, {_PATHS}, {_PATH_EDGES}
SELECT u.network_id, u.i, u.j, (row_number() OVER (PARTITION BY u.network_id, u.i, u.j ORDER BY s.length) - 1)::INT AS step, u.b AS vertex, edge
FROM u JOIN x ON x.network_id = u.network_id AND x.i = u.a AND x.j = u.b AND x.via < 0 JOIN x s ON s.network_id = u.network_id AND s.i = u.i AND s.j = u.a
JOIN first ON first.network_id = u.network_id AND first.vertex = u.a AND first.other = u.b""",
    "contracted_chains": """WITH p AS (SELECT *, row_number() OVER w AS nth, lead(event_id) OVER w AS next, event_type = 'purchase' OR lag(event_id) OVER w IS NULL OR lead(event_id) OVER w IS NULL AS stays
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
s AS (SELECT event_id, next, lead(event_id) OVER w AS upto, lead(nth) OVER w - nth AS n_edges FROM p WHERE stays WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT 'events' AS network_id, event_id AS "from", upto AS "to", (upto - event_id)::DOUBLE AS weight, next AS first, upto AS last, n_edges FROM s WHERE upto IS NOT NULL""",
    "peeled_leaves": """SELECT 'events' AS network_id, event_id AS index FROM events
JOIN (SELECT user_id, min(event_id) AS a, max(event_id) AS b FROM events WHERE event_type <> 'click' GROUP BY user_id) USING (user_id) WHERE event_id BETWEEN a AND b""",
    "spanning_network": f"WITH RECURSIVE {_DNA}, {_HAPS}, {_dist(64, _AMB)}, {_links(0)} {_EDGES}",
    "total_excess": f"""WITH RECURSIVE {_MSN}, {_ENDS}, {_PATHS}
SELECT network_id, sum(length - d) AS excess FROM x JOIN d USING (network_id, i, j) GROUP BY ALL""",
    "excess_pairs": f"""WITH RECURSIVE {_MSN}, {_ENDS}, {_PATHS}
SELECT network_id, i, j, length - d AS excess, (row_number() OVER (PARTITION BY network_id ORDER BY length - d, i, j) - 1)::INT AS place FROM x JOIN d USING (network_id, i, j) WHERE length > d""",
    "shared_edges": f"WITH RECURSIVE {_MSN} SELECT network_id, least(a, b) AS a, greatest(a, b) AS b, min(index) AS edge FROM ed WHERE a <> b GROUP BY ALL",
    "vertex_degree": f"WITH RECURSIVE {_MSN}, {_ENDS} SELECT h.network_id, hap_idx AS index, count(DISTINCT edge) AS degree FROM h LEFT JOIN ends ON ends.network_id = h.network_id AND ends.vertex = h.hap_idx GROUP BY ALL",
    "incident_edges": f"WITH RECURSIVE {_MSN}, {_ENDS} SELECT * FROM ends",
    "feasible_triplets": f"""WITH RECURSIVE {_MSN} SELECT x.network_id, x.index AS edge, y.index AS previous, x.a AS u, x.b AS v, CASE WHEN y.a IN (x.a, x.b) THEN y.b ELSE y.a END AS w
FROM ed x JOIN ed y ON x.network_id = y.network_id AND x.index > y.index AND (y.a IN (x.a, x.b) OR y.b IN (x.a, x.b))""",
    "remove_vertex": f"""WITH RECURSIVE {_MSN} SELECT network_id, (row_number() OVER (PARTITION BY network_id ORDER BY index) - 1)::INT AS index, a - (a > 1)::INT AS "from", b - (b > 1)::INT AS "to", weight
FROM ed WHERE a <> 1 AND b <> 1""",
    "nj_q_matrix": f"WITH {_bin(NETWORK)}, {_HAPS}, {_dist(NETWORK)}, {_NJ} SELECT * FROM nq",
    "nj_first_pair": f"WITH {_bin(NETWORK)}, {_HAPS}, {_dist(NETWORK)}, {_NJ} SELECT network_id, i, j, q FROM nq QUALIFY row_number() OVER (PARTITION BY network_id ORDER BY q, i, j) = 1",
    "joining_branches": f"""WITH RECURSIVE {_bin(FEW)}, {_HAPS}, {_dist(FEW)}, {_TREES}, steps AS (SELECT *, n - len(d) - 1 AS r FROM tr)
SELECT network_id, (2 * r)::INT AS branch, (n + r)::INT AS "from", nb::INT AS "to", round(lb, 6) AS weight FROM steps WHERE na >= 0
UNION ALL SELECT network_id, (2 * r + 1)::INT, (n + r)::INT, na::INT, round(la, 6) FROM steps WHERE na >= 0
UNION ALL SELECT network_id, (2 * n - 4)::INT, nodes[1]::INT, nodes[2]::INT, round(d[2][1], 6) FROM steps WHERE len(d) = 2""",
    "pair_buckets": f'WITH {_bin(NETWORK)}, {_HAPS}, {_dist(NETWORK)} SELECT network_id, j AS "from", i AS "to", d AS weight, (dense_rank() OVER (PARTITION BY network_id ORDER BY d) - 1)::INT AS bucket FROM d',
    "pie_angles": f"""WITH {_EV}, pos AS (SELECT * FROM ht WHERE count > 0), z AS (SELECT hap_idx, trait_idx, count, sum(count) OVER (PARTITION BY hap_idx ORDER BY trait_idx ROWS UNBOUNDED PRECEDING) AS upto, sum(count) OVER (PARTITION BY hap_idx) AS total FROM pos)
SELECT 'events' AS network_id, hap_idx, trait_idx, round(2 * pi() * (upto - count) / total - pi() / 2, 6) AS start, round(2 * pi() * upto / total - pi() / 2, 6) AS stop FROM z""",
    "vertex_radius": f"WITH {_PLACED} SELECT network_id, index, round(radius, 6) AS radius FROM v",
    "graph_bounds": f"WITH {_PLACED} SELECT network_id, round(min(x - radius), 5) AS min_x, round(min(y - radius), 5) AS min_y, round(max(x + radius), 5) AS max_x, round(max(y + radius), 5) AS max_y FROM v GROUP BY ALL",
    "nucleotide_classes": f"""WITH {_DNA}, {_MASK} SELECT network_id, site, CASE WHEN NOT keep THEN 'gap' WHEN state = 'A' THEN 'a' WHEN state = 'T' THEN 't' WHEN state = 'G' THEN 'g' WHEN state = 'C' THEN 'c' ELSE 'gap' END AS cls, count(*) AS n
FROM s JOIN m USING (network_id, site) GROUP BY ALL""",
}
