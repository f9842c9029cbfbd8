"""Queries over sources and sinks: Nexus documents written from a table and read back, edge lists, project documents,
snapshots, and what any network must fulfil. Each has SQL that goes to the table directly."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.states import characters
from ..operators import alignment as A
from ..operators import charges as C
from ..operators import graph as G
from ..operators import history
from ..operators import paths
from ..shared import place
from ..sources import files, nexus, project, split
from . import build, layout
from . import queries as Q

#: Of the documents: trait labels, clusters of places.
TRAITS, CLUSTERS = ("North", "South", "Far East"), ("c1", "c2")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(dataset_id, text): a Nexus document for each network of queries.dna(), with every block.

    Names are quoted, sequences run over two lines and stand against the first one by match characters, comments hold
    semicolons, hemispheres are letters, and unknown counts are question marks.
    """
    rows = Q.dna(spark, folder)
    top = rows.where("taxon_idx = 0").select(F.col("network_id").alias("of"), F.col("seq").alias("top"))
    dotted = F.array_join(F.zip_with(characters("seq"), characters("top"), lambda c, t: F.when(c == t, ".").otherwise(c)), "")
    rows = rows.join(top, F.col("network_id").eqNullSafe(F.col("of"))).withColumn("seq", F.when(F.col("taxon_idx") == 0, F.col("seq")).otherwise(dotted))
    i, v = F.col("taxon_idx"), F.col("taxon").cast("long")
    name = F.concat(F.lit("'v "), "taxon", F.lit("'"))
    line = F.struct(
        "taxon_idx",
        name.alias("name"),
        F.concat(name, F.lit(" "), F.substring("seq", 1, 32), F.lit(" [; no end]\n"), F.expr("substring(seq, 33)")).alias("seq"),
        F.concat_ws(" ", name, F.concat_ws(",", v % 7, F.when(v % 5 == 0, "?").otherwise((v % 5).cast("string")), v % 3)).alias("traits"),
        F.concat_ws(" ", name, F.concat(v % 90, F.lit(".5S")), F.concat(v % 180, F.lit("E")), 1 + v % 4).alias("place"),
        F.concat_ws(" ", i + 1, i * 1.5, v % 10).alias("vertex"),
        F.concat_ws(" ", i + 1, i + 1, i + 2, v % 6).alias("edge"),
    )
    rows = rows.groupBy("network_id").agg(F.sort_array(F.collect_list(line)).alias("x"))
    of = lambda field, by: F.array_join(F.transform("x", lambda r: r[field]), by)
    quoted = " ".join(f"'{x}'" for x in TRAITS)
    parts = [
        F.lit("#NEXUS\n[made; to be read]\nBegin Taxa; Dimensions NTax="), F.size("x"), F.lit("; TaxLabels "), of("name", " "),
        F.lit("; End;\nBEGIN CHARACTERS;\n Dimensions NChar = 64;\n Format Datatype=DNA Missing=? Gap=- MatchChar=.;\nMatrix\n"), of("seq", "\n"),
        F.lit(f"\n;\nEnd;\nBegin Traits; Dimensions NTraits=3; Format labels=yes missing=? separator=Comma; TraitLatitude 1 2.5 -3; TraitLongitude 4 5 6; TraitLabels {quoted};\nMatrix\n"), of("traits", "\n"),
        F.lit(f"\n;\nEnd;\nBegin GeoTags; Dimensions NClusts=2; Format labels=yes separator=Spaces; ClustLabels {' '.join(CLUSTERS)}; ClustLatitude 7 8; ClustLongitude 9 -10;\nMatrix\n"), of("place", "\n"),
        F.lit("\n;\nEnd;\nBegin Trees; Translate 1 a; Tree t = ("), of("name", ","), F.lit("); End;\nBegin Network; Vertices\n"), of("vertex", ",\n"),
        F.lit("\n; Edges\n"), of("edge", ",\n"), F.lit("\n; VLabels\n1 3 4\n; End;\nBegin Unknown; Matrix x; End;\n"),
    ]
    return rows.select(F.col("network_id").cast("string").alias("dataset_id"), F.concat(*parts).alias("text"))


def _read(table: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return nexus.parse_texts(texts(spark, folder), table)

    query.__doc__ = f"The table {table} of the documents."
    return query


def nexus_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """The documents' sequences, by taxon, as the alignment that networks are made of."""
    docs = texts(spark, folder)
    found = nexus.alignment({"characters": nexus.parse_texts(docs, "characters")})
    return found.select("network_id", "taxon_idx", "taxon", "seq")


def datatypes(spark: SparkSession, folder: str) -> DataFrame:
    """Datatypes of documents, as the states of their sequences are read."""
    from ..functions.states import datatype

    names = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", F.element_at(F.array(*map(F.lit, ("DNA", "Standard", "PROTEIN", "binary", "AminoAcid", "rna", "aa"))), (F.col("vec_id") % 7 + 1).cast("int")).alias("name"))
    return names.select("vec_id", datatype(F.when(F.col("vec_id") % 11 != 0, F.col("name"))).alias("kind"))


def coordinates(spark: SparkSession, folder: str) -> DataFrame:
    """Decimal degrees with and without a hemisphere letter; null for what is none."""
    from ..functions.states import coordinate

    e = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id")
    text = F.concat(F.when(F.col("vec_id") % 3 == 0, "-").otherwise(" "), F.col("vec_id") % 90, F.element_at(F.array(*map(F.lit, ("", ".25", ".5N", "s", "w", "E", "x", ".")), ), (F.col("vec_id") % 8 + 1).cast("int")))
    return e.select("vec_id", (coordinate(text) + F.lit(0.0)).alias("degrees"))


def match_chars(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that stand against their network's first by match characters, written out: dots as the table has them."""
    from ..functions.states import expand_match

    rows = Q.dna(spark, folder).withColumn("seq", F.when(F.col("taxon_idx") == 0, F.col("seq")).otherwise(F.regexp_replace("seq", "[CT]", ".")))
    top = rows.where("taxon_idx = 0").select("network_id", F.col("seq").alias("top"))
    return rows.join(top, "network_id").select("network_id", "taxon_idx", expand_match(F.col("seq"), F.col("top")).alias("seq"))


def _labelled(spark: SparkSession, folder: str) -> DataFrame:
    haps = Q._haps(spark, folder, Q.MORE).select("network_id", F.col("hap_idx").alias("k"), "name")
    e = Q._msn(spark, folder)[1]
    e = e.join(haps.select("network_id", F.col("k").alias("from"), F.col("name").alias("from_label")), ["network_id", "from"])
    e = e.join(haps.select("network_id", F.col("k").alias("to"), F.col("name").alias("to_label")), ["network_id", "to"])
    return e.select("network_id", F.col("index").alias("edge_idx"), "from_label", "weight", "to_label")


def edge_lines(spark: SparkSession, folder: str) -> DataFrame:
    return project.edge_lines(_labelled(spark, folder))


def project_json(spark: SparkSession, folder: str) -> DataFrame:
    haps = Q._haps(spark, folder, Q.MORE).select("network_id", F.col("hap_idx").alias("index"), F.col("name").alias("label"))
    return project.project_documents(haps, Q._msn(spark, folder)[1], "MSN")


def project_graph(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of project documents, read back from their text."""
    made = project_json(spark, folder)
    state = F.from_json("json", "version int, graph struct<edges:array<struct<`index`:int,`from`:int,`to`:int,weight:double>>>")
    return made.select("network_id", state.alias("s")).where("s.version = 1").select("network_id", F.inline("s.graph.edges"))


def model_json(spark: SparkSession, folder: str) -> DataFrame:
    """Number of haplotypes, of distances and their sum in the snapshots of models."""
    made = project.model_snapshots(Q._condensed(spark, folder, Q.FEW), Q._distances(spark, folder, Q.FEW))
    state = F.from_json("json", "nseqs int, haplotypes array<struct<name:string,frequency:double>>, distances array<struct<i:int,j:int,d:long>>")
    s = made.select("network_id", state.alias("s"))
    total = F.aggregate("s.distances", F.lit(0).cast("long"), lambda a, x: a + x["d"])
    return s.select("network_id", F.col("s.nseqs").alias("nseqs"), F.array_join("s.haplotypes.name", ",").alias("names"), F.size("s.distances").alias("n_distances"), total.alias("sum_d"))


def network_status(spark: SparkSession, folder: str) -> DataFrame:
    haps = Q._haps(spark, folder, Q.MORE)
    return project.status(haps, Q._msn(spark, folder)[1], A.site_mask(Q.dna(spark, folder)))


def selected_vertices(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices in a rectangle, moved; all others as they were."""
    v = Q._placed(spark, folder)
    out = G.moved(v, G.within(v, 0.3, 0.2, -0.1, -0.2), 2.0, -1.0)
    return out.select("network_id", "index", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def ordered_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences joined to their taxa in order; those without a taxon stay out."""
    rows = Q.dna(spark, folder)
    taxa = rows.where("taxon_idx % 3 != 1").select("network_id", "taxon_idx", "taxon")
    return A.ordered_sequences(taxa, rows.select("network_id", "taxon", "seq"))


def _checked(algorithm: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, folder: str) -> DataFrame:
        haps = Q._condensed(spark, folder, Q.FEW)
        found = build.elements(haps, algorithm, kind="binary")
        v = build.vertices(found).select("network_id", "index", "hap_idx", "inferred")
        e = build.edges(found)
        d = Q._distances(spark, folder, Q.FEW).withColumn("network_id", F.col("network_id").cast("string"))
        lengths = paths.shortest_paths(v, e)
        # Statistical parsimony may join two haplotypes by fewer steps than they differ in, over vertices that others need.
        short = F.lit(False) if algorithm == "TCS" else F.col("length") < F.col("d")
        pairs = d.join(lengths, ["network_id", "i", "j"], "left").groupBy("network_id").agg(F.count_if(F.col("length").isNull()).alias("n_apart"), F.count_if(short).alias("n_short"))
        thin = G.degrees(v, e).join(v, ["network_id", "index"]).groupBy("network_id").agg(F.count_if(~F.col("inferred")).alias("n_sampled"), F.count_if(F.col("inferred") & (F.col("degree") < (3 if algorithm == "TCS" else 2))).alias("n_thin"))
        bad = e.groupBy("network_id").agg(F.count_if((F.col("weight") < 1) | (F.col("from") == F.col("to"))).alias("n_bad_edges"))
        out = thin.join(pairs, "network_id").join(bad, "network_id")
        return out.select("network_id", "n_sampled", "n_apart", "n_short", "n_thin", "n_bad_edges")

    query.__doc__ = f"""What {algorithm} networks must fulfil: all haplotypes are there, none apart, no path shorter than the distance (but for TCS), no inferred
    vertex that a line could replace (TCS) or that hangs alone, and no edge without length or on one vertex."""
    return query


def layout_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices laid out, and how many have no finite place, share one, or have another radius than their frequency's."""
    haps = Q._condensed(spark, folder, Q.FEW)
    found = build.elements(haps, "MSN", kind="binary")
    v = build.with_frequencies(build.vertices(found), haps)
    placed = layout.lay_out(v, build.edges(found))
    known = G.radii(v).select("network_id", "index", F.col("radius").alias("wanted"))
    off = F.abs(F.col("x")) + F.abs(F.col("y"))
    out = placed.join(known, ["network_id", "index"]).groupBy("network_id").agg(F.count("*").alias("n"), F.count_if(~(off < 1e9)).alias("n_lost"), (F.count("*") - F.count_distinct(F.round("x", 6), F.round("y", 6))).alias("n_shared"), F.count_if(F.abs(F.col("radius") - F.col("wanted")) > 1e-9).alias("n_radius"))
    return out


def layout_charges(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices whose charges act on each vertex, one by one or in cells, and their radii's sum: a vertex for each vector, placed
    by its first two components in the drawing of its label."""
    e = spark.read.parquet(f"{folder}/embeddings.parquet")
    x, y = (F.get("embedding", F.lit(k)).cast("double") * 1000 for k in (0, 1))
    v = e.select(F.col("label").alias("network_id"), F.col("vec_id").alias("index"), x.alias("x"), y.alias("y"), C.radius((F.col("vec_id") % 5).cast("double"), F.lit(False)).alias("radius"))
    return C.charges(v).select("network_id", "index", "n_met", F.round("radii_met", 3).alias("radii_met"))


def edit_history(spark: SparkSession, folder: str) -> DataFrame:
    """The version shown after each event (-1: the one at the start) and how many can be undone and redone: clicks and purchases edit, errors undo,
    views redo."""
    e = spark.read.parquet(f"{folder}/events.parquet")
    action = F.when(F.col("event_type").isin("click", "purchase"), "edit").when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "view", "redo")
    log = e.select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), "ts", history.kinds(action).alias("code"))
    shown = history.versions(log, ("ts",)).withColumnsRenamed({"key": "user_id", "id": "event_id"})
    return shown.withColumn("version", F.coalesce("version", F.lit(-1).cast("long")))


def project_files(spark: SparkSession, folder: str) -> DataFrame:
    """Edges of project documents that were written, a file for each network, and read back."""
    files.write_projects(project_json(spark, folder), to := place(spark, "projects"))
    return files.graphs(files.read_files(spark, to))[2].select("network_id", "index", "from", "to", "weight")


def edge_list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of edge lists that were written, a file for each network, and read back."""
    files.write_lines(edge_lines(spark, folder), to := place(spark, "edges"))
    return files.read_files(spark, to).select("network_id", F.col("line_idx").alias("edge_idx"), F.col("text").alias("line"))


def nexus_files(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of the documents, written as files and read in byte ranges. The file of vectors without a label has an empty name."""
    files.write_texts(texts(spark, folder).withColumn("dataset_id", F.coalesce("dataset_id", F.lit(""))), to := place(spark, "nexus"))
    return split.read_characters(spark, to).withColumn("dataset_id", F.nullif("dataset_id", F.lit("")))


_PLAIN = (nexus_alignment, datatypes, coordinates, match_chars, edge_lines, project_json, project_graph, model_json, network_status, selected_vertices, ordered_sequences, layout_checks, layout_charges, edit_history, project_files, edge_list_files, nexus_files)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f"nexus_{t}": _read(t) for t in nexus.TABLES} | {f.__name__: f for f in _PLAIN} | {f"{a.lower()}_checks": _checked(a) for a in build.ALGORITHMS}

# ---- the same in SQL

_V = "v AS (SELECT network_id::VARCHAR AS dataset_id, taxon_idx, 'v ' || taxon AS taxon, taxon::BIGINT AS n FROM t)"
_ROWS = f"WITH {Q._T}, {_V}"
_FEW = f"{Q._bin(Q.FEW)}, {Q._HAPS}, {Q._dist(Q.FEW)}"
_MET = f"WITH {_FEW} SELECT network_id::VARCHAR AS network_id, count(*) AS n_sampled, 0::BIGINT AS n_apart, 0::BIGINT AS n_short, 0::BIGINT AS n_thin, 0::BIGINT AS n_bad_edges FROM h GROUP BY ALL"

SQL: dict[str, str] = {
    "nexus_taxa": f"{_ROWS} SELECT dataset_id, taxon_idx, taxon FROM v",
    "nexus_characters": f"WITH {Q._DNA} SELECT network_id::VARCHAR AS dataset_id, taxon_idx, 'v ' || taxon AS taxon, seq FROM q",
    "nexus_characters_meta": f"{_ROWS} SELECT DISTINCT dataset_id, 64 AS nchar, 'dna' AS datatype, '?' AS missing, '-' AS gap FROM v",
    "nexus_trait_labels": f"{_ROWS} SELECT dataset_id, unnest([0, 1, 2]) AS trait_idx, unnest(['North', 'South', 'Far East']) AS label, unnest([1.0, 2.5, -3.0]::DOUBLE[]) AS lat, unnest([4, 5, 6]::DOUBLE[]) AS lng FROM (SELECT DISTINCT dataset_id FROM v)",
    "nexus_traits": f"{_ROWS} SELECT dataset_id, taxon, unnest([0, 1, 2]) AS trait_idx, unnest([n % 7, n % 5, n % 3]::DOUBLE[]) AS count FROM v",
    "nexus_geotags": f"{_ROWS} SELECT dataset_id, taxon_idx AS row_idx, taxon, -(n % 90 + 0.5)::DOUBLE AS lat, (n % 180)::DOUBLE AS lng, (1 + n % 4)::DOUBLE AS samples FROM v",
    "nexus_geo_clusters": f"{_ROWS} SELECT dataset_id, unnest([0, 1]) AS clust_idx, unnest(['c1', 'c2']) AS label, unnest([7, 8]::DOUBLE[]) AS lat, unnest([9, -10]::DOUBLE[]) AS lng FROM (SELECT DISTINCT dataset_id FROM v)",
    "nexus_trees": f"{_ROWS} SELECT dataset_id, 0 AS tree_idx, '(' || string_agg('''' || taxon || '''', ',' ORDER BY taxon_idx) || ')' AS newick FROM v GROUP BY dataset_id",
    "nexus_net_vertices": f"{_ROWS} SELECT dataset_id, (taxon_idx + 1)::INT AS id, (taxon_idx * 1.5)::DOUBLE AS x, (n % 10)::DOUBLE AS y FROM v",
    "nexus_net_vlabels": f"{_ROWS} SELECT DISTINCT dataset_id, 1 AS id, 3.0::DOUBLE AS x, 4.0::DOUBLE AS y FROM v",
    "nexus_net_edges": f'{_ROWS} SELECT dataset_id, (taxon_idx + 1)::INT AS id, (taxon_idx + 1)::INT AS "from", (taxon_idx + 2)::INT AS "to", (n % 6)::DOUBLE AS weight FROM v',
    "nexus_alignment": f"WITH {Q._DNA} SELECT network_id::VARCHAR AS network_id, taxon_idx, 'v ' || taxon AS taxon, seq FROM q",
    "datatypes": "SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN 'dna' WHEN vec_id % 7 IN (1, 3) THEN 'binary' WHEN vec_id % 7 IN (2, 4, 6) THEN 'aa' ELSE 'dna' END AS kind FROM embeddings",
    "coordinates": """SELECT vec_id, CASE WHEN vec_id % 8 IN (6, 7) THEN NULL ELSE (CASE WHEN vec_id % 8 IN (3, 4) OR vec_id % 3 = 0 THEN -1 ELSE 1 END) * (vec_id % 90
  + CASE vec_id % 8 WHEN 1 THEN 0.25 WHEN 2 THEN 0.5 ELSE 0 END) END::DOUBLE AS degrees FROM embeddings""",
    "match_chars": f"""WITH {Q._DNA}, top AS (SELECT network_id, site, state AS top FROM s WHERE taxon_idx = 0)
SELECT network_id, taxon_idx, string_agg(CASE WHEN state IN ('C', 'T') THEN top ELSE state END, '' ORDER BY site) AS seq FROM s JOIN top USING (network_id, site) GROUP BY ALL""",
    "edge_lines": f"""WITH RECURSIVE {Q._MSN} SELECT ed.network_id, index AS edge_idx, x.name || chr(9) || weight || chr(9) || y.name AS line
FROM ed JOIN h x ON x.network_id = ed.network_id AND x.hap_idx = a JOIN h y ON y.network_id = ed.network_id AND y.hap_idx = b""",
    "project_json": f"""WITH RECURSIVE {Q._MSN}, vs AS (SELECT network_id, string_agg('{{"index":' || hap_idx || ',"label":"' || name || '"}}', ',' ORDER BY hap_idx) AS x FROM h GROUP BY ALL),
es AS (SELECT network_id, string_agg('{{"index":' || index || ',"from":' || a || ',"to":' || b || ',"weight":' || weight || '}}', ',' ORDER BY index) AS x FROM ed GROUP BY ALL)
SELECT vs.network_id, '{{"version":1,"algorithm":"MSN","graph":{{"vertices":[' || vs.x || '],"edges":[' || coalesce(es.x, '') || ']}}}}' AS json FROM vs LEFT JOIN es USING (network_id)""",
    "project_graph": f'WITH RECURSIVE {Q._MSN} SELECT network_id, index, a AS "from", b AS "to", weight::DOUBLE AS weight FROM ed',
    "model_json": f"""WITH {_FEW}, dd AS (SELECT network_id, count(*)::INT AS n_distances, sum(d)::BIGINT AS sum_d FROM d GROUP BY ALL)
SELECT h.network_id, count(*)::INT AS nseqs, string_agg(name, ',' ORDER BY hap_idx) AS names, n_distances, sum_d FROM h JOIN dd ON dd.network_id = h.network_id GROUP BY ALL""",
    "network_status": f"""WITH RECURSIVE {Q._MSN}, dt AS (SELECT network_id, k, e[k + 1] AS x FROM t, (SELECT unnest(range(0, 64)) AS k)),
fl AS (SELECT network_id, k, bool_or(abs(x) < 0.001) AS bad FROM dt GROUP BY ALL), mk AS (SELECT network_id, CASE WHEN 100.0 * sum(bad::INT) / count(*) <= 5 THEN 0 ELSE sum(bad::INT) END::BIGINT AS n_masked FROM fl GROUP BY ALL)
SELECT h.network_id, count(*) AS n_haplotypes, (SELECT count(*) FROM ed WHERE ed.network_id = h.network_id) AS n_edges, any_value(n_masked) AS n_masked FROM h JOIN mk USING (network_id) GROUP BY h.network_id""",
    "selected_vertices": f"""WITH {Q._PLACED}, z AS (SELECT *, x BETWEEN -0.1 AND 0.3 AND y BETWEEN -0.2 AND 0.2 AS hit FROM v)
SELECT network_id, index, round(x + CASE WHEN hit THEN 2 ELSE 0 END, 6) AS x, round(y - CASE WHEN hit THEN 1 ELSE 0 END, 6) AS y FROM z""",
    "ordered_sequences": f"WITH {Q._DNA} SELECT network_id, taxon_idx, taxon, seq FROM q WHERE taxon_idx % 3 <> 1",
    "layout_charges": """WITH v AS (SELECT label AS network_id, vec_id AS index, 7.5 * sqrt(greatest(4.0 / 9, vec_id % 5)) AS r FROM embeddings WHERE isfinite(embedding[1]) AND isfinite(embedding[2]))
SELECT network_id, index, count(*) OVER w - 1 AS n_met, round(sum(r) OVER w - r, 3) AS radii_met FROM v WINDOW w AS (PARTITION BY network_id)""",
    "edit_history": """WITH RECURSIVE a AS (SELECT user_id, event_id, event_type AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST) AS k FROM events),
z AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::BIGINT AS now, []::BIGINT[] AS u, []::BIGINT[] AS r FROM (SELECT DISTINCT user_id FROM a)
 UNION ALL SELECT z.user_id, a.k, a.event_id, CASE WHEN t IN ('click', 'purchase') THEN a.event_id WHEN t = 'error' AND len(u) > 0 THEN u[-1] WHEN t = 'view' AND len(r) > 0 THEN r[-1] ELSE now END,
 CASE WHEN t IN ('click', 'purchase') THEN list_append(u, now)[-20:] WHEN t = 'error' THEN u[:-2] WHEN t = 'view' AND len(r) > 0 THEN list_append(u, now)[-20:] ELSE u END,
 CASE WHEN t IN ('click', 'purchase') THEN []::BIGINT[] WHEN t = 'error' AND len(u) > 0 THEN list_append(r, now) WHEN t = 'view' THEN r[:-2] ELSE r END
 FROM z JOIN a ON a.user_id IS NOT DISTINCT FROM z.user_id AND a.k = z.k + 1)
SELECT user_id, event_id, coalesce(now, -1) AS version, len(u)::INT AS n_undo, len(r)::INT AS n_redo FROM z WHERE k > 0""",
    "layout_checks": f"WITH {_FEW} SELECT network_id::VARCHAR AS network_id, count(*) AS n, 0::BIGINT AS n_lost, 0::BIGINT AS n_shared, 0::BIGINT AS n_radius FROM h GROUP BY ALL",
} | {f"{a.lower()}_checks": _MET for a in build.ALGORITHMS}
SQL["project_files"] = SQL["project_graph"].replace("SELECT network_id, index,", "SELECT network_id::VARCHAR AS network_id, index,")
SQL["edge_list_files"] = SQL["edge_lines"].replace("SELECT ed.network_id, index AS edge_idx,", "SELECT ed.network_id::VARCHAR AS network_id, index AS edge_idx,")
SQL["nexus_files"] = SQL["nexus_characters"]
