"""Nexus text: a parser, a data source `nexus`, and tables of its blocks."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.states import datatype
from ..session import ship


class NexusError(ValueError):
    """The text isn't Nexus that can be used."""


@dataclass
class Characters:
    nchar: float | None = None
    datatype: str | None = None
    missing: str | None = None
    gap: str | None = None
    matrix: dict[str, str] = field(default_factory=dict)


@dataclass
class Traits:
    ntraits: float = 0
    labels: list[str] = field(default_factory=list)
    latitude: list[float] = field(default_factory=list)
    longitude: list[float] = field(default_factory=list)
    matrix: dict[str, list[float]] = field(default_factory=dict)


@dataclass
class GeoTags:
    nclusts: float = 0
    labels: list[str] = field(default_factory=list)
    latitude: list[float] = field(default_factory=list)
    longitude: list[float] = field(default_factory=list)
    rows: list[tuple[str, float, float, float]] = field(default_factory=list)


@dataclass
class Network:
    vertices: list[tuple[int, float, float]] = field(default_factory=list)
    edges: list[tuple[int, int, int, float]] = field(default_factory=list)
    vlabels: list[tuple[int, float, float]] = field(default_factory=list)


@dataclass
class Document:
    """Blocks of one Nexus text; a block that isn't there is None."""

    taxa: list[str] | None = None
    characters: Characters | None = None
    traits: Traits | None = None
    geotags: GeoTags | None = None
    trees: list[str] | None = None
    network: Network | None = None

    def ordered_taxa(self) -> list[str]:
        return self.taxa or list(self.characters.matrix if self.characters else ())


# One scan serves comments, quotes and statement ends. A comment keeps its line breaks, since matrix rows are lines.
_LEXEME = re.compile(r"""(?P<quoted>"[^"]*(?:"|\Z)|'[^']*(?:'|\Z))|(?P<comment>\[[^\]]*(?:\]|\Z))|(?P<end>;)|(?P<plain>[^"'\[;]+)""")
_TOKEN = re.compile(r"""(?:"[^"]*(?:"|\Z)|'[^']*(?:'|\Z)|[^\s"'])+""")
_HEADER = re.compile(r"\s*#nexus\b[^\r\n]*", re.I)
_COORDINATE = re.compile(r"(-?\d+(?:\.\d+)?)([NSEW])?", re.I)
#: Separators by keyword.
_SEPARATORS = {"comma": ",", "tab": "\t"}


def _statements(text: str) -> Iterator[str]:
    now: list[str] = []
    for m in _LEXEME.finditer(text):
        if m.lastgroup == "comment":
            now.append(re.sub(r"[^\r\n]", "", m[0]))
        elif m.lastgroup == "end":
            yield "".join(now).strip()
            now = []
        else:
            now.append(m[0])
    yield "".join(now).strip()


def _bare(token: str) -> str:
    """Without one closing semicolon or comma and without quotes around it."""
    t = re.sub(r"[;,]$", "", token.strip())
    return t[1:-1].strip() if len(t) > 1 and t[0] in "\"'" and t[-1] == t[0] else t


def _tokens(text: str) -> list[str]:
    return [t for t in map(_bare, _TOKEN.findall(text))]


def _settings(text: str) -> dict[str, str]:
    found = {}
    for token in _tokens(re.sub(r"\s*=\s*", "=", text)):
        key, eq, value = token.partition("=")
        found[key.lower()] = _bare(value) if eq else "true"
    return found


def number(text: str) -> float:
    """A number, or NaN for text that is none; empty counts as 0."""
    t = text.strip()
    try:
        return float(t) if t else 0.0
    except ValueError:
        return float("nan")


def _lines(text: str) -> list[str]:
    return [x for x in (line.strip() for line in re.split(r"\r?\n", text)) if x]


def _labelled(row: str) -> tuple[str, str]:
    """Label and rest of a matrix row."""
    row = re.sub(r",$", "", row).strip()
    if row[:1] in ("'", '"'):
        end = row.find(row[0], 1)
        if end < 0:
            raise NexusError("A quoted taxon name has no closing quote.")
        return row[1:end].strip(), row[end + 1 :].strip()
    name, *rest = row.split(None, 1) or [""]
    return name, rest[0].strip() if rest else ""


def coordinate(text: str) -> float:
    m = _COORDINATE.fullmatch(text.strip())
    if not m:
        raise NexusError(f'Invalid coordinate "{text}".')
    value = float(m[1])
    return -abs(value) if (m[2] or "").lower() in ("s", "w") else value


class _Reader:
    """Takes statements one by one; state that lasts beyond a statement lives here."""

    def __init__(self) -> None:
        self.doc, self.block = Document(), None
        self.match, self.missing = ".", "?"
        self.labels = {"traits": False, "geotags": False}
        self.separator = {"traits": " ", "geotags": " "}

    def add_taxon(self, name: str) -> None:
        if self.doc.taxa is None:
            self.doc.taxa = []
        if name not in self.doc.taxa:
            self.doc.taxa.append(name)

    def take(self, statement: str) -> None:
        m = re.match(r"""("[^"]+"|'[^']+'|[^\s=]+)\s*(.*)""", statement, re.S)
        if not m:
            return
        word, rest = re.sub(r"[;,]$", "", m[1]).lower(), m[2]
        if word == "begin":
            name = ([*_tokens(rest), ""])[0].lower()
            self.block = {"data": "characters"}.get(name, name)
            made = {"taxa": list, "characters": Characters, "traits": Traits, "geotags": GeoTags, "trees": list, "network": Network}.get(self.block)
            if made and getattr(self.doc, self.block) is None:
                setattr(self.doc, self.block, made())
        elif word in ("end", "endblock"):
            self.block = None
        elif self.block and (handler := getattr(self, f"{self.block}_{word}", None) or getattr(self, f"any_{word}", None)):
            handler(rest if word != "tree" else statement)

    def any_taxlabels(self, rest: str) -> None:
        if self.block in ("taxa", "characters", "traits", "geotags", "trees", "network"):
            for name in _tokens(rest):
                self.add_taxon(name)

    def taxa_dimensions(self, rest: str) -> None:
        if "ntax" in _settings(rest) and self.doc.taxa is None:
            self.doc.taxa = []

    def characters_dimensions(self, rest: str) -> None:
        if "nchar" in (s := _settings(rest)):
            self.doc.characters.nchar = number(s["nchar"])

    def characters_format(self, rest: str) -> None:
        s, c = _settings(rest), self.doc.characters
        c.datatype = s["datatype"].lower() if "datatype" in s else c.datatype
        c.missing, c.gap = s.get("missing", c.missing), s.get("gap", c.gap)
        self.match = s.get("match", s.get("matchchar", self.match))

    def characters_matrix(self, rest: str) -> None:
        matrix, order, last = self.doc.characters.matrix, [], None
        for row in _lines(rest):
            name, seq = _labelled(row)
            if not name:
                continue
            seq = "".join(seq.split())
            if not seq and last:  # a line of one word goes on with the taxon before it
                name, seq = last, "".join(row.split())
            if not seq:
                raise NexusError(f'No sequence found for taxon "{name}".')
            self.add_taxon(name)
            if name not in matrix:
                order.append(name)
            matrix[name] = matrix.get(name, "") + seq
            last = name
        if order and self.match:
            top = matrix[order[0]]
            for name in order[1:]:
                matrix[name] = "".join(top[i] if c == self.match and i < len(top) else c for i, c in enumerate(matrix[name]))

    def traits_dimensions(self, rest: str) -> None:
        if "ntraits" in (s := _settings(rest)):
            self.doc.traits.ntraits = number(s["ntraits"])

    def _rows_format(self, rest: str) -> dict[str, str]:
        s = _settings(rest)
        if "labels" in s:
            self.labels[self.block] = s["labels"].lower() == "yes"
        if "separator" in s:
            self.separator[self.block] = _SEPARATORS.get(s["separator"].lower(), " ")
        return s

    def traits_format(self, rest: str) -> None:
        self.missing = self._rows_format(rest).get("missing", self.missing)

    def geotags_format(self, rest: str) -> None:
        self._rows_format(rest)

    def traits_traitlabels(self, rest: str) -> None:
        self.doc.traits.labels = _tokens(rest)
        self.doc.traits.ntraits = self.doc.traits.ntraits or len(self.doc.traits.labels)

    def traits_traitlatitude(self, rest: str) -> None:
        self.doc.traits.latitude = [number(x) for x in _tokens(rest)]

    def traits_traitlongitude(self, rest: str) -> None:
        self.doc.traits.longitude = [number(x) for x in _tokens(rest)]

    def _rows(self, rest: str) -> Iterator[tuple[str, list[str]]]:
        """Taxon and values of each row: named rows, or rows in the order of the taxa."""
        named, by, taxa = self.labels[self.block], self.separator[self.block], self.doc.taxa
        if not named and taxa is None:
            return
        for k, row in enumerate(_lines(rest)):
            name, values = _labelled(row) if named else (taxa[k] if k < len(taxa) else "", row)
            if not name:
                raise NexusError(f"A row of the {self.block} matrix is missing a taxon name.")
            if taxa is not None and name not in taxa:
                raise NexusError(f'Taxon "{name}" of the {self.block} block is not defined.')
            # Empty cells fall out, so that values after them move left.
            yield name, _tokens(values) if by == " " else [x for x in map(str.strip, values.split(by)) if x]

    def traits_matrix(self, rest: str) -> None:
        for name, values in self._rows(rest):
            self.doc.traits.matrix[name] = [0.0 if v == self.missing else number(v) for v in values]

    def geotags_dimensions(self, rest: str) -> None:
        if "nclusts" in (s := _settings(rest)):
            self.doc.geotags.nclusts = number(s["nclusts"])

    def geotags_clustlabels(self, rest: str) -> None:
        self.doc.geotags.labels = _tokens(rest)

    def geotags_clustlatitude(self, rest: str) -> None:
        self.doc.geotags.latitude = [number(x) for x in _tokens(rest)]

    def geotags_clustlongitude(self, rest: str) -> None:
        self.doc.geotags.longitude = [number(x) for x in _tokens(rest)]

    def geotags_matrix(self, rest: str) -> None:
        for name, values in self._rows(rest):
            if len(values) < 2:
                raise NexusError(f'The row of "{name}" is missing coordinates.')
            self.doc.geotags.rows.append((name, coordinate(values[0]), coordinate(values[1]), number(values[2]) if len(values) > 2 else 1.0))

    def trees_tree(self, statement: str) -> None:
        if "=" in statement:
            self.doc.trees.append(statement.partition("=")[2].strip())

    def _numbers(self, rest: str, least: int, most: int, default: tuple[float, ...] = ()) -> list[list[float]]:
        found = []
        for row in _lines(rest):
            row = re.sub(r",$", "", row).strip()
            values = [number(x) for x in _tokens(row)][:most]
            values += default[len(values) - least :] if len(values) >= least else ()
            if len(values) < most or not all(abs(v) < float("inf") for v in values):
                raise NexusError(f'Invalid descriptor "{row}".')
            found.append(values)
        return found

    def network_vertices(self, rest: str) -> None:
        self.doc.network.vertices = [(int(i), x, y) for i, x, y in self._numbers(rest, 3, 3)]

    def network_vlabels(self, rest: str) -> None:
        self.doc.network.vlabels = [(int(i), x, y) for i, x, y in self._numbers(rest, 3, 3)]

    def network_edges(self, rest: str) -> None:
        self.doc.network.edges = [(int(i), int(a), int(b), w) for i, a, b, w in self._numbers(rest, 3, 4, (1.0,))]


def parse(text: Any) -> Document:
    """The blocks of a Nexus text. It must begin with #nexus and have sequences."""
    if not isinstance(text, str):
        raise NexusError("Expected Nexus input as a plain text string.")
    reader, first = _Reader(), True
    for statement in _statements(text):
        if first:
            header = _HEADER.match(statement + "\n")
            if not header:
                raise NexusError("No Nexus header found.")
            statement, first = statement[header.end() :].strip(), False
        reader.take(statement)
    doc = reader.doc
    if doc.taxa is None and doc.characters is None:
        raise NexusError("A Nexus file must include TAXA and/or CHARACTERS/DATA blocks.")
    if doc.characters is None:
        raise NexusError("A Nexus file must include a CHARACTERS or DATA block.")
    return doc


# ---- Spark

#: Tables of a set of Nexus files: DDL, and how a document fills them.
TABLES: dict[str, str] = {
    "taxa": "dataset_id string, taxon_idx int, taxon string",
    "characters": "dataset_id string, taxon_idx int, taxon string, seq string",
    "characters_meta": "dataset_id string, nchar int, datatype string, missing string, gap string",
    "trait_labels": "dataset_id string, trait_idx int, label string, lat double, lng double",
    "traits": "dataset_id string, taxon string, trait_idx int, count double",
    "geotags": "dataset_id string, row_idx int, taxon string, lat double, lng double, samples double",
    "geo_clusters": "dataset_id string, clust_idx int, label string, lat double, lng double",
    "trees": "dataset_id string, tree_idx int, newick string",
    "net_vertices": "dataset_id string, id int, x double, y double",
    "net_vlabels": "dataset_id string, id int, x double, y double",
    "net_edges": "dataset_id string, id int, `from` int, `to` int, weight double",
}


def _at(values: list, i: int) -> Any:
    return values[i] if i < len(values) else None


def rows_of(table: str, dataset_id: str, doc: Document) -> list[tuple]:
    """Rows of one table from one document; a block that isn't there has none."""
    d, taxa = dataset_id, doc.ordered_taxa()
    c, t, g, n = doc.characters, doc.traits, doc.geotags, doc.network
    if table == "taxa":
        return [(d, i, x) for i, x in enumerate(taxa)]
    if table == "characters":
        return [(d, i, x, c.matrix.get(x)) for i, x in enumerate(taxa)]
    if table == "characters_meta":
        return [(d, None if c.nchar is None or c.nchar != c.nchar else int(c.nchar), c.datatype, c.missing, c.gap)]
    if table in ("trait_labels", "traits"):
        if t is None:
            return []
        if table == "traits":
            return [(d, x, i, v) for x, values in t.matrix.items() for i, v in enumerate(values)]
        labels = t.labels or [f"Trait {i + 1}" for i in range(int(t.ntraits))]
        return [(d, i, x, _at(t.latitude, i), _at(t.longitude, i)) for i, x in enumerate(labels)]
    if table == "geotags":
        return [(d, i, *r) for i, r in enumerate(g.rows)] if g else []
    if table == "geo_clusters":
        return [(d, i, x, _at(g.latitude, i), _at(g.longitude, i)) for i, x in enumerate(g.labels)] if g else []
    if table == "trees":
        return [(d, i, x) for i, x in enumerate(doc.trees or ())]
    if table in ("net_vertices", "net_vlabels", "net_edges"):
        return [(d, *r) for r in getattr(n, table.removeprefix("net_"))] if n else []
    raise ValueError(f"no table {table}")


class _Files(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _NexusReader(DataSourceReader):
    def __init__(self, options: dict, table: str) -> None:
        self.options, self.table = options, table

    def partitions(self) -> list[InputPartition]:
        import pyarrow.fs as pafs

        fs, top = pafs.FileSystem.from_uri(p if "://" in (p := self.options["path"]) else f"file://{p}")
        info = fs.get_file_info(top)
        names = [top] if info.is_file else [f.path for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if f.is_file and f.path.lower().endswith((".nex", ".nexus"))]
        return [_Files(x) for x in sorted(names)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        import pyarrow.fs as pafs

        fs, _ = pafs.FileSystem.from_uri(p if "://" in (p := self.options["path"]) else f"file://{p}")
        with fs.open_input_stream(partition.path) as f:
            doc = parse(f.read().decode("utf-8"))
        name = re.sub(r"\.(nex|nexus)$", "", partition.path.rsplit("/", 1)[-1], flags=re.I)
        yield from rows_of(self.table, name, doc)


class NexusDataSource(DataSource):
    """spark.read.format("nexus").option("table", t).load(path): a file or a folder of .nex and .nexus files, one task each."""

    @classmethod
    def name(cls) -> str:
        return "nexus"

    def _table(self) -> str:
        return self.options.get("table", "characters")

    def schema(self) -> str:
        return TABLES[self._table()]

    def reader(self, schema: Any) -> DataSourceReader:
        return _NexusReader(dict(self.options), self._table())


def read_nexus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """All tables of the Nexus files at path, by name."""
    ship(spark).dataSource.register(NexusDataSource)
    return {t: spark.read.format("nexus").option("table", t).load(path) for t in TABLES}


def parse_texts(texts: DataFrame, table: str) -> DataFrame:
    """texts(dataset_id, text) -> one of TABLES. Each text is parsed in its task; a broken one fails the job."""
    ship(texts.sparkSession)

    def run(batches: Iterator) -> Iterator:
        names = [f.split()[0].strip("`") for f in TABLES[table].split(", ")]
        for pdf in batches:
            rows = [r for d, t in zip(pdf["dataset_id"], pdf["text"], strict=True) for r in rows_of(table, d, parse(t))]
            yield pd.DataFrame(rows, columns=names).astype(object)

    return texts.select("dataset_id", "text").mapInPandas(run, TABLES[table])


def nexus_text(taxa: list[Row], datatype: str = "DNA") -> str:
    """A minimal Nexus text of rows with taxon and seq."""
    width = len(taxa[0]["seq"]) if taxa else 0
    body = "\n".join(f"'{r['taxon']}' {r['seq']}" for r in taxa)
    return f"#NEXUS\nBEGIN DATA;\nDIMENSIONS NTAX={len(taxa)} NCHAR={width};\nFORMAT DATATYPE={datatype} MISSING=? GAP=-;\nMATRIX\n{body}\n;\nEND;\n"


def alignment(tables: dict[str, DataFrame]) -> DataFrame:
    """(network_id, taxon_idx, taxon, seq, datatype) of read_nexus()'s tables, a network for each data set.

    datatype as the plans know it, of the table characters_meta; without that table there is no such column.
    """
    out = tables["characters"].select(F.col("dataset_id").alias("network_id"), "taxon_idx", "taxon", F.upper("seq").alias("seq"))
    if "characters_meta" not in tables:
        return out
    kinds = tables["characters_meta"].select(F.col("dataset_id").alias("network_id"), datatype(F.col("datatype")).alias("datatype"))
    return out.join(kinds, "network_id", "left").withColumn("datatype", F.coalesce("datatype", F.lit("dna")))
