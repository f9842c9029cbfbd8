"""Project documents (one JSON object per network), a slot for the latest state, edge lists, snapshots."""

from __future__ import annotations

import json
import os
import re
import time
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .drawing import DEFAULTS, merged

#: The document's version, its file extension.
VERSION, EXTENSION = 1, "hapnet"
_VERTEX = "index int, label string, x double, y double, radius double, colour string, marked boolean, info struct<`index`:int,name:string,sequence:string,frequency:double,traits:array<double>,inferred:boolean,sampled:boolean,originalIndex:int>"
_EDGE = "index int, `from` int, `to` int, weight double, colour string, marked boolean"
#: What Spark reads of a document; the settings stay text.
SCHEMA = f"version int, savedAt string, originalFilename string, algorithm string, algorithmParams struct<epsilon:double,alpha:double>, graph struct<vertices:array<struct<{_VERTEX.replace(' struct', ':struct').replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>,edges:array<struct<{_EDGE.replace(' int', ':int').replace(' string', ':string').replace(' double', ':double').replace(' boolean', ':boolean')}>>>, maskedSites int, maskedSiteIndices array<int>"


def build_state(vertices: list[dict[str, Any]], edges: list[dict[str, Any]], algorithm: str = "MJN", params: dict[str, float] | None = None, options: dict[str, Any] | None = None, filename: str | None = None, parsed: dict[str, Any] | None = None, masked: list[int] | None = None, trait_names: list[str] | None = None, saved_at: datetime | None = None) -> dict[str, Any]:
    """The document of one network. The settings stand in it twice, under both names that readers look for."""
    when = (saved_at or datetime.now(UTC)).astimezone(UTC)
    visual = merged(options)
    sampled = sum(not (v.get("info") or {}).get("inferred", v.get("inferred", False)) for v in vertices)
    return {
        "version": VERSION, "savedAt": when.strftime("%Y-%m-%dT%H:%M:%S.") + f"{when.microsecond // 1000:03d}Z", "originalFilename": filename, "parsedNexus": parsed,
        "algorithm": algorithm, "algorithmParams": {"epsilon": 0, "alpha": 0.5, **(params or {})}, "graph": {"vertices": vertices, "edges": edges},
        "visual": visual, "visualOptions": visual, "maskedSites": len(masked or []), "maskedSiteIndices": list(masked or []), "hapNet": {"nseqs": sampled, "traitNames": list(trait_names or [])},
    }


def restore_state(state: dict[str, Any]) -> dict[str, Any]:
    """A read document with what is missing filled in: defaults, vertices and edges in index order, weights of 1."""
    graph = state.get("graph") or {"vertices": [], "edges": []}
    vertices = sorted(graph.get("vertices") or [], key=lambda v: v.get("index", 0))
    edges = [{**e, "weight": e["weight"] if e.get("weight") is not None else 1} for e in sorted(graph.get("edges") or [], key=lambda e: e.get("index", 0))]
    options = merged(state.get("visualOptions") or state.get("visual") or {}, DEFAULTS)
    masked = state.get("maskedSiteIndices") or []
    return {**state, "algorithm": state.get("algorithm") or "MJN", "algorithmParams": {"epsilon": 0, "alpha": 0.5, **(state.get("algorithmParams") or {})}, "graph": {"vertices": vertices, "edges": edges}, "visual": options, "visualOptions": options, "maskedSites": state.get("maskedSites", len(masked)), "maskedSiteIndices": masked, "hapNet": state.get("hapNet") or {"nseqs": sum(not (v.get("info") or {}).get("inferred", False) for v in vertices), "traitNames": []}}


def suggested_name(filename: str | None) -> str:
    base = re.split(r"[\\/]", (filename or "network").strip())[-1] or "network"
    return f"{re.sub(r'[.][^.]*$', '', base) or 'network'}.{EXTENSION}"


def write_project(state: dict[str, Any], path: str) -> str:
    """Write a document; the file is whole or isn't there."""
    part = f"{path}.part"
    try:
        with open(part, "w", encoding="utf-8") as f:
            json.dump(state, f, indent=2, ensure_ascii=False)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path


def read_project(path: str) -> dict[str, Any]:
    with open(path, encoding="utf-8") as f:
        return restore_state(json.load(f))


def route(path: str) -> str:
    """nexus (.nex) or project by the file's ending, in any case; others can't be opened."""
    low = path.lower()
    if low.endswith(".nex"):
        return "nexus"
    if low.endswith(f".{EXTENSION}"):
        return "project"
    raise ValueError(f"Unsupported file: {path}")


class Autosave:
    """One slot in a folder: each save replaces it. keep() saves once every `period` seconds."""

    def __init__(self, folder: str, period: float = 300.0) -> None:
        self.path, self.period, self._last = os.path.join(folder, f"autosave.{EXTENSION}"), period, time.monotonic()

    def keep(self, state: dict[str, Any]) -> bool:
        """Save a state that has a graph if the period has passed since the last such save; whether it did."""
        if not state.get("graph") or time.monotonic() - self._last < self.period:
            return False
        self.save(state)
        self._last = time.monotonic()
        return True

    def save(self, state: dict[str, Any]) -> None:
        write_project(state, self.path)

    def load(self) -> dict[str, Any] | None:
        return read_project(self.path) if self.exists() else None

    def exists(self) -> bool:
        return os.path.exists(self.path)

    def clear(self) -> None:
        if self.exists():
            os.remove(self.path)


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of a folder as (projects, vertices, edges) DataFrames, a network for each file."""
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)\.[^./]*$", 1)
    docs = spark.read.schema(SCHEMA).option("multiLine", True).option("pathGlobFilter", f"*.{EXTENSION}").json(path).withColumn("network_id", name)
    vertices = docs.select("network_id", F.inline("graph.vertices"))
    edges = docs.select("network_id", F.inline("graph.edges")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return docs.drop("graph"), vertices, edges


def project_documents(vertices: DataFrame, edges: DataFrame, algorithm: str = "MJN") -> DataFrame:
    """(network_id, json): the graph of each network as a document's text, lists in index order, made by Catalyst alone."""
    v = [c for c in vertices.columns if c != "network_id"]
    e = [c for c in edges.columns if c != "network_id"]
    left = vertices.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("index", *(c for c in v if c != "index")))).alias("vertices"))
    right = edges.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("index", *(c for c in e if c != "index")))).alias("edges"))
    both = left.join(right, "network_id", "left")
    graph = F.struct("vertices", F.coalesce("edges", F.array().cast(right.schema["edges"].dataType)).alias("edges"))
    return both.select("network_id", F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(algorithm).alias("algorithm"), graph.alias("graph"))).alias("json"))


def edge_lines(labelled: DataFrame) -> DataFrame:
    """(network_id, edge_idx, line): from label, weight and to label between tabs."""
    return labelled.select("network_id", "edge_idx", F.concat_ws("\t", "from_label", F.col("weight").cast("string"), "to_label").alias("line"))


def write_edge_lists(labelled: DataFrame, path: str) -> None:
    """Text files of edge lines, a folder for each network, lines in edge order."""
    lines = edge_lines(labelled).repartition("network_id").sortWithinPartitions("network_id", "edge_idx")
    lines.select("network_id", "line").write.partitionBy("network_id").text(path)


class History:
    """Undo and redo of states, the last `most` of them."""

    def __init__(self, most: int = 20) -> None:
        self.most, self.undo_stack, self.redo_stack = most, [], []

    def record(self, state: Any) -> None:
        self.undo_stack = [*self.undo_stack, json.dumps(state)][-self.most :]
        self.redo_stack = []

    def undo(self, now: Any) -> Any:
        if not self.undo_stack:
            return now
        self.redo_stack.append(json.dumps(now))
        return json.loads(self.undo_stack.pop())

    def redo(self, now: Any) -> Any:
        if not self.redo_stack:
            return now
        self.undo_stack.append(json.dumps(now))
        return json.loads(self.redo_stack.pop())


def status(haplotypes: DataFrame, edges: DataFrame, mask: DataFrame) -> DataFrame:
    """(network_id, n_haplotypes, n_edges, n_masked)."""
    h = haplotypes.groupBy("network_id").agg(F.count("*").alias("n_haplotypes"))
    e = edges.groupBy("network_id").agg(F.count("*").alias("n_edges"))
    m = mask.groupBy("network_id").agg(F.count_if(~F.col("keep")).alias("n_masked"))
    out = h.join(e, "network_id", "left").join(m, "network_id", "left")
    return out.select("network_id", "n_haplotypes", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("n_masked", F.lit(0)).alias("n_masked"))


def model_snapshots(condensed: DataFrame, distances: DataFrame) -> DataFrame:
    """(network_id, json): haplotypes in order and distances (rows i > j), as stored or handed to a worker. Catalyst alone."""
    extra = [c for c in ("traits",) if c in condensed.columns]
    fields = ["hap_idx", "name", "pattern_seq", "seq", "originals", "frequency", *extra]
    haps = condensed.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("haplotypes"), F.first("weights").alias("site_weights"))
    pairs = distances.groupBy("network_id").agg(F.sort_array(F.collect_list(F.struct("i", "j", "d"))).alias("distances"))
    both = haps.join(pairs, "network_id", "left")
    return both.select("network_id", F.to_json(F.struct(F.size("haplotypes").alias("nseqs"), "haplotypes", "site_weights", "distances")).alias("json"))
