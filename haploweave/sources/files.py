"""A data source `networks`: a file for each network, written in two phases and read back.

Tasks write into folders of their own. The job's commit puts one small list of these folders in place by a rename, and
only listed folders are read: a job that fails, or an attempt whose result wasn't taken, leaves nothing that a reader sees,
and what it wrote is removed. The lists are numbered; one that overwrites ends those before it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any
from urllib.parse import quote, unquote

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from ..session import ship
from .project import EXTENSION, SCHEMA

COMMITS = "_commits"
#: Contents of files: whole documents or Nexus texts, one row each; or lines, the rows of a network in their order.
ENDINGS = {"project": EXTENSION, "nexus": "nex", "lines": "tsv"}


def _open(path: str) -> tuple[Any, str]:
    import pyarrow.fs as pafs

    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _listed(fs: Any, top: str, recursive: bool = False) -> list[Any]:
    import pyarrow.fs as pafs

    return sorted(fs.get_file_info(pafs.FileSelector(top, allow_not_found=True, recursive=recursive)), key=lambda f: f.path)


def _commits(fs: Any, top: str) -> list[dict[str, Any]]:
    """The lists that count, in their order: from the last that overwrites on."""
    found = []
    for f in _listed(fs, f"{top}/{COMMITS}"):
        if f.base_name.endswith(".json"):
            with fs.open_input_stream(f.path) as s:
                found.append({**json.loads(s.read()), "path": f.path})
    last = max((i for i, c in enumerate(found) if c["overwrite"]), default=0)
    return found[last:]


@dataclass
class _Wrote(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, path: str, content: str, overwrite: bool) -> None:
        self.path, self.content, self.overwrite, self.job = path, content, overwrite, uuid.uuid4().hex

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        fs, top = _open(self.path)
        task = TaskContext.get()
        folder, now, stream, done = f"part-{self.job}-{task.partitionId()}-{task.taskAttemptId()}", None, None, set()
        try:
            for row in iterator:
                name, text = row[0], row[-1]
                if name is None or text is None:
                    raise ValueError("A network without a name or a text can't be written.")
                if name != now or self.content != "lines":
                    if name in done:
                        raise ValueError(f"The rows of network {name} don't stand together, or there are two documents of it.")
                    if stream is not None:
                        stream.close()
                    if not done:
                        fs.create_dir(f"{top}/{folder}", recursive=True)
                    done.add(name)
                    now, stream = name, fs.open_output_stream(f"{top}/{folder}/{quote(str(name), safe=' ')}.{ENDINGS[self.content]}")
                if self.content == "project":
                    text = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
                stream.write((text + "\n" if self.content == "lines" else text).encode())
        finally:
            if stream is not None:
                stream.close()
        return _Wrote(folder, len(done))

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = _open(self.path)
        before = _listed(fs, f"{top}/{COMMITS}")
        number = 1 + max((int(f.base_name.split("-")[0]) for f in before if f.base_name.endswith(".json")), default=0)
        held = json.dumps({"overwrite": self.overwrite, "content": self.content, "folders": [m.folder for m in messages if m and m.files]})
        fs.create_dir(f"{top}/{COMMITS}", recursive=True)
        with fs.open_output_stream(f"{top}/{COMMITS}/{self.job}.part") as f:
            f.write(held.encode())
        fs.move(f"{top}/{COMMITS}/{self.job}.part", f"{top}/{COMMITS}/{number:09d}-{self.job}.json")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, top = _open(self.path)
        for f in _listed(fs, top):
            if f.base_name.startswith(f"part-{self.job}-"):
                fs.delete_dir(f.path)
        for f in _listed(fs, f"{top}/{COMMITS}"):
            if f.base_name == f"{self.job}.part":
                fs.delete_file(f.path)


class _Folder(InputPartition):
    def __init__(self, folder: str, content: str) -> None:
        self.folder, self.content = folder, content


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Names asked for decide which files are opened."""
        for f in filters:
            names = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if names is None or f.attribute != ("network_id",):
                yield f
            else:
                self.wanted = names if self.wanted is None else self.wanted & names

    def partitions(self) -> list[InputPartition]:
        fs, top = _open(self.path)
        return [_Folder(x, c["content"]) for c in _commits(fs, top) for x in c["folders"]] or [_Folder("", "project")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.folder:
            return
        fs, top = _open(self.path)
        end = f".{ENDINGS[partition.content]}"
        for f in _listed(fs, f"{top}/{partition.folder}"):
            name = unquote(f.base_name.removesuffix(end))
            if self.wanted is not None and name not in self.wanted:
                continue
            with fs.open_input_stream(f.path) as s:
                text = s.read().decode()
            if partition.content != "lines":
                yield name, 0, text
            else:
                yield from ((name, i, line) for i, line in enumerate(text.split("\n")[:-1]))


class NetworkFiles(DataSource):
    """df.write.format("networks").option("content", "project" | "nexus" | "lines").mode("append" | "overwrite").save(folder), of rows
    whose first column is the network's name and whose last one is a document or a line; spark.read.format("networks")."""

    @classmethod
    def name(cls) -> str:
        return "networks"

    def schema(self) -> str:
        return "network_id string, line_idx int, text string"

    def writer(self, schema: Any, overwrite: bool) -> DataSourceWriter:
        content = self.options.get("content", "project")
        if content not in ENDINGS:
            raise ValueError(f"no content {content}")
        return _Writer(self.options["path"], content, overwrite)

    def reader(self, schema: Any) -> DataSourceReader:
        return _Reader(self.options["path"])


def registered(spark: SparkSession) -> SparkSession:
    """The session with the data source; Spark asks for the setting where a reader takes filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    ship(spark).dataSource.register(NetworkFiles)
    return spark


def write_projects(documents: DataFrame, path: str, overwrite: bool = False) -> None:
    """documents(network_id, json) -> a pretty-printed document for each network, all of them or none."""
    registered(documents.sparkSession)
    rows = documents.select(F.col("network_id").cast("string").alias("network_id"), F.lit(0).alias("line_idx"), F.col("json").alias("text"))
    rows.repartition("network_id").write.format("networks").mode("overwrite" if overwrite else "append").save(path)


def write_texts(texts: DataFrame, path: str, overwrite: bool = False) -> None:
    """texts(dataset_id, text) -> a Nexus file for each, all of them or none."""
    registered(texts.sparkSession)
    rows = texts.select(F.col("dataset_id").cast("string").alias("network_id"), F.lit(0).alias("line_idx"), "text")
    rows.repartition("network_id").write.format("networks").option("content", "nexus").mode("overwrite" if overwrite else "append").save(path)


def write_lines(lines: DataFrame, path: str, overwrite: bool = False) -> None:
    """lines(network_id, edge_idx, line) -> an edge list for each network, lines in their order, all of them or none."""
    registered(lines.sparkSession)
    rows = lines.select(F.col("network_id").cast("string").alias("network_id"), F.col("edge_idx").cast("int").alias("line_idx"), F.col("line").alias("text"))
    rows.repartition("network_id").sortWithinPartitions("network_id", "line_idx").write.format("networks").option("content", "lines").mode("overwrite" if overwrite else "append").save(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(network_id, line_idx, text) of all files that were committed; lines without their breaks, documents whole."""
    return registered(spark).read.format("networks").load(path)


def graphs(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents of read_files() as (projects, vertices, edges), as project.read_projects() gives them."""
    docs = files.select("network_id", F.from_json("text", SCHEMA).alias("d")).select("network_id", "d.*")
    edges = docs.select("network_id", F.inline("graph.edges")).withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    return docs.drop("graph"), docs.select("network_id", F.inline("graph.vertices")), edges
