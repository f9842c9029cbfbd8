"""Networks' files: whole results or none."""

import json
import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from haploweave.sources import files, project

NAMES = ["a", "b/c", "d e", "%41", "ü"]


def documents(spark):
    v = spark.createDataFrame([(n, i, f"{n}{i}") for n in NAMES for i in range(3)], "network_id string, index int, label string")
    e = spark.createDataFrame([(n, i, i, i + 1, 1.5) for n in NAMES for i in range(2)], "network_id string, index int, `from` int, `to` int, weight double")
    return project.project_documents(v.repartition(4), e)


def shown(folder):
    return sorted(os.path.join(d, f)[len(str(folder)) + 1 :] for d, _, fs in os.walk(folder) for f in fs if not f.endswith(".crc"))


def test_round_trip(spark, tmp_path):
    docs, top = documents(spark), str(tmp_path / "out")
    files.write_projects(docs, top)
    back = files.read_files(spark, top)
    assert {r.network_id: json.loads(r.text) for r in back.collect()} == {r.network_id: json.loads(r.json) for r in docs.collect()}
    assert all(r.text.startswith('{\n  "version": 1') for r in back.collect())
    meta, v, e = files.graphs(back)
    assert meta.count() == 5 and v.count() == 15 and {(r["network_id"], r["from"], r["to"], r["weight"]) for r in e.collect()} == {(n, i, i + 1, 1.5) for n in NAMES for i in range(2)}
    files.write_projects(docs.where("network_id = 'a'").withColumn("network_id", F.lit("z")), top)
    assert sorted(r.network_id for r in files.read_files(spark, top).collect()) == sorted([*NAMES, "z"])
    files.write_projects(docs.where("network_id = 'a'"), top, overwrite=True)
    assert [r.network_id for r in files.read_files(spark, top).collect()] == ["a"]
    files.write_projects(docs.where("false"), top, overwrite=True)
    assert files.read_files(spark, top).count() == 0


def test_lines(spark, tmp_path):
    rows = [(n, i, f"x{i}\t{i}\ty") for n in NAMES for i in range(30)]
    lines = spark.createDataFrame(rows, "network_id string, edge_idx int, line string").repartition(7)
    files.write_lines(lines, str(tmp_path))
    assert sorted(map(tuple, files.read_files(spark, str(tmp_path)).collect())) == sorted(rows)


@pytest.mark.parametrize("bad", ["json", "twice", "null"])
def test_a_failing_task_leaves_nothing(spark, tmp_path, bad):
    docs, top = documents(spark), str(tmp_path)
    files.write_projects(docs.where("network_id = 'a'"), top)
    before = shown(tmp_path)
    last = F.lit("d e") if bad == "twice" else F.lit(None).cast("string") if bad == "null" else F.lit("q")
    extra = docs.where("network_id = 'd e'").select(last.alias("network_id"), F.lit("{broken" if bad == "json" else "{}").alias("json"))
    with pytest.raises(PySparkException):
        files.write_projects(docs.unionByName(extra), top, overwrite=True)
    assert shown(tmp_path) == before
    assert [r.network_id for r in files.read_files(spark, top).collect()] == ["a"]


def test_what_is_not_listed_is_not_read(spark, tmp_path):
    files.write_projects(documents(spark), str(tmp_path))
    os.makedirs(tmp_path / "part-lost-0-1")
    (tmp_path / "part-lost-0-1" / "x.hapnet").write_text("{}")
    assert files.read_files(spark, str(tmp_path)).count() == 5


def test_names_asked_for(spark, tmp_path):
    files.write_projects(documents(spark), str(tmp_path))
    found = files.read_files(spark, str(tmp_path))
    assert [r.network_id for r in found.where("network_id = 'b/c'").collect()] == ["b/c"]
    assert found.where("network_id IN ('a', 'ü', 'no') AND line_idx = 0").count() == 2
    assert found.where("network_id = 'a' AND network_id = 'd e'").count() == 0
    # A file that isn't asked for isn't opened.
    broken = next(os.path.join(d, f) for d, _, fs in os.walk(tmp_path) for f in fs if f == "a.hapnet")
    os.remove(broken)
    os.symlink("/nowhere", broken)
    assert found.where("network_id = 'b/c'").count() == 1
