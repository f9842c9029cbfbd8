"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_given: list[str] = []


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and driver and executors are one machine (tests), a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        top = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="haploweave-"))
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def place(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which sweep() removes."""
    _given.append(path := f"{folder(spark)}/{label}-{uuid.uuid4().hex}")
    return path


def save(df: DataFrame, label: str = "graph") -> DataFrame:
    """Write to the shared folder and read again, so that a loop's plan stays short and lost executors cost little."""
    path = place(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what save() wrote, once nothing reads it."""
    if path := getattr(df, "_saved_at", None):
        _remove(df.sparkSession, path)


def sweep(spark: SparkSession) -> None:
    """Remove all that save() has put into the shared folder: call it when results are written."""
    for path in list(_given):
        _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    if path in _given:
        _given.remove(path)
