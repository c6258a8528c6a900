"""Folders of documents in, versioned index tables out."""

from __future__ import annotations

import json
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_folder(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """name, sha256, size, content of the files of one folder that match, without subfolders."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "false").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), "content")


def manifest_diff(now: DataFrame, before: DataFrame) -> DataFrame:
    """name and state (unchanged, changed, new, removed) of files (name, sha256) against a former manifest."""
    b = before.select("name", F.col("sha256").alias("old"))
    state = F.when(F.col("sha256").isNull(), "removed").when(F.col("old").isNull(), "new").when(F.col("old") == F.col("sha256"), "unchanged").otherwise("changed")
    return now.select("name", "sha256").join(b, "name", "full_outer").select("name", state.alias("state"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records; none where the file is missing, nulls where a record doesn't fit."""
    try:
        return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


SCHEMA_VERSION = 1


class IndexMismatch(RuntimeError):
    """The index was written by another version; it is left as it is."""


def publish(tables: dict[str, DataFrame], folder: str) -> str:
    """Writes all tables to a new version and names it last: a reader sees all of them or those before."""
    spark = next(iter(tables.values())).sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{version}/{name}")
    note = json.dumps({"version": version, "schema": SCHEMA_VERSION, "tables": sorted(tables)})
    spark.createDataFrame([(note,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/current")
    return version


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    note = json.loads(spark.read.text(f"{folder}/current").first()["value"])
    if note["schema"] != SCHEMA_VERSION:
        raise IndexMismatch(f"index schema {note['schema']}, expected {SCHEMA_VERSION}")
    return {name: spark.read.parquet(f"{folder}/{note['version']}/{name}") for name in note["tables"]}


_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """Where tables of a session go: the folder that the cluster names in spark.checkpoint.dir; a local one only where it is unset and the session is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not (spark.sparkContext.master + "[").startswith("local["):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append("file://" + tempfile.mkdtemp(prefix="lectern-"))
    return _LOCAL[0]
