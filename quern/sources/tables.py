"""Readers and writers of the stored tables."""

from __future__ import annotations

import re
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "source_doc string, sha256 string, chunks int, chars int, stored_at string"
_COLUMNS = [c.split()[0] for c in MANIFEST.split(", ")]
#: Changes are appended up to this number of times, then all are written as one.
MOST_CHANGES = 20


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def manifest_versions(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """(number, folder) of what a reader has to read, in order: the last whole manifest and the changes after it.

    A manifest is a folder of numbered versions, each whole or a set of changes. A version counts once its marker
    of success is there, which is written last: readers see the old state or the new one, whatever happens to a writer.
    """
    fs, target = _files(spark, path)
    if not fs.exists(target):
        return []
    found = []
    for s in fs.listStatus(target):
        name = s.getPath().getName()
        if (m := re.fullmatch(r"(whole|changes)-(\d{8})", name)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}/_SUCCESS")):
            found.append((int(m[2]), name))
    found.sort()
    start = max((k for k, (_, name) in enumerate(found) if name.startswith("whole")), default=0)
    return found[start:]


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest, the latest version of each page; a missing one is empty, and so is one with unreadable files. Another schema is an error."""
    parts = []
    for number, name in manifest_versions(spark, path):
        try:
            part = spark.read.parquet(f"{path}/{name}")
        except (PySparkException, Py4JJavaError):
            return spark.createDataFrame([], MANIFEST)
        if lacking := set(_COLUMNS) - set(part.columns):
            raise ValueError(f"{path} is no manifest: it lacks {sorted(lacking)}")
        parts.append(part.select(*_COLUMNS, F.lit(number).alias("_version")))
    if not parts:
        return spark.createDataFrame([], MANIFEST)
    rows = reduce(DataFrame.unionByName, parts)
    rest = [c for c in _COLUMNS if c != "source_doc"]
    latest = rows.groupBy("source_doc").agg(F.max(F.struct("_version", "stored_at", *[F.col(c).alias(f"v_{c}") for c in rest])).alias("m"))
    return latest.select("source_doc", *[F.col(f"m.v_{c}").alias(c) for c in rest]).select(*_COLUMNS)


def _write_version(rows: DataFrame, path: str, kind: str) -> int:
    versions = manifest_versions(rows.sparkSession, path)
    number = versions[-1][0] + 1 if versions else 1
    rows.select(*_COLUMNS).write.mode("overwrite").parquet(f"{path}/{kind}-{number:08d}")
    return number


def write_manifest(manifest: DataFrame, path: str) -> None:
    """manifest as a new whole version; the versions before the last whole one are removed, which no reader needs any more."""
    spark = manifest.sparkSession
    needed = {name for _, name in manifest_versions(spark, path)}
    _write_version(manifest, path, "whole")
    fs, target = _files(spark, path)
    current = {name for _, name in manifest_versions(spark, path)}
    for s in fs.listStatus(target):
        if s.getPath().getName() not in needed | current:
            fs.delete(s.getPath(), True)


def append_manifest(changes: DataFrame, path: str) -> None:
    """Only the changed rows are written; after MOST_CHANGES times all are merged into one version."""
    _write_version(changes, path, "changes")
    if len(manifest_versions(changes.sparkSession, path)) > MOST_CHANGES:
        write_manifest(read_manifest(changes.sparkSession, path), path)


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(query, source_doc, title, chars) of a frozen evaluation set in JSON; a missing file raises."""
    return spark.read.json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def write_eval_set(queries: DataFrame, path: str, *, built_at: str, model: str) -> None:
    queries.agg(F.lit(built_at).alias("built_at"), F.lit(model).alias("model"), F.count("*").alias("n"), F.collect_list(F.struct("query", "source_doc", "title", "chars")).alias("queries")).coalesce(1).write.mode("overwrite").json(path)


def sources_of(catalogue: DataFrame, key: str) -> DataFrame:
    """All sources, or the one of the key; an unknown key raises."""
    if key == "all":
        return catalogue
    one = catalogue.where(F.col("source_key") == key)
    if one.isEmpty():
        raise KeyError(key)
    return one


def visible(chunks: DataFrame, collection: str, acl: list[str]) -> DataFrame:
    """Chunks of the collection that share an entry with acl; a null list is visible to nobody."""
    return chunks.where((F.col("collection") == collection) & F.coalesce(F.arrays_overlap("acl", F.array(*map(F.lit, acl))), F.lit(False)))


def matching_parents(chunks: DataFrame, collection: str, pattern: str) -> DataFrame:
    """(doc_id) of the collection's parents whose address contains the pattern, in which % and _ are wildcards, or whose id it is."""
    hit = F.col("source_doc").like(f"%{pattern}%") | (F.col("id").cast("string") == pattern)
    return chunks.where((F.col("collection") == collection) & F.col("is_parent") & hit).select(F.col("id").alias("doc_id"))
