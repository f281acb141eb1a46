"""Snapshots of a table: each has a manifest, written last, and readers go by manifests, never by part files.

A snapshot whose manifest is not written yet does not exist for readers, and one that is written over is withdrawn
first, so no reader meets half a table. Every version keeps its own folder and stays readable. A manifest holds the
number and size of the files it was written for; loading compares them with what is there.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.sources import files
from ledgerlens.sources.readers import read_back


def publish(df: DataFrame, folder: str, stem: str, name: str, version: str, kind: str, rows: int) -> None:
    """Write the manifest of the snapshot at folder/stem.kind; one file, so it is there or it is not."""
    written = files.list_files(df.sparkSession, f"{folder}/{stem}.{kind}")
    row = written.agg(
        F.lit(name).alias("name"),
        F.lit(version).alias("version"),
        F.lit(f"{stem}.{kind}").alias("path"),
        F.lit(kind).alias("format"),
        F.lit(rows).cast("long").alias("rows"),
        F.count("path").alias("files"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.lit(df.schema.json()).alias("schema"),
        F.current_timestamp().alias("saved_at"),
    )
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/{files.MANIFESTS}/{stem}")


def withdraw(spark: SparkSession, folder: str, stem: str) -> None:
    """Take a snapshot's manifest away; its files stay until they are written over."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{files.MANIFESTS}/{stem}")
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def versions(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The published versions of a table, the latest first."""
    own = files.catalogue(spark, folder).filter(F.col("name") == name)
    return own.orderBy(F.desc("saved_at"), F.desc("path"))


def load(spark: SparkSession, folder: str, name: str, version: str | None = None, check: bool = True) -> DataFrame:
    """All rows of a version, by default the latest, with the types it was saved with."""
    own = files.catalogue(spark, folder).filter(F.col("name") == name)
    if version is not None:
        own = own.filter(F.col("version") == version)
    row = own.agg(F.max_by(F.struct("*"), F.struct("saved_at", "path"))).first()[0]
    if row is None:
        raise FileNotFoundError(f"no snapshot of {name} in {folder}" + (f" has version {version}" if version else ""))
    return _read(spark, folder, row, check)


def _read(spark: SparkSession, folder: str, row: T.Row, check: bool) -> DataFrame:
    path = f"{folder}/{row['path']}"
    if check:
        there = files.list_files(spark, path).agg(F.count("path").alias("n"), F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("b")).first()
        if (there["n"], there["b"]) != (row["files"], row["size_bytes"]):
            raise IOError(f"{path} holds {there['n']} files of {there['b']} bytes; its manifest tells of {row['files']} of {row['size_bytes']}")
    return read_back(spark, path, row["format"], T.StructType.fromJson(json.loads(row["schema"])))


def load_latest(spark: SparkSession, folder: str, pattern: str, check: bool = True, **options) -> DataFrame:
    """The most recent snapshot or single file whose name matches the pattern, whole."""
    found = files.latest_entry(spark, folder, pattern)
    if not found["snapshot"]:
        return files.read_table(spark, found["path"], **options)
    row = files.catalogue(spark, folder).filter(F.col("path") == found["file_name"]).agg(F.max_by(F.struct("*"), "saved_at")).first()[0]
    return _read(spark, folder, row, check)
