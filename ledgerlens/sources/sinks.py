"""Writing tables: files with metadata, versions, verified copies, database tables."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ledgerlens.operators.cleaning import process_upload
from ledgerlens.operators.quality import upload_report
from ledgerlens.sources import files, snapshots
from ledgerlens.sources.readers import CSV_TEXT, detect_format, raw_header, read_back, read_table  # noqa: F401

MODES = {"append": "append", "replace": "overwrite", "fail": "errorifexists"}


def check_for_save(df: DataFrame) -> None:
    """Raise for repeated column names and for an empty table."""
    if len(set(df.columns)) < len(df.columns):
        raise ValueError(f"repeated column names: {df.columns}")
    if df.isEmpty():
        raise ValueError("the table has no rows")


def run_stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%d_%H%M%S_%f")


def save_table(
    df: DataFrame,
    folder: str,
    name: str,
    file_format: str = "parquet",
    *,
    include_timestamp: bool = True,
    overwrite: bool = False,
    compression: str | None = None,
    metadata: dict | None = None,
    validate: bool = True,
) -> str:
    """Write a snapshot folder ``name_<run>``, its metadata beside it and at last its manifest; return its path.

    Readers that go by manifests see the snapshot only then. An existing folder is an error unless ``overwrite``. CSV and JSON Lines are plain text
    unless a compression is given, Parquet uses snappy.
    """
    kind = detect_format("", file_format)
    if validate:
        check_for_save(df)
    version = run_stamp() if include_timestamp else ""
    stem = f"{name}_{version}" if version else name
    path = f"{folder}/{stem}.{kind}"
    # Rows and values per column are counted while they are written.
    seen = Observation()
    counted = df.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(df.columns)],
    )
    mode = "overwrite" if overwrite else "errorifexists"
    if overwrite:
        snapshots.withdraw(df.sparkSession, folder, stem)
    writer = counted.write.mode(mode)
    if kind == "parquet":
        writer.option("compression", compression or "snappy").parquet(path)
    elif kind == "json":
        writer.option("compression", compression or "none").json(path)
    else:
        sep = "\t" if kind == "tsv" else ","
        writer.options(**CSV_TEXT, header=True, sep=sep, emptyValue='""', compression=compression or "none").csv(path)
    found = seen.get
    empty = [c for i, c in enumerate(df.columns) if found[f"n{i}"] == 0]
    sidecar(df, path, kind, found["rows"], empty, metadata).coalesce(1).write.mode(mode).json(
        f"{folder}/{stem}{files.SIDECAR}"
    )
    snapshots.publish(df, folder, stem, name, version, kind, found["rows"])
    return path


def sidecar(
    df: DataFrame, path: str, kind: str, rows: int, empty: list[str], metadata: dict | None
) -> DataFrame:
    """The metadata row of a saved table: rows, columns, types, size, time, user entries."""
    written = files.list_files(df.sparkSession, path)
    return written.agg(
        F.lit(path).alias("path"),
        F.lit(kind).alias("format"),
        F.lit(rows).cast("long").alias("rows"),
        F.lit(len(df.columns)).alias("columns"),
        F.lit(json.dumps(dict(df.dtypes))).alias("dtypes"),
        F.lit(",".join(empty)).alias("all_null_columns"),
        F.coalesce(F.sum("size_bytes"), F.lit(0)).alias("size_bytes"),
        F.current_timestamp().alias("saved_at"),
        F.lit(json.dumps(metadata or {})).alias("metadata"),
    )


def _marks(df: DataFrame) -> list[Column]:
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    return [
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.bit_xor(row), F.lit(0)).alias("xor_mark"),
        # Copies cancel in the xor but not in the sum.
        F.coalesce(F.sum(row.cast("decimal(20,0)")), F.lit(0)).cast("string").alias("sum_mark"),
    ]


def content_mark(df: DataFrame) -> DataFrame:
    """Rows and order-free hashes of all cells: equal for equal bags of rows, almost surely."""
    return df.agg(*_marks(df))


def land_verified(df: DataFrame, path: str, overwrite: bool = False) -> DataFrame:
    """Write a Parquet copy, read it back and compare; raise when the contents differ.

    The source is marked while it is written, so it is read once.
    """
    seen = Observation()
    marked = df.observe(seen, *_marks(df))
    marked.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)
    copy = df.sparkSession.read.schema(df.schema).parquet(path)
    after = content_mark(copy).first().asDict()
    if seen.get != after:
        raise IOError(f"copy at {path} differs from its source: {seen.get} and {after}")
    return copy


def save_to_database(
    df: DataFrame,
    table_name: str,
    url: str | None = None,
    if_exists: str = "append",
    chunk_size: int = 1000,
    **properties: str,
) -> None:
    """Write to a database over JDBC in batches, or to a table of the session's catalogue."""
    if if_exists not in MODES:
        raise ValueError(f"if_exists {if_exists!r} is not one of {sorted(MODES)}")
    if not df.columns:
        raise ValueError("the table has no columns")
    writer = df.write.mode(MODES[if_exists])
    if url is None:
        writer.saveAsTable(table_name)
    else:
        writer.option("batchsize", chunk_size).jdbc(url, table_name, properties=properties)


def ingest_batch(
    spark: SparkSession,
    source: str,
    raw_folder: str,
    out_folder: str,
    name: str,
    file_format: str | None = None,
    schema=None,
    process: bool = True,
    max_mb: int = files.MAX_UPLOAD_MB,
) -> DataFrame:
    """Admit the files of a folder, land them, validate, process, save; return the report row.

    rejected_files lists every file that was left out, with its size and the reason.

    A folder without rejected files is read as a folder; otherwise the paths of the admitted
    ones, not their contents, pass through the driver.
    """
    checked = files.admitted(files.list_files(spark, source), max_mb)
    if file_format:
        other = F.coalesce(F.col("format") != detect_format("", file_format), F.lit(True))
        checked = checked.withColumn("admitted", F.col("admitted") & ~other)
    count = checked.agg(
        F.count_if("admitted").alias("good"),
        F.count_if(~F.col("admitted")).alias("bad"),
        F.min(F.when(F.col("admitted"), F.col("format"))).alias("format"),
        F.max(F.when(F.col("admitted"), F.col("format"))).alias("last_format"),
    ).first()
    if not count["good"]:
        raise ValueError(f"no file in {source} may be loaded")
    if count["format"] != count["last_format"]:
        raise ValueError(f"{source} holds files of several formats; say which with file_format")
    paths = source
    if count["bad"]:
        paths = [r["path"] for r in checked.filter("admitted").select("path").collect()]
    raw = read_table(spark, paths, file_format or count["format"], schema, recursiveFileLookup=True)
    landed = land_verified(raw, f"{raw_folder}/{name}_{run_stamp()}.parquet")
    kind = detect_format("", file_format or count["format"])
    header = raw_header(spark, paths, "\t" if kind == "tsv" else ",", recursiveFileLookup=True) if kind in ("csv", "tsv") else None
    report = upload_report(landed, header)
    if not report.first()["is_valid"]:
        raise ValueError(f"{source} failed validation: {report.first()['errors']}")
    out = process_upload(landed) if process else landed
    path = save_table(out, out_folder, name, "parquet")
    turned_down = F.struct("path", "size_bytes", F.coalesce("reason", F.lit("other format")).alias("reason"))
    rejected = checked.agg(F.collect_list(F.when(~F.col("admitted"), turned_down))).scalar()
    return report.select("*", F.lit(path).alias("saved_to"), rejected.alias("rejected_files"))
