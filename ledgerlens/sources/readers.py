"""Reading tables from files: CSV, TSV, JSON, Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ledgerlens.sources import records

# Format by file extension.
EXTENSIONS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "json": "json", "parquet": "parquet"}


def detect_format(path: str, explicit: str | None = None) -> str:
    """Format from the extension of the path, unless given; an unknown one is an error."""
    name = (explicit or path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1]).lower()
    if name not in EXTENSIONS:
        raise ValueError(f"unsupported format {name!r}; known: {sorted(set(EXTENSIONS.values()))}")
    return EXTENSIONS[name]


def read_table(
    spark: SparkSession,
    path: str | list[str],
    file_format: str | None = None,
    schema: T.StructType | str | None = None,
    encoding: str = "utf-8",
    **options,
) -> DataFrame:
    """Read files or folders. A schema saves the inference pass over text files.

    JSON is read as an array of records per file; pass ``multiLine=False`` for JSON Lines. CSV texts may
    hold line breaks inside quotes. Files above a task's share are cut into blocks whose records are found by
    ``sources/records.py``; pass ``multiLine`` to have Spark's own reader, which then splits files only without it.
    """
    first = path if isinstance(path, str) else path[0]
    kind = detect_format(first, file_format)
    reader = spark.read
    by_block = (
        kind != "parquet" and "multiLine" not in options and encoding.lower() in ("utf-8", "utf8")
        and options.get("header", True) is True and records.needs_splitting(spark, path, **options)
    )
    if by_block and kind == "json":
        return nan_to_null(records.read_json(spark, path, schema, **options))
    if by_block:
        defaults = {"sep": "\t" if kind == "tsv" else ",", "quote": '"', "escape": '"', **options}
        header = raw_header(spark, path, defaults["sep"], **options)
        return nan_to_null(records.read_csv(spark, path, header, schema, **defaults))
    if schema is not None:
        reader = reader.schema(schema)
    if kind in ("csv", "tsv"):
        defaults = {
            "header": True,
            "encoding": encoding,
            "sep": "\t" if kind == "tsv" else ",",
            "quote": '"',
            "escape": '"',
            "multiLine": True,
            "inferSchema": schema is None,
        }
        df = reader.options(**{**defaults, **options}).csv(path)
    elif kind == "json":
        df = reader.options(**{"multiLine": True, "encoding": encoding, **options}).json(path)
    else:
        df = reader.options(**options).parquet(path)
    if not df.columns:
        raise ValueError(f"{path} holds no columns")
    return nan_to_null(df)


def nan_to_null(df: DataFrame) -> DataFrame:
    """One concept of missing: NaN in floating columns becomes null."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def raw_header(spark: SparkSession, path: str | list[str], sep: str = ",", **options) -> list[str]:
    """Names in the header line as written, repeated ones included."""
    kept = {k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")}
    line = spark.read.options(**kept).text(path).limit(1).first()
    names = [] if line is None else next(iter(_split(line[0], sep)))
    return names


def _split(line: str, sep: str):
    import csv

    return csv.reader([line.removeprefix("﻿")], delimiter=sep)


# How CSV and TSV keep every text: outer blanks stay, an empty text is "" and null is \N.
CSV_TEXT = {
    "quote": '"',
    "escape": '"',
    "nullValue": "\\N",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_back(spark: SparkSession, path: str, kind: str, schema: T.StructType | str) -> DataFrame:
    """Read what ``sinks.save_table`` wrote."""
    options = {"multiLine": False} if kind == "json" else {}
    if kind in ("csv", "tsv"):
        options |= {**CSV_TEXT, "emptyValue": "", "enforceSchema": False}
    return read_table(spark, path, kind, schema, **options)


def read_millis(df: DataFrame, column: str) -> DataFrame:
    """Epoch milliseconds, as JSON exports write dates, to timestamps."""
    return df.withColumn(column, F.timestamp_millis(F.col(column).cast("long")))
