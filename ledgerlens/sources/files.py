"""Folders of files as tables: listing, admission, fingerprints, latest snapshot, metadata."""

from __future__ import annotations

from fnmatch import translate

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from ledgerlens.sources.readers import EXTENSIONS, detect_format, read_table

# Largest file to load and largest upload, in MB.
MAX_LOAD_MB = 500
MAX_UPLOAD_MB = 50

SIDECAR = "_metadata.json"
#: Subfolder of the snapshots' manifests; its name keeps it out of every listing of data.
MANIFESTS = "_snapshots"
MANIFEST = (
    "name string, version string, path string, format string, rows long, files long, size_bytes long, "
    "schema string, saved_at timestamp"
)
# Files inside a folder that is itself named as a table are parts of a snapshot.
_PART = r"/[^/]+[.](" + "|".join(EXTENSIONS) + ")/[^/]+$"


def list_files(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """Path, name, format, size and modification time of the files; contents are not read.

    Files without a byte are not listed: a scan passes them over, so they are never loaded.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    name = F.element_at(F.split("path", "/"), -1)
    ending = F.lower(F.element_at(F.split(name, r"\."), -1))
    formats = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return reader.load(folder).select(
        "path",
        name.alias("file_name"),
        F.try_element_at(formats, ending).alias("format"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified"),
    )


def list_processed(
    spark: SparkSession, folder: str, file_format: str | None = None, sort_by: str = "modified"
) -> DataFrame:
    """Published snapshots, each one row whatever its files, and single data files, without their metadata.

    By name, by size or by time (largest, latest first). Snapshots without a manifest are not there yet.
    """
    orders = {
        "name": [F.asc("file_name")],
        "size": [F.desc("size_bytes"), F.asc("file_name")],
        "modified": [F.desc("modified"), F.asc("file_name")],
    }
    if sort_by not in orders:
        raise ValueError(f"sort_by {sort_by!r} is not one of {sorted(orders)}")
    single = ~F.endswith("file_name", F.lit(SIDECAR)) & ~F.col("path").rlike(_PART) & ~F.contains("path", F.lit(SIDECAR + "/"))
    columns = ["path", "file_name", "format", "size_bytes", "modified"]
    files = list_files(spark, folder).filter(single).select(*columns, F.lit(None).cast("long").alias("rows"), F.lit(False).alias("snapshot"))
    published = catalogue(spark, folder).select(
        F.concat(F.lit(f"{folder}/"), "path").alias("path"), F.col("path").alias("file_name"), "format", "size_bytes",
        F.col("saved_at").alias("modified"), "rows", F.lit(True).alias("snapshot"),
    )
    files = files.unionByName(published)
    if file_format:
        files = files.filter(F.col("format") == detect_format("", file_format))
    return files.orderBy(*orders[sort_by])


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests of the snapshots in a folder."""
    try:
        return spark.read.schema(MANIFEST).option("recursiveFileLookup", True).json(f"{folder}/{MANIFESTS}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], MANIFEST)


def admitted(files: DataFrame, max_mb: float = MAX_LOAD_MB) -> DataFrame:
    """Files with whether they may be loaded, and why not: too large or of unknown format."""
    reason = F.when(F.col("size_bytes") > max_mb * 1024 * 1024, "too large").when(
        F.col("format").isNull(), "unknown format"
    )
    return files.select("*", reason.isNull().alias("admitted"), reason.alias("reason"))


def fingerprints(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """SHA-256 of every file's bytes, one row per file, hashed where the file is read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder).select(
        "path",
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


def latest_entry(spark: SparkSession, folder: str, pattern: str) -> Row:
    """The row of list_processed that changed last among those whose name matches the pattern."""
    found = list_processed(spark, folder).filter(F.col("file_name").rlike(translate(pattern)))
    row = found.agg(F.max_by(F.struct("*"), F.struct("modified", "path"))).first()[0]
    if row is None:
        raise FileNotFoundError(f"no table in {folder} matches {pattern}")
    return row


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str:
    """Path of the most recent snapshot or single file that matches the pattern."""
    return latest_entry(spark, folder, pattern)["path"]


def file_metadata(df: DataFrame, with_hash: bool = False) -> DataFrame:
    """Per source file of a table read from files: path, name, size, time, rows. One pass.

    with_hash adds sha256, for which the files are read once more as bytes.
    """
    by = df.groupBy(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_name").alias("file_name"),
        F.col("_metadata.file_size").alias("size_bytes"),
        F.col("_metadata.file_modification_time").alias("modified"),
    )
    found = by.agg(F.count(F.lit(1)).alias("row_count")).withColumn("column_count", F.lit(len(df.columns)))
    if not with_hash:
        return found
    spark = df.sparkSession
    marks = spark.read.format("binaryFile").load(df.inputFiles()).select("path", F.sha2("content", 256).alias("sha256"))
    return found.join(marks, "path")
