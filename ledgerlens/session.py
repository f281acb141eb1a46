"""Session settings and the shared folder for cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", app: str = "ledgerlens") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: The package's own setting, read where spark.checkpoint.dir is unset.
SCRATCH = "ledgerlens.scratch.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_made: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in spark.checkpoint.dir.

    Where that is unset, the package's own setting names it. Only a local master, whose executors are
    this very process, gets a folder of the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(SCRATCH, None)
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError(f"set spark.checkpoint.dir or {SCRATCH} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set(SCRATCH, folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered for clear_scratch."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application wrote to the shared folder; call it when its results were used."""
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in _made.pop(spark.sparkContext.applicationId, []):
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(hadoop).delete(place, True)


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes inside are deleted when each write has ended."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def cut_lineage(df: DataFrame, name: str) -> DataFrame:
    """Write the rows to the shared folder and read them back.

    Used where later steps need the very same physical split twice. A written table
    outlives lost executors, and later reads of it still prune columns. Its shuffle files
    are deleted once it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with shuffles_freed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
