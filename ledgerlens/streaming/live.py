"""Incremental forms: files dropped into a folder, and running period revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerlens.operators.cleaning import strip_values
from ledgerlens.functions.numeric import as_number


def file_stream(
    spark: SparkSession,
    folder: str,
    file_format: str,
    schema: T.StructType | str,
    pattern: str | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """New files of a folder as a stream."""
    reader = spark.readStream.format(file_format).schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if file_format == "csv":
        reader = reader.option("header", True)
    return reader.load(folder)


def ingest_stream(
    source: DataFrame, out_folder: str, checkpoint: str, process: bool = True
) -> StreamingQuery:
    """Process what has arrived since the last run and append it, each file exactly once.

    The file sink keeps a log of finished batches, so a batch that is run again after a
    failure is not written twice.
    """
    rows = strip_values(source.na.drop(how="all")) if process else source
    return (
        rows.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(out_folder)
    )


def period_revenue_stream(
    events: DataFrame,
    revenue_column: str,
    time_column: str,
    width: str = "1 day",
    late: str = "1 day",
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Revenue per time window with a watermark; rows later than ``late`` are dropped."""
    value = as_number(events, revenue_column)
    rows = events.withColumn("__v", value).withColumn("__t", F.col(time_column).cast("timestamp"))
    return (
        rows.withWatermark("__t", late)
        .groupBy(F.window("__t", width), *by)
        .agg(
            F.sum("__v").alias("total_revenue"),
            F.count("__v").alias("count"),
            F.min("__v").alias("min_revenue"),
            F.max("__v").alias("max_revenue"),
        )
        .select(
            F.col("window.start").alias("period_start"),
            F.col("window.end").alias("period_end"),
            *by,
            "total_revenue",
            "count",
            "min_revenue",
            "max_revenue",
        )
    )


def append_closed(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append each period once it can no longer change; the state holds open periods only."""
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .outputMode("append")
        .start(path)
    )


def keep_latest(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the full current result as one snapshot folder per batch, for available data.

    The state holds one row per period and key, as long as the stream's calendar. A batch that
    is repeated replaces its own snapshot.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """The newest of the snapshots; older ones are pruned by their partition value."""
    rows = spark.read.parquet(path)
    return rows.filter(F.col("batch") == rows.agg(F.max("batch")).scalar()).drop("batch")
