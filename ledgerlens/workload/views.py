"""Base tables of the registered queries, and the same tables as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ledgerlens.functions.numeric import from_scaled, scaled


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sales_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Line items with their part, money as decimals so that sums are exact."""
    part = table(spark, folder, "part").select(
        F.col("p_partkey").alias("product"),
        F.col("p_brand").alias("brand"),
        F.col("p_type").alias("category"),
        scaled(F.col("p_retailprice")).alias("cents"),
    )
    item = table(spark, folder, "lineitem")
    net = scaled(F.col("l_extendedprice")) * (F.lit(100) - scaled(F.col("l_discount")))
    lines = item.select(
        F.col("l_orderkey").alias("order_id"),
        F.col("l_linenumber").alias("line"),
        F.col("l_partkey").alias("product"),
        F.col("l_quantity").cast("long").alias("quantity"),
        from_scaled(net, 4).alias("revenue"),
        (F.col("l_returnflag") == "R").alias("is_returned"),
        F.col("l_shipdate").alias("sale_date"),
    )
    # A plain equi-join of two scans: Spark broadcasts by size, and splits a hot part's rows otherwise.
    joined = lines.join(part, "product")
    return joined.withColumn("cost", from_scaled(F.col("quantity") * F.col("cents"), 2)).drop("cents")


SALES = """
sales AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line, l_partkey AS product, p_brand AS brand,
         p_type AS category, CAST(l_quantity AS BIGINT) AS quantity,
         CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue,
         CAST(CAST(l_quantity AS DECIMAL(6,0)) * CAST(p_retailprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS cost,
         l_returnflag = 'R' AS is_returned, l_shipdate AS sale_date
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def order_sales(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sales rows."""
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").alias("order_date"),
        from_scaled(scaled(F.col("o_totalprice")), 2).alias("total_amount"),
    )


ORDER_SALES = """
order_sales AS (
  SELECT o_orderkey AS order_id, o_custkey AS user_id, o_orderdate AS order_date,
         CAST(o_totalprice AS DECIMAL(14,2)) AS total_amount
  FROM orders
)"""


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per order day: the series for moving metrics and anomalies."""
    return (
        order_sales(spark, folder)
        .groupBy(F.col("order_date").cast("date").alias("date"))
        .agg(F.sum("total_amount").cast("decimal(18,2)").alias("value"))
    )


DAILY = """
daily AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DECIMAL(18,2)) AS value
  FROM orders GROUP BY 1
)"""


def events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events")


def gappy_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events whose value is unknown for errors and below 1: a measure with nulls."""
    known = (F.col("event_type") != "error") & (F.col("value") >= 1)
    return events(spark, folder).select(
        "event_id", "ts", "user_id", "event_type", F.when(known, F.col("value")).alias("value")
    )


GAPPY = """
gappy AS (
  SELECT event_id, ts, user_id, event_type,
         CASE WHEN event_type <> 'error' AND value >= 1 THEN value END AS value
  FROM events
)"""
