"""Null strategies, cleaning, outliers and normalisation over events, orders and line items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import cleaning as C, outliers as O
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import GAPPY, gappy_events, table

WITH = "WITH" + GAPPY
PICK = ("event_id", "user_id", "value")


def _statistic(name: str, sql: str) -> None:
    @query(
        f"fill_{name}",
        WITH + f" SELECT event_id, user_id, ROUND(COALESCE(value, (SELECT {sql}(value) FROM gappy)), 6) AS value FROM gappy",
    )
    def run(spark, d):
        rows = C.fill_nulls(gappy_events(spark, d), ["value"], f"fill_{name}")
        return rows.select("event_id", "user_id", F.round("value", 6).alias("value"))


_statistic("mean", "AVG")
_statistic("median", "MEDIAN")


@query(
    "fill_mode",
    """
WITH t AS (SELECT event_id, CASE WHEN value >= 5 THEN event_type END AS event_type FROM events)
SELECT event_id, COALESCE(event_type, (
  SELECT event_type FROM t WHERE event_type IS NOT NULL GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1
)) AS event_type FROM t""",
)
def fill_mode(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", F.when(F.col("value") >= 5, F.col("event_type")).alias("event_type")
    )
    return C.fill_nulls(rows, ["event_type"], "fill_mode")


NEIGHBOURS = """
, n AS (SELECT *, row_number() OVER ({by} ORDER BY ts, event_id) AS pos FROM gappy),
k AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
         last_value(value IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
         first_value(value IGNORE NULLS) OVER f AS nv
  FROM n WINDOW b AS ({by} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS ({by} ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
)
SELECT event_id, user_id, {value} AS value FROM k"""

LINE = """CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
     ELSE (nv - pv) / (np - pp) * (pos - pp) + pv END"""


def _neighbour(name: str, value: str, per_user: bool) -> None:
    by = "PARTITION BY user_id" if per_user else ""
    suffix = "_by_user" if per_user else ""

    @query(f"fill_{name}{suffix}", WITH + NEIGHBOURS.format(by=by, value=value))
    def run(spark, d):
        return C.fill_nulls(
            gappy_events(spark, d),
            ["value"],
            f"fill_{name}",
            order_by=["ts", "event_id"],
            partition_by=["user_id"] if per_user else [],
        ).select(*PICK)


for _name, _value in (("forward", "pv"), ("backward", "nv"), ("interpolate", LINE)):
    _neighbour(_name, _value, False)
    _neighbour(_name, _value, True)


@query("fill_constant", WITH + " SELECT event_id, user_id, COALESCE(value, -1) AS value FROM gappy")
def fill_constant(spark, d):
    rows = C.fill_nulls(gappy_events(spark, d), ["value"], "fill_constant", fill_value=-1.0)
    return rows.select(*PICK)


@query("fill_zero", WITH + " SELECT event_id, user_id, COALESCE(value, 0) AS value FROM gappy")
def fill_zero(spark, d):
    return C.fill_nulls(gappy_events(spark, d), ["value"], "fill_zero").select(*PICK)


@query("fill_keep", WITH + " SELECT event_id, user_id, value FROM gappy")
def fill_keep(spark, d):
    return C.handle_nulls(gappy_events(spark, d), "keep").select(*PICK)


SPARSE = """
WITH t AS (
  SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS value,
         CASE WHEN event_type = 'purchase' THEN user_id END AS buyer FROM events
)"""


def sparse(spark, d):
    kind = F.col("event_type")
    return table(spark, d, "events").select(
        "event_id",
        F.when(kind != "error", F.col("value")).alias("value"),
        F.when(kind == "purchase", F.col("user_id")).alias("buyer"),
    )


@query("drop_nulls", SPARSE + " SELECT event_id, value FROM t WHERE value IS NOT NULL")
def drop_nulls(spark, d):
    """The buyer is null in more than half of the rows, so its column goes."""
    return C.drop_nulls(sparse(spark, d), 0.5)


@query(
    "fill_column_specific",
    SPARSE + """
SELECT event_id, ROUND(COALESCE(value, (SELECT AVG(value) FROM t)), 6) AS value, COALESCE(buyer, 0) AS buyer FROM t""",
)
def fill_column_specific(spark, d):
    rows = C.handle_nulls(sparse(spark, d), "fill_mean", column_strategies={"buyer": "fill_zero"})
    return rows.withColumn("value", F.round("value", 6))


def raw_orders(spark, d):
    """Orders as they come from a careless export."""
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias(" Order Key"),
        F.col("o_custkey").alias("Cust Key "),
        F.concat(F.lit(" \t"), status, F.lit(" \n")).alias("Status!"),
        F.when(F.col("o_totalprice") > 50000, F.col("o_totalprice")).alias("Total Price"),
        F.when(status == "P", F.col("o_orderpriority")).alias("Rush"),
        F.lit(None).cast("string").alias("Nothing"),
    )


CLEANED = """
raw AS (
  SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS status,
         CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS total_price,
         CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS rush FROM orders
), whole AS (
  SELECT *, row_number() OVER (PARTITION BY cust_key, status ORDER BY order_key) AS r FROM raw
  WHERE total_price IS NOT NULL
), cleaned AS (SELECT order_key, cust_key, status, total_price FROM whole WHERE r = 1)
"""


def cleaned_orders(spark, d):
    return C.clean_data(
        raw_orders(spark, d), duplicate_subset=["cust_key", "status"], order_by=["order_key"]
    )


@query("clean_default", "WITH" + CLEANED + "SELECT * FROM cleaned")
def clean_default(spark, d):
    return cleaned_orders(spark, d)


@query(
    "clean_mark",
    "WITH" + CLEANED + "SELECT order_key, cust_key, status, total_price, r > 1 AS _is_duplicate FROM whole",
)
def clean_mark(spark, d):
    return C.clean_data(
        raw_orders(spark, d), duplicate_subset=["cust_key", "status"], order_by=["order_key"],
        mark_duplicates_only=True,
    )


@query(
    "clean_report",
    "WITH" + CLEANED + """
, b AS (SELECT COUNT(*) AS n, COUNT(*) - COUNT(total_price) + COUNT(*) - COUNT(rush) + COUNT(*) AS nulls FROM raw),
a AS (SELECT COUNT(*) AS n FROM cleaned)
SELECT b.n AS rows_before, 6 AS columns_before, b.nulls AS nulls_before, a.n AS rows_after, 4 AS columns_after,
       CAST(0 AS BIGINT) AS nulls_after, b.nulls AS nulls_handled, b.n - a.n AS rows_removed, 2 AS columns_removed,
       CAST(0 AS DOUBLE) AS null_percentage_after, CAST(100 AS DOUBLE) AS data_quality_score,
       CASE WHEN a.n * 2 < b.n THEN 'less than half of the rows retained' ELSE '' END AS warnings
FROM a, b""",
)
def clean_report(spark, d):
    return C.cleaning_report(raw_orders(spark, d), cleaned_orders(spark, d))


@query(
    "clean_on_load",
    """
SELECT o_orderkey AS "Order Key", o_custkey AS "Cust Key", chr(32) || chr(9) || o_orderstatus || chr(32) || chr(10) AS "Status!",
       CASE WHEN o_totalprice > 50000 THEN o_totalprice END AS "Total Price",
       CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS "Rush" FROM orders""",
)
def clean_on_load(spark, d):
    return C.clean_on_load(raw_orders(spark, d))


@query("clean_upload", "WITH" + CLEANED + "SELECT * FROM raw")
def clean_upload(spark, d):
    return C.process_upload(raw_orders(spark, d))


ITEM = ("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount")
ITEMS = "SELECT " + ", ".join(ITEM) + " FROM lineitem"


def items(spark, d):
    return table(spark, d, "lineitem").select(*ITEM)


FENCES = """
WITH q AS (
  SELECT quantile_cont(l_extendedprice, 0.25) AS p1, quantile_cont(l_extendedprice, 0.75) AS p3,
         quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem
), f AS (
  SELECT l.*, l_extendedprice < p1 - {k} * (p3 - p1) OR l_extendedprice > p3 + {k} * (p3 - p1) AS po,
         l_quantity < q1 - {k} * (q3 - q1) OR l_quantity > q3 + {k} * (q3 - q1) AS qo
  FROM lineitem l, q
)"""


@query(
    "outliers_iqr",
    FENCES.format(k="0.4") + " SELECT " + ", ".join(ITEM) + " FROM f WHERE NOT po AND NOT qo",
)
def outliers_iqr(spark, d):
    return O.remove_outliers(items(spark, d), ["l_extendedprice", "l_quantity"], "iqr", 0.4)


ZFENCES = """
WITH m AS (
  SELECT AVG(l_extendedprice) AS pm, stddev_samp(l_extendedprice) AS ps,
         AVG(l_quantity) AS qm, stddev_samp(l_quantity) AS qs FROM lineitem
), f AS (
  SELECT l.*, abs((l_extendedprice - pm) / ps) > 1.6 AS po, abs((l_quantity - qm) / qs) > 1.6 AS qo
  FROM lineitem l, m
)"""


@query(
    "outliers_zscore",
    ZFENCES + " SELECT " + ", ".join(ITEM) + " FROM f WHERE NOT po AND NOT qo",
)
def outliers_zscore(spark, d):
    return O.remove_outliers(items(spark, d), ["l_extendedprice", "l_quantity"], "zscore", 1.6)


@query(
    "outliers_report",
    FENCES.format(k="0.4") + """
, t AS (SELECT COUNT(*) FILTER (WHERE po) AS p, COUNT(*) FILTER (WHERE qo) AS q,
               COUNT(*) FILTER (WHERE po OR qo) AS r, COUNT(*) AS n FROM f)
SELECT 'l_extendedprice' AS column_name, p AS outliers, r AS rows_removed, n AS rows_before FROM t
UNION ALL SELECT 'l_quantity', q, r, n FROM t""",
)
def outliers_report(spark, d):
    return O.outlier_report(items(spark, d), ["l_extendedprice", "l_quantity"], "iqr", 0.4)


def _normal(method: str, shift: str, scale: str) -> None:
    sql = f"""
WITH m AS (SELECT {shift.format(c='o_totalprice')} AS a, {scale.format(c='o_totalprice')} AS b FROM orders)
SELECT o_orderkey, ROUND((o_totalprice - a) / b, 8) AS o_totalprice, o_custkey, 7.0 AS same FROM orders, m"""

    @query(f"normalize_{method}", sql)
    def run(spark, d):
        rows = table(spark, d, "orders").select(
            "o_orderkey", "o_totalprice", "o_custkey", F.lit(7.0).alias("same")
        )
        out = O.normalize(rows, ["o_totalprice", "same"], method)
        return out.withColumn("o_totalprice", F.round("o_totalprice", 8))


_normal("minmax", "MIN({c})", "MAX({c}) - MIN({c})")
_normal("zscore", "AVG({c})", "stddev_samp({c})")
_normal("robust", "median({c})", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")
