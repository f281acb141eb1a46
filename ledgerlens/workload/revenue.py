"""Revenue metrics over sales lines, orders and the daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions.periods import PERIODS
from ledgerlens.operators import filters, revenue as R
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import (
    DAILY, ORDER_SALES, SALES, daily, events, order_sales, sales_fact, table,
)

KEPT = "WITH" + SALES + ", kept AS (SELECT * FROM sales WHERE revenue IS NOT NULL AND revenue <> 0)"


def _kept(spark, d):
    return R.usable_rows(sales_fact(spark, d), "revenue")


@query("revenue_total", KEPT + " SELECT CAST(SUM(revenue) AS DOUBLE) AS total_revenue FROM kept")
def revenue_total(spark, d):
    return R.total_revenue(_kept(spark, d), "revenue")


@query("revenue_average", KEPT + " SELECT CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS average_revenue FROM kept")
def revenue_average(spark, d):
    return R.average_revenue(_kept(spark, d), "revenue")


@query("revenue_median", KEPT + " SELECT median(CAST(revenue AS DOUBLE)) AS median_revenue FROM kept")
def revenue_median(spark, d):
    return R.median_revenue(_kept(spark, d), "revenue")


BREAKDOWN = """
SELECT 'total' AS metric_type,
       ROUND(CAST(SUM(v) AS DOUBLE), 2) AS metric_value, ROUND(CAST(SUM(v) AS DOUBLE), 2) AS total_revenue,
       ROUND(CAST(MIN(v) AS DOUBLE), 2) AS min_revenue, ROUND(CAST(MAX(v) AS DOUBLE), 2) AS max_revenue,
       ROUND(CAST(SUM(v) AS DOUBLE) / COUNT(v), 2) AS avg_revenue,
       ROUND(stddev_samp(CAST(v AS DOUBLE)), 2) AS std_deviation,
       COUNT(v) AS records_processed, COUNT(*) - COUNT(v) AS records_excluded, 'success' AS status
FROM (SELECT CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) ELSE 0 END AS p,
             CASE WHEN l_discount > 0 THEN CAST(l_extendedprice AS DECIMAL(12,2)) END AS v FROM lineitem)
"""


@query("revenue_breakdown", BREAKDOWN)
def revenue_breakdown(spark, d):
    """Lines without a discount count as zero revenue and are excluded."""
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    lines = table(spark, d, "lineitem").select(
        F.when(F.col("l_discount") > 0, price).otherwise(F.lit(0)).cast("decimal(12,2)").alias("price")
    )
    return R.revenue_breakdown(lines, "price", "total", 2)


@query(
    "revenue_by_category",
    KEPT + """
SELECT category, CAST(SUM(revenue) AS DOUBLE) AS total_revenue,
       CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS avg_revenue, COUNT(revenue) AS count,
       CAST(MIN(revenue) AS DOUBLE) AS min_revenue, CAST(MAX(revenue) AS DOUBLE) AS max_revenue,
       CAST(SUM(revenue) AS DOUBLE) / CAST((SELECT SUM(revenue) FROM kept) AS DOUBLE) * 100.0 AS percentage
FROM kept GROUP BY category""",
)
def revenue_by_category(spark, d):
    return R.revenue_by_category(_kept(spark, d), "revenue", "category")


# Truncation unit, step and label of each period, as SQL.
_UNIT = {
    "D": ("day", "INTERVAL 1 DAY", "p"),
    "W": ("week", "INTERVAL 7 DAY", "p + INTERVAL 6 DAY"),
    "M": ("month", "INTERVAL 1 MONTH", "p + INTERVAL 1 MONTH - INTERVAL 1 DAY"),
    "Q": ("quarter", "INTERVAL 3 MONTH", "p + INTERVAL 3 MONTH - INTERVAL 1 DAY"),
    "Y": ("year", "INTERVAL 1 YEAR", "p + INTERVAL 1 YEAR - INTERVAL 1 DAY"),
}


def spine_sql(source: str, date: str, unit: str) -> str:
    trunc, step, _ = _UNIT[unit]
    return f"""
spine AS (
  SELECT unnest(generate_series(CAST(date_trunc('{trunc}', MIN({date})) AS TIMESTAMP),
                                CAST(date_trunc('{trunc}', MAX({date})) AS TIMESTAMP), {step})) AS p
  FROM {source}
)"""


def _by_period(unit: str) -> None:
    trunc, _, label = _UNIT[unit]
    sql = KEPT + "," + spine_sql("kept", "sale_date", unit) + f"""
SELECT CAST({label} AS DATE) AS period, COALESCE(CAST(SUM(revenue) AS DOUBLE), 0) AS total_revenue,
       CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS avg_revenue, COUNT(revenue) AS count,
       CAST(MIN(revenue) AS DOUBLE) AS min_revenue, CAST(MAX(revenue) AS DOUBLE) AS max_revenue
FROM spine LEFT JOIN kept ON date_trunc('{trunc}', sale_date) = p GROUP BY p"""

    @query(f"revenue_by_period_{unit.lower()}", sql)
    def run(spark, d):
        return R.revenue_by_period(_kept(spark, d), "revenue", "sale_date", unit)


for _u in PERIODS:
    _by_period(_u)


@query(
    "revenue_by_period_sparse",
    "WITH weekly AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS day, CAST(o_totalprice AS DECIMAL(14,2)) AS v FROM orders),"
    + spine_sql("weekly", "day", "D") + """
SELECT CAST(p AS DATE) AS period, COALESCE(CAST(SUM(v) AS DOUBLE), 0) AS total_revenue,
       CAST(SUM(v) AS DOUBLE) / COUNT(v) AS avg_revenue, COUNT(v) AS count,
       CAST(MIN(v) AS DOUBLE) AS min_revenue, CAST(MAX(v) AS DOUBLE) AS max_revenue
FROM spine LEFT JOIN weekly ON day = CAST(p AS DATE) GROUP BY p""",
)
def revenue_by_period_sparse(spark, d):
    """All orders booked on the Mondays of their weeks; six of seven days of the grid are empty."""
    weekly = order_sales(spark, d).withColumn("order_date", F.date_trunc("week", "order_date").cast("date"))
    return R.revenue_by_period(weekly, "total_amount", "order_date", "D")


# How people write the dates of orders, by the last digit of the key; the last layout is no date.
LAYOUTS = ("yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")


def _typed_dates(spark, d):
    text = F.lit("oops")
    for i, layout in enumerate(LAYOUTS):
        text = F.when(F.col("order_id") % 7 == i, F.date_format("order_date", layout)).otherwise(text)
    return order_sales(spark, d).withColumn("order_date", text)


@query(
    "revenue_by_period_texts",
    "WITH typed AS (SELECT CASE WHEN o_orderkey % 7 < 6 THEN CAST(o_orderdate AS DATE) END AS day, CAST(o_totalprice AS DECIMAL(14,2)) AS v FROM orders),"
    + spine_sql("typed", "day", "M") + """
SELECT CAST(p + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period, COALESCE(CAST(SUM(v) AS DOUBLE), 0) AS total_revenue,
       CAST(SUM(v) AS DOUBLE) / COUNT(v) AS avg_revenue, COUNT(v) AS count,
       CAST(MIN(v) AS DOUBLE) AS min_revenue, CAST(MAX(v) AS DOUBLE) AS max_revenue
FROM spine LEFT JOIN typed ON date_trunc('month', day) = p GROUP BY p""",
)
def revenue_by_period_texts(spark, d):
    """Orders whose dates are texts in six layouts, a seventh of them no dates."""
    return R.revenue_by_period(_typed_dates(spark, d), "total_amount", "order_date", "M")


@query(
    "revenue_cumulative",
    "WITH" + DAILY + """
SELECT date, CAST(value AS DOUBLE) AS revenue,
       CAST(SUM(value) OVER (ORDER BY date) AS DOUBLE) AS cumulative_revenue FROM daily""",
)
def revenue_cumulative(spark, d):
    return R.cumulative_revenue(daily(spark, d), "value", "date", max_group_rows=R.MAX_PERIODS // 2)


@query(
    "revenue_cumulative_rows",
    "WITH" + ORDER_SALES + """
SELECT order_date AS date, order_id, CAST(total_amount AS DOUBLE) AS revenue,
       CAST(SUM(total_amount) OVER (ORDER BY order_date, order_id) AS DOUBLE) AS cumulative_revenue
FROM order_sales""",
)
def revenue_cumulative_rows(spark, d):
    """Running sum over every order row; the plan is split when the table is large."""
    return R.cumulative_revenue(
        order_sales(spark, d), "total_amount", "order_date", order_by=["order_id"]
    )


@query(
    "revenue_cumulative_month",
    "WITH" + ORDER_SALES + "," + spine_sql("order_sales", "order_date", "M") + """
, sums AS (SELECT date_trunc('month', order_date) AS m, SUM(total_amount) AS s FROM order_sales GROUP BY 1)
SELECT CAST(p + INTERVAL 1 MONTH - INTERVAL 1 DAY AS DATE) AS period,
       COALESCE(CAST(s AS DOUBLE), 0) AS period_revenue,
       CASE WHEN s IS NOT NULL THEN CAST(SUM(s) OVER (ORDER BY p) AS DOUBLE) END AS cumulative_revenue
FROM spine LEFT JOIN sums ON m = p""",
)
def revenue_cumulative_month(spark, d):
    return R.cumulative_revenue(order_sales(spark, d), "total_amount", "order_date", "M")


def _growth(unit: str, n: int) -> None:
    trunc, _, label = _UNIT[unit]
    sql = "WITH" + ORDER_SALES + "," + spine_sql("order_sales", "order_date", unit) + f"""
, sums AS (
  SELECT p, COALESCE(CAST(SUM(total_amount) AS DOUBLE), 0) AS revenue
  FROM spine LEFT JOIN order_sales ON date_trunc('{trunc}', order_date) = p GROUP BY p
), l AS (SELECT p, revenue, LAG(revenue, {n}) OVER (ORDER BY p) AS b FROM sums)
SELECT CAST({label} AS DATE) AS period, revenue,
       CASE WHEN b <> 0 THEN (revenue - b) / b * 100.0 END AS growth_rate_pct
FROM l"""

    @query(f"revenue_growth_{unit.lower()}{n}", sql)
    def run(spark, d):
        return R.revenue_growth(order_sales(spark, d), "total_amount", "order_date", unit, n)


_growth("W", 1)
_growth("M", 1)
_growth("M", 12)
_growth("Q", 1)


@query(
    "revenue_moving_avg",
    "WITH" + DAILY + """
SELECT date, CAST(value AS DOUBLE) AS revenue,
       CAST(SUM(value) OVER w AS DOUBLE) / COUNT(value) OVER w AS ma_7_revenue
FROM daily WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
)
def revenue_moving_avg(spark, d):
    return R.moving_average_revenue(daily(spark, d), "value", "date", 7, max_group_rows=R.MAX_PERIODS // 2)


@query(
    "revenue_moving_avg_by_user",
    "WITH" + ORDER_SALES + """
SELECT user_id, order_date AS date, order_id, CAST(total_amount AS DOUBLE) AS revenue,
       CAST(SUM(total_amount) OVER w AS DOUBLE) / COUNT(total_amount) OVER w AS ma_3_revenue
FROM order_sales
WINDOW w AS (PARTITION BY user_id ORDER BY order_date, order_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""",
)
def revenue_moving_avg_by_user(spark, d):
    return R.moving_average_revenue(
        order_sales(spark, d), "total_amount", "order_date", 3,
        order_by=["order_id"], partition_by=["user_id"],
    )


@query(
    "profit_margin",
    "WITH" + SALES + """
SELECT (CAST(SUM(revenue) - SUM(cost) AS DOUBLE)) / CAST(SUM(revenue) AS DOUBLE) * 100.0 AS profit_margin
FROM sales""",
)
def profit_margin(spark, d):
    return R.profit_margin(sales_fact(spark, d), "revenue", "cost")


@query(
    "arpu_by_user",
    "WITH" + ORDER_SALES
    + " SELECT CAST(SUM(total_amount) AS DOUBLE) / COUNT(DISTINCT user_id) AS arpu FROM order_sales",
)
def arpu_by_user(spark, d):
    return R.arpu(order_sales(spark, d), "total_amount", "user_id")


@query(
    "arpu_by_row",
    "WITH" + ORDER_SALES + " SELECT CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS arpu FROM order_sales",
)
def arpu_by_row(spark, d):
    return R.arpu(order_sales(spark, d), "total_amount")


@query(
    "conversion_rate",
    "SELECT CAST(COUNT(*) FILTER (WHERE event_type = 'purchase') AS DOUBLE) / COUNT(*) * 100.0"
    " AS conversion_rate FROM events",
)
def conversion_rate(spark, d):
    flags = events(spark, d).select((F.col("event_type") == "purchase").alias("converted"))
    return R.conversion_rate(flags, "converted")


@query(
    "conversion_rate_of_total",
    """
SELECT CAST(SUM(converted) AS DOUBLE) / CAST(SUM(total) AS DOUBLE) * 100.0 AS conversion_rate
FROM (SELECT user_id, COUNT(*) FILTER (WHERE event_type = 'purchase') AS converted,
             COUNT(*) FILTER (WHERE event_type IN ('view', 'click')) AS total
      FROM events GROUP BY user_id)""",
)
def conversion_rate_of_total(spark, d):
    per_user = events(spark, d).groupBy("user_id").agg(
        F.count_if(F.col("event_type") == "purchase").alias("converted"),
        F.count_if(F.col("event_type").isin("view", "click")).alias("total"),
    )
    return R.conversion_rate(per_user, "converted", "total")


@query(
    "revenue_filtered",
    KEPT + """
SELECT CAST(SUM(revenue) AS DOUBLE) AS total_sales, COUNT(*) AS transaction_count,
       CAST(SUM(revenue) AS DOUBLE) / COUNT(revenue) AS avg_order_value
FROM kept WHERE category = 'ECONOMY' AND sale_date >= DATE '1996-01-01' AND sale_date < DATE '1997-01-01'""",
)
def revenue_filtered(spark, d):
    rows = filters.in_category(_kept(spark, d), "category", "ECONOMY")
    rows = filters.in_dates(rows, "sale_date", "1996-01-01", "1996-12-31")
    return filters.sales_summary(rows, "revenue")


@query(
    "sales_summary_90d",
    "WITH" + ORDER_SALES + """
SELECT CAST(SUM(total_amount) AS DOUBLE) AS total_sales, COUNT(*) AS transaction_count,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM order_sales
WHERE CAST(order_date AS DATE) >= (SELECT CAST(MAX(order_date) AS DATE) - 89 FROM order_sales)""",
)
def sales_summary_90d(spark, d):
    return filters.sales_summary(filters.in_period(order_sales(spark, d), "order_date", "90d"), "total_amount")


@query(
    "sales_summary_qtd",
    "WITH" + ORDER_SALES + """
SELECT CAST(SUM(total_amount) AS DOUBLE) AS total_sales, COUNT(*) AS transaction_count,
       CAST(SUM(total_amount) AS DOUBLE) / COUNT(*) AS avg_order_value
FROM order_sales WHERE order_date >= (SELECT date_trunc('quarter', MAX(order_date)) FROM order_sales)""",
)
def sales_summary_qtd(spark, d):
    return filters.sales_summary(filters.in_period(order_sales(spark, d), "order_date", "qtd"), "total_amount")


@query(
    "sales_daily",
    "WITH" + ORDER_SALES + """
SELECT CAST(order_date AS DATE) AS order_date, CAST(SUM(total_amount) AS DOUBLE) AS total_amount
FROM order_sales GROUP BY 1 ORDER BY 1 DESC LIMIT 30""",
)
def sales_daily(spark, d):
    return filters.daily_sales(order_sales(spark, d), "total_amount", "order_date")
