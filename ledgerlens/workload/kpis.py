"""KPI roll-ups, comparisons, rules and report sections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import filters, kpis as K, reports as P
from ledgerlens.workload.products import PERFORMANCE, performance
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import (
    ORDER_SALES, SALES, events, order_sales, sales_fact, table,
)


def rounded(df, *names, digits: int = 6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def money(c: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(24,4))) AS DOUBLE)"


TOTALS = f"""{money('total_revenue')} AS r, {money('total_profit')} AS p, AVG(profit_margin) AS m, AVG(roi) AS roi,
  CAST(SUM(transaction_count) AS DOUBLE) AS n, SUM(total_quantity) AS q, AVG(return_rate) AS ret,
  CAST(COUNT(*) AS DOUBLE) AS c, CAST(COUNT(*) FILTER (WHERE roi > 100) AS DOUBLE) AS high, AVG(market_share) AS share,
  CAST(COUNT(*) FILTER (WHERE total_revenue > 0) AS DOUBLE) AS active"""
ONE = PERFORMANCE + f", o AS (SELECT {TOTALS} FROM perf)"


@query(
    "kpi_product_summary",
    ONE + """
SELECT r AS total_revenue, p AS total_profit, ROUND(m, 6) AS avg_profit_margin, ROUND(roi, 6) AS avg_roi,
       CAST(n AS BIGINT) AS total_transactions, CAST(q AS BIGINT) AS total_quantity_sold, ROUND(ret, 6) AS avg_return_rate
FROM o""",
)
def kpi_product_summary(spark, d):
    return rounded(K.product_summary(performance(spark, d)), "avg_profit_margin", "avg_roi", "avg_return_rate")


COMPARED = "WITH" + SALES + """
, last AS (SELECT CAST(MAX(sale_date) AS DATE) AS d FROM sales),
w AS (
  SELECT SUM(revenue) FILTER (WHERE CAST(sale_date AS DATE) > d - 365) AS rn,
         SUM(revenue) FILTER (WHERE CAST(sale_date AS DATE) <= d - 365) AS rp,
         SUM(revenue - cost) FILTER (WHERE CAST(sale_date AS DATE) > d - 365) AS pn,
         SUM(revenue - cost) FILTER (WHERE CAST(sale_date AS DATE) <= d - 365) AS pp
  FROM sales, last WHERE CAST(sale_date AS DATE) > d - 730
), l AS (
  SELECT 'revenue' AS measure, CAST(rn AS DOUBLE) AS value, CAST(rp AS DOUBLE) AS previous FROM w
  UNION ALL SELECT 'profit', CAST(pn AS DOUBLE), CAST(pp AS DOUBLE) FROM w
), compared AS (
  SELECT *, (value - previous) / previous * 100.0 AS change,
         CASE WHEN value > previous THEN 'up' WHEN value < previous THEN 'down' ELSE 'stable' END AS trend,
         CASE WHEN value > previous THEN 'healthy' ELSE 'warning' END AS status FROM l
)
"""


def compared(spark, d):
    sales = sales_fact(spark, d).withColumn("profit", F.col("revenue") - F.col("cost"))
    return K.compare_periods(sales, {"revenue": "revenue", "profit": "profit"}, "sale_date", 365)


@query("kpi_compare", COMPARED + "SELECT * FROM compared")
def kpi_compare(spark, d):
    return compared(spark, d)


def kpi_rows(source: str, category: str, rows: list[tuple[str, str, str, str]]) -> str:
    parts = [
        f"SELECT '{category}' AS category, '{k}' AS kpi, ROUND({v}, 6) AS value, '{u}' AS unit,"
        f" CAST(NULL AS DOUBLE) AS change, CAST(NULL AS VARCHAR) AS trend, {s} AS status FROM {source}"
        for k, v, u, s in rows
    ]
    return " UNION ALL ".join(parts)


FINANCIAL = [
    ("revenue", "r", "USD", "'neutral'"),
    ("profit", "p", "USD", "'neutral'"),
    ("profit_margin", "p / r * 100.0", "%", "CASE WHEN p / r * 100.0 > 20 THEN 'healthy' ELSE 'warning' END"),
    ("cost", "r - p", "USD", "'neutral'"),
    ("gross_margin", "m", "%", "'healthy'"),
    ("roi", "roi", "%", "'healthy'"),
]
OPERATIONAL = [
    ("transactions", "n", "count", "'healthy'"),
    ("units_sold", "q", "units", "'healthy'"),
    ("avg_transaction_value", "r / n", "USD", "'healthy'"),
    ("return_rate", "ret", "%", "'healthy'"),
]
PRODUCT = [
    ("total_products", "c", "count", "'neutral'"),
    ("high_performers", "high", "count", "'healthy'"),
    ("avg_product_revenue", "r / c", "USD", "'healthy'"),
    ("avg_market_share", "share", "%", "'healthy'"),
]
SALES_ROWS = [
    ("total_sales", "t", "USD", "'healthy'"),
    ("sales_transactions", "CAST(n AS DOUBLE)", "count", "'healthy'"),
    ("avg_deal_size", "t / n", "USD", "'healthy'"),
]
SOLD = ORDER_SALES + ", s AS (SELECT CAST(SUM(total_amount) AS DOUBLE) AS t, COUNT(*) AS n FROM order_sales)"


@query("kpi_financial", ONE + kpi_rows("o", "financial", FINANCIAL))
def kpi_financial(spark, d):
    return rounded(K.financial_kpis(performance(spark, d)), "value")


@query("kpi_operational", ONE + kpi_rows("o", "operational", OPERATIONAL))
def kpi_operational(spark, d):
    return rounded(K.operational_kpis(performance(spark, d)), "value")


@query("kpi_product", ONE + kpi_rows("o", "product", PRODUCT))
def kpi_product(spark, d):
    return rounded(K.product_kpis(performance(spark, d)), "value")


@query("kpi_sales", "WITH" + SOLD + " " + kpi_rows("s", "sales", SALES_ROWS))
def kpi_sales(spark, d):
    return rounded(K.sales_kpis(order_sales(spark, d), "total_amount"), "value")


@query(
    "kpi_sales_no_data",
    "SELECT 'sales' AS category, 'no_data' AS kpi, CAST(NULL AS DOUBLE) AS value, 'count' AS unit,"
    " CAST(NULL AS DOUBLE) AS change, CAST(NULL AS VARCHAR) AS trend, 'no_data' AS status"
    " WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))",
)
def kpi_sales_no_data(spark, d):
    """Sales to customers that the customer table does not know: there are none, and the block says so."""
    known = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return K.sales_kpis(order_sales(spark, d).join(known, "user_id", "left_anti"), "total_amount")


DAYS = 180
CUSTOMERS = "WITH" + ORDER_SALES + f"""
, last AS (SELECT CAST(MAX(order_date) AS DATE) AS d FROM order_sales),
a AS (
  SELECT user_id, MIN(CAST(order_date AS DATE)) AS first_day, COUNT(*) AS orders, SUM(total_amount) AS spend,
         COUNT(*) FILTER (WHERE d - CAST(order_date AS DATE) < {DAYS}) AS nn,
         COUNT(*) FILTER (WHERE d - CAST(order_date AS DATE) >= {DAYS} AND d - CAST(order_date AS DATE) < {2 * DAYS}) AS np,
         COUNT(*) FILTER (WHERE d - CAST(order_date AS DATE) >= {2 * DAYS}) AS nl
  FROM order_sales, last GROUP BY user_id
)
"""
CUSTOMER = [
    ("total_customers", "total", "count", "'neutral'"),
    ("active_customers", "act", "count", "'healthy'"),
    ("new_customers", "new", "count", "'healthy'"),
    ("churned_customers", "churned", "count", "'neutral'"),
    ("reactivated_customers", "back", "count", "'neutral'"),
    ("customer_retention_rate", "kept / prev * 100.0", "%",
     "CASE WHEN kept / prev * 100.0 > 85 THEN 'healthy' ELSE 'warning' END"),
    ("churn_rate", "churned / prev * 100.0", "%",
     "CASE WHEN churned / prev * 100.0 > 15 THEN 'warning' ELSE 'healthy' END"),
    ("customer_lifetime_value", "spend / total", "USD", "'healthy'"),
]
CUSTOMER_ONE = """
, c AS (
  SELECT CAST(COUNT(*) AS DOUBLE) AS total, CAST(SUM(spend) AS DOUBLE) AS spend,
         CAST(COUNT(*) FILTER (WHERE nn > 0) AS DOUBLE) AS act,
         CAST(COUNT(*) FILTER (WHERE nn > 0 AND np = 0 AND nl = 0) AS DOUBLE) AS new,
         CAST(COUNT(*) FILTER (WHERE np > 0 AND nn = 0) AS DOUBLE) AS churned,
         CAST(COUNT(*) FILTER (WHERE nn > 0 AND np = 0 AND nl > 0) AS DOUBLE) AS back,
         CAST(COUNT(*) FILTER (WHERE nn > 0 AND np > 0) AS DOUBLE) AS kept,
         CAST(COUNT(*) FILTER (WHERE np > 0) AS DOUBLE) AS prev FROM a
)
"""


def customers(spark, d):
    return K.customer_activity(order_sales(spark, d), "user_id", "total_amount", "order_date", DAYS)


@query("kpi_customer", CUSTOMERS + CUSTOMER_ONE + kpi_rows("c", "customer", CUSTOMER))
def kpi_customer(spark, d):
    return rounded(K.customer_kpis(customers(spark, d)), "value")


@query(
    "kpi_segments",
    CUSTOMERS + """
SELECT c_mktsegment AS segment, COUNT(*) AS customers, CAST(SUM(spend) AS DOUBLE) AS revenue,
       CAST(SUM(spend) AS DOUBLE) / CAST(SUM(orders) AS DOUBLE) AS avg_order_value,
       CAST(COUNT(*) FILTER (WHERE np > 0 AND nn = 0) AS DOUBLE) / COUNT(*) FILTER (WHERE np > 0) * 100.0 AS churn_rate,
       CAST(COUNT(*) FILTER (WHERE np > 0 AND nn > 0) AS DOUBLE) / COUNT(*) FILTER (WHERE np > 0) * 100.0 AS retention_rate,
       CAST(SUM(spend) AS DOUBLE) / COUNT(*) AS lifetime_value
FROM a JOIN customer ON user_id = c_custkey GROUP BY 1""",
)
def kpi_segments(spark, d):
    return K.customer_segments(customers(spark, d), table(spark, d, "customer"), "c_custkey", "c_mktsegment")


def _daily(name: str, days: int) -> None:
    sql = "WITH" + SALES + f"""
, last AS (SELECT CAST(MAX(sale_date) AS DATE) AS d FROM sales),
x AS (SELECT CAST(sale_date AS DATE) AS day, revenue, cost FROM sales, last WHERE CAST(sale_date AS DATE) > d - {days}),
spine AS (SELECT CAST(unnest(generate_series(CAST(MIN(day) AS TIMESTAMP), CAST(MAX(day) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS date FROM x)
SELECT date, COALESCE(CAST(SUM(revenue) AS DOUBLE), 0) AS revenue, COALESCE(CAST(SUM(cost) AS DOUBLE), 0) AS cost,
       COALESCE(CAST(SUM(revenue) - SUM(cost) AS DOUBLE), 0) AS profit, COUNT(revenue) AS transactions,
       isodow(date) < 6 AS is_weekday
FROM spine LEFT JOIN x ON day = date GROUP BY date"""

    @query(name, sql)
    def run(spark, d):
        return K.daily_profit(sales_fact(spark, d), "revenue", "cost", "sale_date", days)


_daily("kpi_daily_30d", 30)
_daily("kpi_daily_12m", 365)

ALL = (
    ONE.rstrip() + "," + SOLD.removeprefix("\n") + ", k AS ("
    + " UNION ALL ".join([
        kpi_rows("o", "financial", FINANCIAL),
        kpi_rows("o", "operational", OPERATIONAL),
        kpi_rows("o", "product", PRODUCT),
        kpi_rows("s", "sales", SALES_ROWS),
    ])
    + ") "
)


def dashboard(spark, d):
    return rounded(K.dashboard(performance(spark, d), order_sales(spark, d), "total_amount"), "value")


@query("kpi_dashboard", ALL + "SELECT * FROM k")
def kpi_dashboard(spark, d):
    return dashboard(spark, d)


@query(
    "kpi_minimal",
    ALL + "SELECT * FROM k WHERE (category = 'financial' AND kpi IN ('revenue', 'profit', 'profit_margin'))"
    " OR (category = 'operational' AND kpi IN ('transactions', 'avg_transaction_value'))"
    " OR (category = 'product' AND kpi IN ('total_products', 'high_performers'))"
    " OR (category = 'sales' AND kpi IN ('total_sales', 'conversion_rate'))",
)
def kpi_minimal(spark, d):
    return K.in_format(dashboard(spark, d), form="minimal")


@query("kpi_summary", ALL + "SELECT category, COUNT(*) AS kpis FROM k GROUP BY category")
def kpi_summary(spark, d):
    return K.kpi_counts(dashboard(spark, d))


RULES = [
    ("financial", "profit_margin", "value", "<", 20.0, "medium", "Profit margin below target"),
    ("operational", "return_rate", "value", ">", 10.0, "medium", "High return rate"),
]


@query(
    "kpi_insights",
    ALL + " UNION ALL ".join(
        f"SELECT category, kpi, '{p}' AS priority, '{t}' AS title, {f} AS measured, CAST({n} AS DOUBLE) AS \"limit\""
        f" FROM k WHERE category = '{c}' AND kpi = '{k}' AND {f} {o} {n}"
        for c, k, f, o, n, p, t in RULES
    ),
)
def kpi_insights(spark, d):
    """Of the fixed rules, those on margin and returns can fire on these KPIs."""
    return K.apply_rules(dashboard(spark, d), K.INSIGHTS)


CHANGED = (
    PERFORMANCE + f", o AS (SELECT {TOTALS} FROM perf)" + ", " + COMPARED.split("WITH" + SALES + "\n, ", 1)[1]
)


@query(
    "kpi_highlights",
    CHANGED + """
SELECT 'financial' AS category, 'revenue' AS kpi, 'positive' AS priority, 'Revenue up vs previous period' AS title,
       ROUND(change, 6) AS measured, CAST(10 AS DOUBLE) AS "limit"
FROM compared WHERE measure = 'revenue' AND change > 10""",
)
def kpi_highlights(spark, d):
    """The fixed highlights over the financial KPIs compared with the year before."""
    kpis = K.financial_kpis(performance(spark, d), compared(spark, d))
    return rounded(K.apply_rules(kpis, K.HIGHLIGHTS), "measured")


@query(
    "kpi_financial_compared",
    CHANGED + """
SELECT kpi, ROUND(change, 6) AS change, trend, status FROM (
  SELECT measure AS kpi, change, trend, status FROM compared)""",
)
def kpi_financial_compared(spark, d):
    kpis = K.financial_kpis(performance(spark, d), compared(spark, d))
    return rounded(
        kpis.filter(F.col("kpi").isin("revenue", "profit")).select("kpi", "change", "trend", "status"), "change"
    )


def metric_rows(source: str, rows: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{k}' AS metric, ROUND({v}, 6) AS value FROM {source}" for k, v in rows.items()
    )


@query(
    "report_executive",
    ONE + metric_rows("o", {
        "total_revenue": "r", "total_profit": "p", "profit_margin": "p / r * 100.0", "avg_profit_margin": "m",
        "avg_roi": "roi", "total_transactions": "n",
    }),
)
def report_executive(spark, d):
    return rounded(P.executive_summary(performance(spark, d)), "value")


@query(
    "report_financial",
    ONE + metric_rows("o", {
        "total_revenue": "r", "total_profit": "p", "avg_profit_margin": "m", "roi": "roi", "total_cost": "r - p",
        "revenue_per_day": "r / 90.0::DOUBLE", "gross_margin": "p / r * 100.0",
        "cost_of_revenue": "(r - p) * 0.65::DOUBLE", "operating_expenses": "(r - p) * 0.35::DOUBLE",
        "cost_per_transaction": "(r - p) / n", "operating_margin": "p * 0.75::DOUBLE / r * 100.0",
        "net_margin": "p * 0.60::DOUBLE / r * 100.0",
    }),
)
def report_financial(spark, d):
    return rounded(P.financial_report(performance(spark, d), 90), "value")


@query(
    "report_sales",
    "WITH" + SOLD + " " + metric_rows("s", {
        "total_sales_volume": "t", "total_transactions": "CAST(n AS DOUBLE)", "average_deal_size": "t / n",
    }),
)
def report_sales(spark, d):
    return rounded(P.sales_report(order_sales(spark, d), "total_amount"), "value")


@query(
    "report_operational",
    ONE + metric_rows("o", {
        "total_transactions": "n", "total_units_processed": "q", "avg_transaction_size": "q / n", "return_rate": "ret",
    }),
)
def report_operational(spark, d):
    return rounded(P.operational_report(performance(spark, d)), "value")


@query(
    "report_product_overview",
    ONE + metric_rows("o", {
        "total_products": "c", "active_products": "active", "total_revenue": "r", "total_profit": "p",
        "avg_return_rate": "ret", "avg_product_revenue": "r / c",
    }),
)
def report_product_overview(spark, d):
    return rounded(P.product_overview(performance(spark, d)), "value")


@query(
    "report_category_summary",
    PERFORMANCE + f"""
SELECT category, {money('total_revenue')} AS total_revenue, {money('total_profit')} AS total_profit,
       CAST(SUM(transaction_count) AS BIGINT) AS transaction_count, SUM(total_quantity) AS total_quantity
FROM perf WHERE category IS NOT NULL GROUP BY category""",
)
def report_category_summary(spark, d):
    return P.category_summary(performance(spark, d))


@query(
    "report_category_analysis",
    PERFORMANCE + f"""
SELECT category, {money('total_revenue')} AS total_revenue, {money('total_profit')} AS total_profit,
       ROUND(AVG(profit_margin), 6) AS profit_margin, CAST(SUM(transaction_count) AS BIGINT) AS transaction_count,
       SUM(total_quantity) AS total_quantity, ROUND(AVG(market_share), 8) AS market_share, ROUND(AVG(roi), 6) AS roi
FROM perf WHERE category IS NOT NULL GROUP BY category""",
)
def report_category_analysis(spark, d):
    out = rounded(P.category_analysis(performance(spark, d)), "profit_margin", "roi")
    return rounded(out, "market_share", digits=8)


TIER = "product, category, total_revenue, profit_margin, roi, market_share, return_rate"


@query(
    "report_product_tiers",
    PERFORMANCE + f"""
SELECT 'top_performers' AS tier, {TIER} FROM (SELECT * FROM perf ORDER BY total_revenue DESC, product LIMIT 10)
UNION ALL SELECT 'rising_stars', {TIER} FROM (SELECT * FROM perf ORDER BY roi DESC, product LIMIT 5)
UNION ALL SELECT 'underperformers', {TIER} FROM (SELECT * FROM perf ORDER BY total_revenue, product LIMIT 10)""",
)
def report_product_tiers(spark, d):
    return P.tiers(performance(spark, d))


@query(
    "report_top_profit",
    PERFORMANCE + """
SELECT product, total_profit, profit_margin FROM perf ORDER BY total_profit DESC, product LIMIT 10""",
)
def report_top_profit(spark, d):
    return P.top_by(performance(spark, d), "total_profit", 10, ["product", "total_profit", "profit_margin"])


@query(
    "report_top_revenue",
    PERFORMANCE + """
SELECT product, total_revenue, profit_margin, market_share FROM perf ORDER BY total_revenue DESC, product LIMIT 5""",
)
def report_top_revenue(spark, d):
    return P.top_by(
        performance(spark, d), "total_revenue", 5, ["product", "total_revenue", "profit_margin", "market_share"]
    )


@query(
    "report_chart_category",
    PERFORMANCE + f"""
, c AS (SELECT category, {money('total_revenue')} AS r, {money('total_profit')} AS p FROM perf GROUP BY category)
SELECT 'Revenue' AS series, category AS label, r AS value FROM c
UNION ALL SELECT 'Cost', category, r - p FROM c""",
)
def report_chart_category(spark, d):
    return P.category_series(performance(spark, d))


@query(
    "report_chart_portfolio",
    PERFORMANCE + """
SELECT substring(CAST(product AS VARCHAR), 1, 20) AS label, market_share AS x, total_revenue AS y
FROM perf ORDER BY total_revenue DESC, product LIMIT 20""",
)
def report_chart_portfolio(spark, d):
    return P.portfolio_series(performance(spark, d))


STAGES = ("view", "click", "purchase")


@query(
    "report_funnel",
    """
WITH a AS (SELECT user_id AS u, MIN(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1),
b AS (SELECT u, MIN(ts) AS t FROM a JOIN events ON user_id = u AND event_type = 'click' AND ts >= t GROUP BY 1),
c AS (SELECT u, MIN(ts) AS t FROM b JOIN events ON user_id = u AND event_type = 'purchase' AND ts >= t GROUP BY 1),
n AS (SELECT (SELECT COUNT(*) FROM a) AS n0, (SELECT COUNT(*) FROM b) AS n1, (SELECT COUNT(*) FROM c) AS n2)
SELECT 1 AS position, 'view' AS stage, n0 AS users, n0 / n0::DOUBLE * 100.0 AS step_conversion, n0 / n0::DOUBLE * 100.0 AS total_conversion FROM n
UNION ALL SELECT 2, 'click', n1, n1 / n0::DOUBLE * 100.0, n1 / n0::DOUBLE * 100.0 FROM n
UNION ALL SELECT 3, 'purchase', n2, n2 / n1::DOUBLE * 100.0, n2 / n0::DOUBLE * 100.0 FROM n""",
)
def report_funnel(spark, d):
    return P.funnel(events(spark, d), "user_id", "event_type", "ts", STAGES)


@query(
    "report_records",
    "WITH" + ORDER_SALES + """
SELECT '{"order_date":"' || strftime(CAST(order_date AS DATE), '%Y-%m-%d') || '","transactions":' || CAST(COUNT(*) AS VARCHAR) || '}' AS record
FROM order_sales GROUP BY CAST(order_date AS DATE)""",
)
def report_records(spark, d):
    by = order_sales(spark, d).groupBy(F.col("order_date").cast("date").alias("order_date")).agg(
        F.count(F.lit(1)).alias("transactions")
    )
    return filters.as_records(by)
