"""Product performance over sales lines."""

from __future__ import annotations

from ledgerlens.operators import products as P
from ledgerlens.operators.filters import sorted_top
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import SALES, sales_fact

PERFORMANCE = "WITH" + SALES + """
, totals AS (
  SELECT product, SUM(revenue) AS r, COUNT(revenue) AS n, SUM(quantity) AS q, COUNT(quantity) AS nq,
         SUM(cost) AS c, SUM(CAST(is_returned AS INTEGER)) AS ret,
         arg_min(category, sale_date) AS category
  FROM sales GROUP BY product
), perf AS (
  SELECT product, category, CAST(r AS DOUBLE) AS total_revenue, CAST(n AS BIGINT) AS transaction_count,
         CAST(r AS DOUBLE) / n AS avg_revenue, CAST(q AS DOUBLE) AS total_quantity,
         CAST(q AS DOUBLE) / nq AS avg_quantity, CAST(c AS DOUBLE) AS total_cost,
         CAST(ret AS BIGINT) AS return_count, CAST(r - c AS DOUBLE) AS total_profit,
         CAST(r - c AS DOUBLE) / CAST(r AS DOUBLE) * 100.0 AS profit_margin,
         CAST(r - c AS DOUBLE) / CAST(c AS DOUBLE) * 100.0 AS roi,
         CAST(ret AS DOUBLE) / n * 100.0 AS return_rate, CAST(r AS DOUBLE) / CAST(q AS DOUBLE) AS avg_price,
         CAST(r AS DOUBLE) / CAST((SELECT SUM(revenue) FROM sales) AS DOUBLE) * 100.0 AS market_share,
         CAST(dense_rank() OVER (ORDER BY r DESC) AS INTEGER) AS revenue_rank,
         CAST(dense_rank() OVER (ORDER BY q DESC) AS INTEGER) AS quantity_rank,
         CAST(dense_rank() OVER (ORDER BY r - c DESC) AS INTEGER) AS profit_rank
  FROM totals
)
"""


def performance(spark, d, **options):
    return P.product_performance(
        sales_fact(spark, d),
        "product",
        revenue_column="revenue",
        quantity_column="quantity",
        category_column="category",
        cost_column="cost",
        return_column="is_returned",
        order_column="sale_date",
        **options,
    )


@query("product_performance", PERFORMANCE + "SELECT * FROM perf")
def product_performance(spark, d):
    return performance(spark, d)


@query("product_top_n", PERFORMANCE + "SELECT * FROM perf ORDER BY total_revenue DESC, product LIMIT 10")
def product_top_n(spark, d):
    return performance(spark, d, top_n=10)


@query(
    "product_performance_split",
    PERFORMANCE + "SELECT product, market_share, revenue_rank, quantity_rank, profit_rank FROM perf",
)
def product_performance_split(spark, d):
    """Ranks and shares by the plan for more products than one task can sort."""
    return performance(spark, d, many_products=True).select(
        "product", "market_share", "revenue_rank", "quantity_rank", "profit_rank"
    )


@query(
    "product_performance_brand",
    "WITH" + SALES + """
SELECT brand AS product, CAST(SUM(revenue) AS DOUBLE) AS total_revenue, COUNT(*) AS transaction_count,
       CAST(SUM(revenue) AS DOUBLE) / COUNT(*) AS avg_revenue,
       CAST(SUM(revenue) AS DOUBLE) / CAST((SELECT SUM(revenue) FROM sales) AS DOUBLE) * 100.0 AS market_share
FROM sales GROUP BY brand""",
)
def product_performance_brand(spark, d):
    return P.product_performance(
        sales_fact(spark, d), "brand", ["revenue", "market_share"], include_rankings=False
    )


@query(
    "product_sorted_by_roi",
    PERFORMANCE + "SELECT * FROM perf ORDER BY roi ASC, product LIMIT 25",
)
def product_sorted_by_roi(spark, d):
    return sorted_top(performance(spark, d), "roi", "asc", 25, ties=["product"])


@query(
    "product_report",
    PERFORMANCE + """
SELECT COUNT(*) AS total_products, ROUND(SUM(total_revenue), 2) AS total_revenue,
       SUM(total_quantity) AS total_quantity, ROUND(SUM(total_profit), 2) AS total_profit
FROM (SELECT * FROM perf ORDER BY total_revenue DESC, product LIMIT 100)""",
)
def product_report(spark, d):
    from pyspark.sql import functions as F

    out = P.product_report(performance(spark, d, top_n=100))
    return out.withColumns({c: F.round(c, 2) for c in ("total_revenue", "total_profit")})


@query(
    "product_trends",
    "WITH" + SALES + """
, t AS (
  SELECT product, date_trunc('month', sale_date) AS m, CAST(SUM(revenue) AS DOUBLE) AS revenue,
         CAST(SUM(quantity) AS DOUBLE) AS quantity
  FROM sales GROUP BY 1, 2
), l AS (
  SELECT *, LAG(revenue) OVER w AS br, LAG(quantity) OVER w AS bq FROM t
  WINDOW w AS (PARTITION BY product ORDER BY m)
)
SELECT product, strftime(m, '%Y-%m') AS period, revenue, quantity,
       CASE WHEN br <> 0 THEN (revenue - br) / br * 100.0 END AS revenue_growth,
       CASE WHEN bq <> 0 THEN (quantity - bq) / bq * 100.0 END AS quantity_growth
FROM l""",
)
def product_trends(spark, d):
    return P.product_trends(sales_fact(spark, d), "product", "revenue", "quantity", "sale_date", "M")
