"""Report sections as tables, from product performance, sales and event rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ledgerlens.functions.numeric import percent, ratio
from ledgerlens.operators.filters import largest, smallest
from ledgerlens.operators.kpis import exact_sum
from ledgerlens.plans.groups import lookup

# Shares of the cost and of the profit used by the financial report.
COST_OF_REVENUE, OPERATING_EXPENSES = 0.65, 0.35
OPERATING_SHARE, NET_SHARE = 0.75, 0.60


def _metrics(one: DataFrame, names: Sequence[str]) -> DataFrame:
    """A one-row table as (metric, value) rows."""
    cells = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return one.select(F.inline(F.array(*cells)))


def executive_summary(performance: DataFrame) -> DataFrame:
    one = performance.agg(
        exact_sum("total_revenue").alias("total_revenue"),
        exact_sum("total_profit").alias("total_profit"),
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.avg("roi").alias("avg_roi"),
        F.sum("transaction_count").alias("total_transactions"),
    ).withColumn("profit_margin", percent(F.col("total_profit"), F.col("total_revenue"), 0.0))
    return _metrics(
        one,
        ["total_revenue", "total_profit", "profit_margin", "avg_profit_margin", "avg_roi", "total_transactions"],
    )


def financial_report(performance: DataFrame, period_days: int) -> DataFrame:
    """Revenue per day, profitability, cost split and ratios as (metric, value) rows."""
    one = performance.agg(
        exact_sum("total_revenue").alias("total_revenue"),
        exact_sum("total_profit").alias("total_profit"),
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.avg("roi").alias("roi"),
        F.sum("transaction_count").alias("__n"),
    )
    revenue, profit = F.col("total_revenue"), F.col("total_profit")
    cost = F.col("total_cost")
    one = one.withColumn("total_cost", revenue - profit)
    one = one.withColumns(
        {
            "revenue_per_day": revenue / F.lit(float(period_days)),
            "gross_margin": percent(profit, revenue, 0.0),
            "cost_of_revenue": cost * COST_OF_REVENUE,
            "operating_expenses": cost * OPERATING_EXPENSES,
            "cost_per_transaction": ratio(cost, F.col("__n"), 0.0),
            "operating_margin": percent(profit * OPERATING_SHARE, revenue, 0.0),
            "net_margin": percent(profit * NET_SHARE, revenue, 0.0),
        }
    )
    return _metrics(one, [c for c in one.columns if not c.startswith("__")])


def category_summary(performance: DataFrame) -> DataFrame:
    """Sums per category, of the products that have one."""
    return (
        performance.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            exact_sum("total_revenue").alias("total_revenue"),
            exact_sum("total_profit").alias("total_profit"),
            F.sum("transaction_count").alias("transaction_count"),
            F.sum("total_quantity").alias("total_quantity"),
        )
    )


def category_analysis(performance: DataFrame) -> DataFrame:
    """Category sums with mean margin, share and ROI."""
    return (
        performance.filter(F.col("category").isNotNull())
        .groupBy("category")
        .agg(
            exact_sum("total_revenue").alias("total_revenue"),
            exact_sum("total_profit").alias("total_profit"),
            F.avg("profit_margin").alias("profit_margin"),
            F.sum("transaction_count").alias("transaction_count"),
            F.sum("total_quantity").alias("total_quantity"),
            F.avg("market_share").alias("market_share"),
            F.avg("roi").alias("roi"),
        )
    )


def category_series(performance: DataFrame) -> DataFrame:
    """Chart series: (series, label, value) for revenue and cost by category."""
    by = category_summary(performance)
    revenue, profit = F.col("total_revenue"), F.col("total_profit")
    cells = F.array(
        F.struct(F.lit("Revenue").alias("series"), F.col("category").alias("label"), revenue.alias("value")),
        F.struct(F.lit("Cost").alias("series"), F.col("category").alias("label"), (revenue - profit).alias("value")),
    )
    return by.select(F.inline(cells))


def portfolio_series(performance: DataFrame, points: int = 20) -> DataFrame:
    """Chart points: market share and revenue of the largest products, short labels."""
    top = largest(performance, "total_revenue", points, ["product"])
    return top.select(
        F.substring(F.col("product").cast("string"), 1, 20).alias("label"),
        F.col("market_share").alias("x"),
        F.col("total_revenue").alias("y"),
    )


def top_by(performance: DataFrame, column: str, n: int, columns: Sequence[str]) -> DataFrame:
    return largest(performance, column, n, ["product"]).select(*columns)


def tiers(performance: DataFrame) -> DataFrame:
    """Top performers, rising stars and underperformers with their place in the tier."""
    parts = [
        ("top_performers", largest(performance, "total_revenue", 10, ["product"])),
        ("rising_stars", largest(performance, "roi", 5, ["product"])),
        ("underperformers", smallest(performance, "total_revenue", 10, ["product"])),
    ]
    columns = ("product", "category", "total_revenue", "profit_margin", "roi", "market_share", "return_rate")
    out = None
    for name, part in parts:
        rows = part.select(F.lit(name).alias("tier"), *columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def product_overview(performance: DataFrame) -> DataFrame:
    """Portfolio: products, active products, revenue, profit, mean revenue and return rate."""
    one = performance.agg(
        F.count(F.lit(1)).alias("total_products"),
        F.count_if(F.col("total_revenue") > 0).alias("active_products"),
        exact_sum("total_revenue").alias("total_revenue"),
        exact_sum("total_profit").alias("total_profit"),
        F.avg("return_rate").alias("avg_return_rate"),
    )
    one = one.withColumn("avg_product_revenue", ratio(F.col("total_revenue"), F.col("total_products"), 0.0))
    return _metrics(one, one.columns)


def operational_report(performance: DataFrame) -> DataFrame:
    one = performance.agg(
        F.sum("transaction_count").alias("total_transactions"),
        F.sum("total_quantity").alias("total_units_processed"),
        F.avg("return_rate").alias("return_rate"),
    )
    size = ratio(F.col("total_units_processed"), F.col("total_transactions"), 0.0)
    return _metrics(one.withColumn("avg_transaction_size", size), [
        "total_transactions", "total_units_processed", "avg_transaction_size", "return_rate",
    ])


def sales_report(sales: DataFrame, amount_column: str) -> DataFrame:
    one = sales.agg(
        F.sum(amount_column).cast("double").alias("total_sales_volume"),
        F.count(F.lit(1)).alias("total_transactions"),
    )
    deal = ratio(F.col("total_sales_volume"), F.col("total_transactions"), 0.0)
    return _metrics(one.withColumn("average_deal_size", deal), [
        "total_sales_volume", "total_transactions", "average_deal_size",
    ])


def funnel(
    events: DataFrame, user_column: str, type_column: str, date_column: str, stages: Sequence[str]
) -> DataFrame:
    """Users that reach each stage after the stages before it, with step and overall conversion.

    A stage is reached by the first of its events that is not earlier than the stage before was
    reached. Each stage costs one aggregate per user, over the user's events of that stage only.
    """
    rows = events.filter(F.col(type_column).isin(*stages)).select(
        F.col(user_column).alias("user"), F.col(type_column).alias("stage"), F.col(date_column).alias("ts")
    ).filter(F.col("user").isNotNull())
    reached = rows.filter(F.col("stage") == stages[0]).groupBy("user").agg(F.min("ts").alias("t0"))
    for i, stage in enumerate(stages[1:], 1):
        here = rows.filter(F.col("stage") == stage).select("user", "ts")
        prior = reached.select("user", F.col(f"t{i - 1}").alias("__after"))
        later = lookup(here, prior, ["user"]).filter(F.col("ts") >= F.col("__after"))
        step = later.groupBy("user").agg(F.min("ts").alias(f"t{i}"))
        reached = reached.join(step, "user", "left")
    one = reached.agg(*[F.count(f"t{i}").alias(f"n{i}") for i in range(len(stages))])
    cells = []
    for i, stage in enumerate(stages):
        before = F.col(f"n{max(i - 1, 0)}")
        cells.append(
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(stage).alias("stage"),
                F.col(f"n{i}").alias("users"),
                percent(F.col(f"n{i}"), before, 0.0).alias("step_conversion"),
                percent(F.col(f"n{i}"), F.col("n0"), 0.0).alias("total_conversion"),
            )
        )
    return one.select(F.inline(F.array(*cells)))
