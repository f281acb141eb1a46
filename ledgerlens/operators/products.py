"""Product performance: totals, derived ratios, shares, ranks, trends."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlens.functions.numeric import as_number, percent, ratio, require_columns, rounded
from ledgerlens.functions.periods import check_period, period_name, period_start
from ledgerlens.operators.filters import date_of
from ledgerlens.plans.groups import TASK_ROWS, few_groups
from ledgerlens.plans.ranks import dense_ranks

METRICS = ("revenue", "quantity", "profit", "margin", "roi", "return_rate", "avg_price", "market_share")


def _chosen(metrics, revenue, quantity, cost, returned) -> set[str]:
    available = {
        "revenue": bool(revenue),
        "quantity": bool(quantity),
        "profit": bool(revenue and cost),
        "margin": bool(revenue and cost),
        "roi": bool(revenue and cost),
        "return_rate": bool(returned),
        "avg_price": bool(revenue and quantity),
        "market_share": bool(revenue),
    }
    if metrics is None:
        return {m for m, ok in available.items() if ok}
    unknown = [m for m in metrics if m not in available]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; valid: {METRICS}")
    return {m for m in metrics if available[m]}


def product_totals(
    df: DataFrame,
    product_column: str,
    revenue_column: str,
    quantity_column: str | None = None,
    cost_column: str | None = None,
    return_column: str | None = None,
    category_column: str | None = None,
    order_column: str | None = None,
) -> DataFrame:
    """Sums per product, and the category of its first row that has one.

    With a category the rows are summed per (product, category) first, which keeps the pass
    over the facts a hash aggregate of numbers; picking the first category happens on the
    few rows that are left.
    """
    sums = {"total_revenue": revenue_column, "total_quantity": quantity_column,
            "total_cost": cost_column, "return_count": return_column}
    sums = {k: c for k, c in sums.items() if c}
    numbers = {c: as_number(df, c) for c in sums.values()}
    facts = df.filter(F.col(product_column).isNotNull())
    parts = [F.sum(numbers[c]).alias(k) for k, c in sums.items()]
    parts.append(F.count(numbers[revenue_column]).alias("transaction_count"))
    if quantity_column:
        parts.append(F.count(numbers[quantity_column]).alias("__nq"))
    product = F.col(product_column).alias("product")
    if not category_column:
        return facts.groupBy(product).agg(*parts)
    first = F.min(order_column) if order_column else F.lit(0)
    pairs = facts.groupBy(product, F.col(category_column).alias("category")).agg(
        *parts, first.alias("__first")
    )
    named = F.when(F.col("category").isNotNull(), F.struct("__first", "category"))
    again = [F.sum(k).alias(k) for k in (*sums, "transaction_count")]
    if quantity_column:
        again.append(F.sum("__nq").alias("__nq"))
    return (
        pairs.groupBy("product")
        .agg(*again, F.min(named).alias("__c"))
        .withColumn("category", F.col("__c")["category"])
        .drop("__c")
    )


def product_performance(
    df: DataFrame,
    product_column: str = "product",
    metrics: Sequence[str] | None = None,
    revenue_column: str = "revenue",
    quantity_column: str | None = None,
    category_column: str | None = None,
    cost_column: str | None = None,
    return_column: str | None = None,
    order_column: str | None = None,
    top_n: int | None = None,
    include_rankings: bool = True,
    round_decimals: int | None = None,
    many_products: bool | None = None,
) -> DataFrame:
    """One row per product. Shares and ranks are over all products, before ``top_n``."""
    require_columns(
        df, product_column, revenue_column, quantity_column, category_column, cost_column, return_column
    )
    chosen = _chosen(metrics, revenue_column, quantity_column, cost_column, return_column)
    needs_cost = cost_column if chosen & {"profit", "margin", "roi"} else None
    needs_quantity = quantity_column if chosen & {"quantity", "avg_price"} else None
    out = product_totals(
        df,
        product_column,
        revenue_column,
        needs_quantity,
        needs_cost,
        return_column if "return_rate" in chosen else None,
        category_column,
        order_column,
    )
    if many_products is None:
        many_products = not few_groups(df, [product_column], TASK_ROWS)

    revenue, quantity, cost = F.col("total_revenue"), F.col("total_quantity"), F.col("total_cost")
    profit = revenue - cost
    columns = {"avg_revenue": ratio(revenue, F.col("transaction_count"))}
    if "quantity" in chosen:
        columns["avg_quantity"] = ratio(quantity, F.col("__nq"))
    if "profit" in chosen:
        columns["total_profit"] = profit
    if "margin" in chosen:
        columns["profit_margin"] = percent(profit, revenue, 0.0)
    if "roi" in chosen:
        columns["roi"] = percent(profit, cost, 0.0)
    if "return_rate" in chosen:
        columns["return_rate"] = percent(F.col("return_count"), F.col("transaction_count"), 0.0)
    if "avg_price" in chosen:
        columns["avg_price"] = ratio(revenue, quantity, 0.0)
    if "market_share" in chosen:
        if many_products:
            facts = df.filter(F.col(product_column).isNotNull())
            market = facts.agg(F.sum(as_number(df, revenue_column)).alias("t")).scalar()
        else:
            market = F.sum("total_revenue").over(W.partitionBy())
        columns["market_share"] = percent(revenue, market, 0.0)
    out = out.withColumns(columns)

    if include_rankings:
        ranks = {"revenue_rank": "total_revenue"}
        if needs_quantity:
            ranks["quantity_rank"] = "total_quantity"
        if "profit" in chosen:
            ranks["profit_rank"] = "total_profit"
        out = dense_ranks(out, ranks, split=many_products)
    if top_n and top_n > 0:
        out = out.orderBy(F.desc("total_revenue"), "product").limit(top_n)

    exact = ("total_revenue", "total_cost", "total_profit")
    counts = ("return_count", "transaction_count")
    final = []
    for c in out.columns:
        if c.startswith("__"):
            continue
        if c in exact or c in columns or c == "total_quantity":
            final.append(rounded(F.col(c), round_decimals).cast("double").alias(c))
        elif c in counts:
            final.append(F.col(c).cast("long").alias(c))
        else:
            final.append(F.col(c))
    return out.select(*final)


def product_report(performance: DataFrame) -> DataFrame:
    """Totals over the products of a performance table, after its top-n."""
    sums = {"total_revenue": "total_revenue", "total_quantity": "total_quantity", "total_profit": "total_profit"}
    return performance.agg(
        F.count(F.lit(1)).alias("total_products"),
        *[F.sum(c).alias(n) for n, c in sums.items() if c in performance.columns],
    )


def product_trends(
    df: DataFrame,
    product_column: str = "product",
    revenue_column: str | None = "revenue",
    quantity_column: str | None = None,
    date_column: str = "date",
    period: str | None = None,
    round_decimals: int | None = None,
) -> DataFrame:
    """Revenue and quantity per product and observed period, with growth on the one before.

    The window runs on one row per product and period, so a group is bounded by the calendar.
    """
    require_columns(df, product_column, revenue_column, quantity_column, date_column)
    p = check_period(period)
    measures = {"revenue": revenue_column, "quantity": quantity_column}
    measures = {k: c for k, c in measures.items() if c}
    start = period_start(date_of(df, date_column), p)
    facts = df.filter(F.col(product_column).isNotNull() & start.isNotNull())
    by = facts.groupBy(
        F.col(product_column).alias("product"), start.alias("__start")
    ).agg(*[F.sum(as_number(df, c)).alias(k) for k, c in measures.items()])
    order = W.partitionBy("product").orderBy("__start")
    growth = []
    for k in measures:
        before = F.lag(k).over(order)
        change = percent(F.col(k).cast("double") - before.cast("double"), before)
        growth.append(rounded(change, round_decimals).alias(f"{k}_growth"))
    return by.select(
        "product",
        period_name(F.col("__start"), p).alias("period"),
        *[rounded(F.col(k), round_decimals).cast("double").alias(k) for k in measures],
        *growth,
    )
