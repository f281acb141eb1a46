"""KPI roll-ups as long tables: category, kpi, value, unit, change, trend, status."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numeric import percent, ratio, require_columns
from ledgerlens.functions.periods import check_period, period_start
from ledgerlens.operators.filters import date_of
from ledgerlens.plans.calendar import dense

CATEGORIES = ("financial", "operational", "customer", "product", "sales")
FORMATS = ("minimal", "summary", "detailed")
# The KPIs of the minimal format.
MINIMAL = {
    "financial": ("revenue", "profit", "profit_margin"),
    "operational": ("transactions", "avg_transaction_value"),
    "customer": ("total_customers", "customer_retention_rate", "customer_lifetime_value"),
    "product": ("total_products", "high_performers"),
    "sales": ("total_sales", "conversion_rate"),
}
# Columns a product performance table needs for KPIs.
REQUIRED = (
    "total_revenue", "total_profit", "profit_margin", "roi", "transaction_count", "total_quantity", "return_rate",
)

COLUMNS = ("category", "kpi", "value", "unit", "change", "trend", "status")


def _kpi(category, kpi, value, unit, change=None, trend=None, status="neutral") -> Column:
    def text(x):
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    return F.struct(
        F.lit(category).alias("category"),
        F.lit(kpi).alias("kpi"),
        value.cast("double").alias("value"),
        F.lit(unit).alias("unit"),
        (change if change is not None else F.lit(None)).cast("double").alias("change"),
        text(trend).alias("trend"),
        text(status).alias("status"),
    )


def _long(one: DataFrame, rows: Sequence[Column]) -> DataFrame:
    return one.select(F.inline(F.array(*rows)))


def exact_sum(name: str) -> Column:
    """Sum of money doubles as decimals, so that the order of rows does not show."""
    return F.sum(F.col(name).cast("decimal(24,4)")).cast("double")


def product_summary(performance: DataFrame) -> DataFrame:
    """Totals and means over a product performance table."""
    require_columns(performance, *REQUIRED)
    return performance.agg(
        exact_sum("total_revenue").alias("total_revenue"),
        exact_sum("total_profit").alias("total_profit"),
        F.avg("profit_margin").alias("avg_profit_margin"),
        F.avg("roi").alias("avg_roi"),
        F.sum("transaction_count").alias("total_transactions"),
        F.sum("total_quantity").cast("long").alias("total_quantity_sold"),
        F.avg("return_rate").alias("avg_return_rate"),
    )


def compare_periods(
    df: DataFrame, amount_columns: dict[str, str], date_column: str, days: int, anchor: str | None = None
) -> DataFrame:
    """Each amount over the last ``days`` days and over as many days before them, in one pass.

    One row per measure: value, previous, change in percent, trend, status.
    """
    day = F.col(date_column).cast("date")
    last = F.lit(anchor).cast("date") if anchor else df.agg(F.max(day)).scalar()
    rows = df.filter(day > F.date_sub(last, 2 * days)).filter(day <= last)
    rows = rows.withColumn("__now", day > F.date_sub(last, days))
    sums = []
    for name, column in amount_columns.items():
        for suffix, when in (("now", F.col("__now")), ("prev", ~F.col("__now"))):
            sums.append(F.sum(F.when(when, F.col(column))).cast("double").alias(f"{name}_{suffix}"))
    one = rows.agg(*sums)
    cells = []
    for name in amount_columns:
        now = F.coalesce(F.col(f"{name}_now"), F.lit(0.0))
        prev = F.coalesce(F.col(f"{name}_prev"), F.lit(0.0))
        cells.append(
            F.struct(
                F.lit(name).alias("measure"),
                now.alias("value"),
                prev.alias("previous"),
                percent(now - prev, prev).alias("change"),
                trend(now, prev).alias("trend"),
                F.when(now > prev, "healthy").otherwise("warning").alias("status"),
            )
        )
    return one.select(F.inline(F.array(*cells)))


def trend(now: Column, before: Column) -> Column:
    return F.when(now > before, "up").when(now < before, "down").otherwise("stable")


def _performance_totals(performance: DataFrame) -> DataFrame:
    """Every total and mean the KPIs of products need, in one pass."""
    require_columns(performance, *REQUIRED)
    measures = [
        exact_sum("total_revenue").alias("r"),
        exact_sum("total_profit").alias("p"),
        F.avg("profit_margin").alias("m"),
        F.avg("roi").alias("roi"),
        F.sum("transaction_count").alias("n"),
        F.sum("total_quantity").alias("q"),
        F.avg("return_rate").alias("ret"),
        F.count(F.lit(1)).alias("products"),
        F.count_if(F.col("roi") > 100).alias("high"),
    ]
    if "market_share" in performance.columns:
        measures.append(F.avg("market_share").alias("share"))
    return performance.agg(*measures)


def _financial_rows(change: dict[str, Column] | None = None) -> list[Column]:
    change = change or {"revenue": F.lit(None), "profit": F.lit(None)}

    def moved(k):
        c = change[k].cast("double")
        direction = F.when(c > 0, "up").when(c < 0, "down").when(c == 0, "stable")
        return direction, F.when(c > 0, "healthy").when(c.isNotNull(), "warning").otherwise("neutral")

    r_trend, r_status = moved("revenue")
    p_trend, p_status = moved("profit")
    margin = percent(F.col("p"), F.col("r"), 0.0)
    return [
        _kpi("financial", "revenue", F.col("r"), "USD", change["revenue"], r_trend, r_status),
        _kpi("financial", "profit", F.col("p"), "USD", change["profit"], p_trend, p_status),
        _kpi("financial", "profit_margin", margin, "%",
             status=F.when(margin > 20, "healthy").otherwise("warning")),
        _kpi("financial", "cost", F.col("r") - F.col("p"), "USD"),
        _kpi("financial", "gross_margin", F.col("m"), "%", status="healthy"),
        _kpi("financial", "roi", F.col("roi"), "%", status="healthy"),
    ]


def _operational_rows() -> list[Column]:
    value = ratio(F.col("r"), F.col("n"), 0.0)
    return [
        _kpi("operational", "transactions", F.col("n"), "count", status="healthy"),
        _kpi("operational", "units_sold", F.col("q"), "units", status="healthy"),
        _kpi("operational", "avg_transaction_value", value, "USD", status="healthy"),
        _kpi("operational", "return_rate", F.col("ret"), "%", status="healthy"),
    ]


def _product_rows() -> list[Column]:
    return [
        _kpi("product", "total_products", F.col("products"), "count"),
        _kpi("product", "high_performers", F.col("high"), "count", status="healthy"),
        _kpi("product", "avg_product_revenue", ratio(F.col("r"), F.col("products")), "USD", status="healthy"),
        _kpi("product", "avg_market_share", F.col("share"), "%", status="healthy"),
    ]


def financial_kpis(performance: DataFrame, comparison: DataFrame | None = None) -> DataFrame:
    """Revenue, profit, margin, cost, mean margin, mean ROI; changes from a comparison table."""
    one = _performance_totals(performance)
    if comparison is None:
        return _long(one, _financial_rows())
    names = ("revenue", "profit")
    table = comparison.agg(
        *[F.max(F.when(F.col("measure") == k, F.col("change"))).alias(k) for k in names]
    )
    one = one.withColumn("__c", table.select(F.struct(*names)).scalar())
    return _long(one, _financial_rows({k: F.col("__c")[k] for k in names}))


def operational_kpis(performance: DataFrame) -> DataFrame:
    """Transactions, units, transaction value, mean return rate."""
    return _long(_performance_totals(performance), _operational_rows())


def product_kpis(performance: DataFrame) -> DataFrame:
    """Products, high performers, mean revenue and mean share."""
    return _long(_performance_totals(performance), _product_rows())


def sales_kpis(sales: DataFrame, amount_column: str) -> DataFrame:
    """Volume, count and average deal; one no_data row without sales."""
    one = sales.agg(F.sum(amount_column).cast("double").alias("t"), F.count(F.lit(1)).alias("n"))
    rows = [
        _kpi("sales", "total_sales", F.col("t"), "USD", status="healthy"),
        _kpi("sales", "sales_transactions", F.col("n"), "count", status="healthy"),
        _kpi("sales", "avg_deal_size", ratio(F.col("t"), F.col("n"), 0.0), "USD", status="healthy"),
    ]
    none = F.array(_kpi("sales", "no_data", F.lit(None), "count", status="no_data"))
    return one.select(F.inline(F.when(F.col("n") > 0, F.array(*rows)).otherwise(none)))


def customer_activity(
    orders: DataFrame, customer: str, amount: str, date_column: str, days: int, anchor: str | None = None
) -> DataFrame:
    """Per customer: first and last day, orders, spend, active now and in the window before.

    One hash aggregate by customer; the windows are conditions inside it.
    """
    day = F.col(date_column).cast("date")
    last = F.lit(anchor).cast("date") if anchor else orders.agg(F.max(day)).scalar()
    rows = orders.select(
        F.col(customer).alias("customer"), day.alias("day"), F.col(amount).alias("amount")
    ).filter(F.col("customer").isNotNull())
    rows = rows.withColumn("last", last).filter(F.col("day") <= F.col("last"))
    age = F.datediff("last", "day")
    return rows.groupBy("customer").agg(
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
        F.count(F.lit(1)).alias("orders"),
        F.sum("amount").alias("spend"),
        F.count_if(age < days).alias("n_now"),
        F.count_if((age >= days) & (age < 2 * days)).alias("n_prev"),
        F.count_if(age >= 2 * days).alias("n_older"),
    )


def customer_flags() -> dict[str, Column]:
    now, prev, older = F.col("n_now") > 0, F.col("n_prev") > 0, F.col("n_older") > 0
    return {
        "active_customers": now,
        "new_customers": now & ~prev & ~older,
        "churned_customers": prev & ~now,
        "reactivated_customers": now & ~prev & older,
        "retained_customers": now & prev,
        "previous_customers": prev,
    }


def customer_kpis(activity: DataFrame) -> DataFrame:
    """Totals of the customer flags, retention and churn against the window before, lifetime value."""
    one = activity.agg(
        F.count(F.lit(1)).alias("total_customers"),
        F.sum("spend").cast("double").alias("spend"),
        *[F.count_if(c).alias(n) for n, c in customer_flags().items()],
    )
    prev = F.col("previous_customers")
    retention = percent(F.col("retained_customers"), prev, 0.0)
    churn = percent(F.col("churned_customers"), prev, 0.0)
    rows = [
        _kpi("customer", "total_customers", F.col("total_customers"), "count"),
        _kpi("customer", "active_customers", F.col("active_customers"), "count", status="healthy"),
        _kpi("customer", "new_customers", F.col("new_customers"), "count", status="healthy"),
        _kpi("customer", "churned_customers", F.col("churned_customers"), "count"),
        _kpi("customer", "reactivated_customers", F.col("reactivated_customers"), "count"),
        _kpi("customer", "customer_retention_rate", retention, "%",
             status=F.when(retention > 85, "healthy").otherwise("warning")),
        _kpi("customer", "churn_rate", churn, "%", status=F.when(churn > 15, "warning").otherwise("healthy")),
        _kpi("customer", "customer_lifetime_value", ratio(F.col("spend"), F.col("total_customers"), 0.0), "USD",
             status="healthy"),
    ]
    return _long(one, rows)


def customer_segments(activity: DataFrame, customers: DataFrame, key: str, segment: str) -> DataFrame:
    """Customers, revenue, order value, retention, churn and lifetime value per segment.

    Orders are reduced to one row per customer before the join.
    """
    named = customers.select(F.col(key).alias("customer"), F.col(segment).alias("segment"))
    rows = activity.join(named, "customer")
    flags = customer_flags()
    by = rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("spend").cast("double").alias("revenue"),
        F.sum("orders").alias("orders"),
        *[F.count_if(flags[n]).alias(n) for n in ("retained_customers", "churned_customers", "previous_customers")],
    )
    prev = F.col("previous_customers")
    return by.select(
        "segment",
        "customers",
        "revenue",
        ratio(F.col("revenue"), F.col("orders"), 0.0).alias("avg_order_value"),
        percent(F.col("churned_customers"), prev, 0.0).alias("churn_rate"),
        percent(F.col("retained_customers"), prev, 0.0).alias("retention_rate"),
        ratio(F.col("revenue"), F.col("customers"), 0.0).alias("lifetime_value"),
    )


def daily_profit(
    df: DataFrame, revenue: str, cost: str, date_column: str, days: int | None = None, period: str = "D"
) -> DataFrame:
    """Revenue, cost and profit per day of the last ``days`` days, days without sales as zero."""
    p = check_period(period, "D")
    when = date_of(df, date_column)
    day = when.cast("date")
    if days is not None:
        last = F.lit(df.agg(F.max(day)).first()[0]).cast("date")
        df = df.filter(when >= F.date_sub(last, days - 1))
    by = df.filter(day.isNotNull()).groupBy(period_start(day, p).alias("date")).agg(
        F.sum(revenue).alias("revenue"), F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("transactions")
    )
    grid = dense(by, "date", p, zeros=["revenue", "cost", "transactions"])
    return grid.select(
        "date",
        F.col("revenue").cast("double").alias("revenue"),
        F.col("cost").cast("double").alias("cost"),
        (F.col("revenue") - F.col("cost")).cast("double").alias("profit"),
        "transactions",
        (F.weekday("date") < 5).alias("is_weekday"),
    )


def in_format(kpis: DataFrame, category: str | None = None, form: str = "summary") -> DataFrame:
    """KPIs of one category, or the essential ones for the minimal form."""
    if form not in FORMATS:
        raise ValueError(f"format {form!r} is not one of {FORMATS}")
    if category is not None:
        if category not in CATEGORIES:
            raise ValueError(f"category {category!r} is not one of {CATEGORIES}")
        kpis = kpis.filter(F.col("category") == category)
    if form == "minimal":
        essential = [(F.col("category") == k) & F.col("kpi").isin(*names) for k, names in MINIMAL.items()]
        kpis = kpis.filter(reduce(or_, essential))
    return kpis


def kpi_counts(kpis: DataFrame) -> DataFrame:
    """Number of KPIs per category."""
    return kpis.groupBy("category").agg(F.count(F.lit(1)).alias("kpis"))


# Findings reported when a KPI passes its limit.
# (category, kpi, measured field, comparison, limit, priority or type, title)
HIGHLIGHTS = (
    ("financial", "revenue", "change", ">", 10.0, "positive", "Revenue up vs previous period"),
    ("customer", "customer_retention_rate", "value", ">", 85.0, "positive", "Strong customer retention"),
    ("sales", "quota_attainment", "value", ">", 100.0, "excellent", "Sales quota exceeded"),
)
INSIGHTS = (
    ("financial", "profit_margin", "value", "<", 20.0, "medium", "Profit margin below target"),
    ("financial", "revenue", "change", ">", 0.0, "low", "Positive revenue trend"),
    ("customer", "ltv_cac_ratio", "value", ">", 3.0, "low", "Excellent LTV:CAC ratio"),
    ("customer", "churn_rate", "value", ">", 15.0, "high", "Elevated churn rate"),
    ("operational", "return_rate", "value", ">", 10.0, "medium", "High return rate"),
)
_RULE = "category string, kpi string, field string, comparison string, limit double, priority string, title string"


def apply_rules(kpis: DataFrame, rules: Sequence[tuple] = INSIGHTS) -> DataFrame:
    """The findings whose KPI passes the limit. The rules are a small table joined by KPI."""
    table = kpis.sparkSession.createDataFrame(list(rules), _RULE)
    rows = kpis.select("category", "kpi", "value", "change").join(F.broadcast(table), ["category", "kpi"])
    measured = F.when(F.col("field") == "change", F.col("change")).otherwise(F.col("value"))
    hit = F.when(F.col("comparison") == ">", measured > F.col("limit")).otherwise(measured < F.col("limit"))
    return rows.filter(F.coalesce(hit, F.lit(False))).select(
        "category", "kpi", "priority", "title", measured.alias("measured"), "limit"
    )


def dashboard(performance: DataFrame, sales: DataFrame, amount_column: str) -> DataFrame:
    """Financial, operational, product and sales KPIs in one table, one pass over each source."""
    rows = [*_financial_rows(), *_operational_rows(), *_product_rows()]
    blocks = _long(_performance_totals(performance), rows)
    return blocks.unionByName(sales_kpis(sales, amount_column))
