"""Revenue metrics, margin, revenue per user, conversion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.numeric import as_number, exact_avg, percent, ratio, require_columns, rounded
from ledgerlens.functions.periods import check_period, period_end, period_start
from ledgerlens.operators.filters import date_of
from ledgerlens.plans.calendar import MAX_PERIODS, dense
from ledgerlens.plans.ordered import moving, running_sum
from ledgerlens.plans.quantiles import quantiles

METRICS = (
    "total",
    "average",
    "median",
    "cumulative",
    "growth_rate",
    "moving_average",
    "by_category",
    "by_period",
)


def validate_measure(
    df: DataFrame, measure: str, date_column: str | None = None, category_column: str | None = None
) -> None:
    """Raise for a missing column or a measure without a single value."""
    require_columns(df, measure, date_column, category_column)
    if df.filter(as_number(df, measure).isNotNull()).isEmpty() and not df.isEmpty():
        raise ValueError(f"column {measure!r} has no numeric values")


def usable_rows(
    df: DataFrame, revenue_column: str, *, exclude_zero: bool = True, exclude_negative: bool = False
) -> DataFrame:
    """Coerce the measure to a number, drop nulls and, as asked, zeros and negatives."""
    rows = df.withColumn(revenue_column, as_number(df, revenue_column))
    return rows.filter(_kept(F.col(revenue_column), exclude_zero, exclude_negative))


def _kept(c: Column, exclude_zero: bool, exclude_negative: bool) -> Column:
    keep = c.isNotNull()
    if exclude_zero:
        keep = keep & (c != 0)
    if exclude_negative:
        keep = keep & (c >= 0)
    return keep


def total_revenue(df: DataFrame, revenue_column: str, round_decimals: int | None = None) -> DataFrame:
    total = F.coalesce(rounded(F.sum(revenue_column), round_decimals).cast("double"), F.lit(0.0))
    return df.agg(total.alias("total_revenue"))


def average_revenue(df: DataFrame, revenue_column: str, round_decimals: int | None = None) -> DataFrame:
    avg = rounded(exact_avg(F.col(revenue_column)), round_decimals)
    return df.agg(F.coalesce(avg, F.lit(0.0)).alias("average_revenue"))


def median_revenue(
    df: DataFrame, revenue_column: str, round_decimals: int | None = None, *, exact: bool = True
) -> DataFrame:
    if exact:
        one = quantiles(df, {"m": (revenue_column, 0.5)})
    else:
        one = df.agg(F.percentile_approx(revenue_column, 0.5, 100_000).cast("double").alias("m"))
    return one.select(F.coalesce(rounded(F.col("m"), round_decimals), F.lit(0.0)).alias("median_revenue"))


def revenue_breakdown(
    df: DataFrame,
    revenue_column: str,
    metric_type: str = "total",
    round_decimals: int | None = None,
    *,
    exclude_zero: bool = True,
    exclude_negative: bool = False,
) -> DataFrame:
    """One row: the metric's value, total, records kept and excluded, spread. One pass."""
    value = as_number(df, revenue_column)
    kept = _kept(value, exclude_zero, exclude_negative)
    v = F.when(kept, value)
    columns = [
        F.coalesce(F.sum(v).cast("double"), F.lit(0.0)).alias("total_revenue"),
        F.count(v).alias("records_processed"),
        (F.count(F.lit(1)) - F.count(v)).alias("records_excluded"),
        F.min(v).cast("double").alias("min_revenue"),
        F.max(v).cast("double").alias("max_revenue"),
        exact_avg(v).alias("avg_revenue"),
        F.stddev_samp(v.cast("double")).alias("std_deviation"),
    ]
    one = df.agg(*columns)
    if metric_type == "median":
        rows = usable_rows(df, revenue_column, exclude_zero=exclude_zero, exclude_negative=exclude_negative)
        one = one.withColumn("metric_value", median_revenue(rows, revenue_column).scalar())
    else:
        source = {"total": "total_revenue", "average": "avg_revenue"}[metric_type]
        one = one.withColumn("metric_value", F.col(source))
    status = F.when(F.col("records_processed") > 0, "success").otherwise("no_data")
    money = ["metric_value", "total_revenue", "min_revenue", "max_revenue", "avg_revenue", "std_deviation"]
    return one.select(
        F.lit(metric_type).alias("metric_type"),
        *[rounded(F.col(c), round_decimals).alias(c) for c in money],
        "records_processed",
        "records_excluded",
        status.alias("status"),
    )


def _summary(revenue_column: str) -> list[Column]:
    c = F.col(revenue_column)
    return [
        F.sum(c).alias("total_revenue"),
        exact_avg(c).alias("avg_revenue"),
        F.count(c).alias("count"),
        F.min(c).alias("min_revenue"),
        F.max(c).alias("max_revenue"),
    ]


def _as_doubles(df: DataFrame, names: Sequence[str], digits: int | None) -> DataFrame:
    return df.withColumns({n: rounded(F.col(n), digits).cast("double") for n in names})


_MONEY = ("total_revenue", "avg_revenue", "min_revenue", "max_revenue")


def revenue_by_category(
    df: DataFrame, revenue_column: str, category_column: str, round_decimals: int | None = None
) -> DataFrame:
    """Summary and share of total per category; rows without a category are left out.

    The total is a scalar subquery over the category table, so the categories need no
    single-task window. It asks for every column of that table: then both sides have the same
    shuffle, and Spark runs it, and the pass over the facts, once.
    """
    rows = df.filter(F.col(category_column).isNotNull())
    by = rows.groupBy(category_column).agg(*_summary(revenue_column))
    whole = by.agg(
        F.struct(
            F.sum("total_revenue").alias("total"),
            F.max("avg_revenue"),
            F.sum("count"),
            F.min("min_revenue"),
            F.max("max_revenue"),
        )
    ).scalar()
    out = by.withColumn("__all", whole)
    share = percent(F.col("total_revenue"), F.col("__all")["total"])
    out = out.withColumn("percentage", rounded(share, round_decimals)).drop("__all")
    return _as_doubles(out, _MONEY, round_decimals).orderBy(F.desc("total_revenue"), category_column)


def revenue_by_period(
    df: DataFrame,
    revenue_column: str,
    date_column: str,
    period: str | None = None,
    round_decimals: int | None = None,
) -> DataFrame:
    """Summary per calendar period, gaps filled with zero sums; labelled with the last day."""
    p = check_period(period)
    start = period_start(date_of(df, date_column), p)
    by = (
        df.filter(start.isNotNull())
        .groupBy(start.alias("__start"))
        .agg(*_summary(revenue_column))
    )
    grid = dense(by, "__start", p, zeros=["total_revenue", "count"])
    out = _as_doubles(grid, _MONEY, round_decimals)
    return out.select(period_end(F.col("__start"), p).alias("period"), *_MONEY[:2], "count", *_MONEY[2:])


def _period_sums(df: DataFrame, revenue_column: str, date_column: str, p: str) -> DataFrame:
    start = period_start(date_of(df, date_column), p)
    by = (
        df.filter(start.isNotNull())
        .groupBy(start.alias("__start"))
        .agg(F.sum(revenue_column).alias("__sum"))
    )
    return by


def cumulative_revenue(
    df: DataFrame,
    revenue_column: str,
    date_column: str,
    period: str | None = None,
    round_decimals: int | None = None,
    *,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Running revenue by date.

    With a period the rows are summed per period first and the running sum goes over the
    periods; a period without rows has sum 0 and no cumulative value. Without one, the
    running sum is per row, in the order of the date and ``order_by``.
    """
    if period is None:
        rows = running_sum(
            df.filter(F.col(date_column).isNotNull()),
            revenue_column,
            "cumulative_revenue",
            order_by=[date_column, *order_by],
            partition_by=partition_by,
            max_group_rows=max_group_rows,
        )
        return rows.select(
            *partition_by,
            F.col(date_column).alias("date"),
            *[c for c in order_by],
            rounded(F.col(revenue_column), round_decimals).cast("double").alias("revenue"),
            rounded(F.col("cumulative_revenue"), round_decimals).cast("double").alias("cumulative_revenue"),
        )
    p = check_period(period)
    sums = _period_sums(df, revenue_column, date_column, p)
    run = running_sum(sums, "__sum", "__run", order_by=["__start"], max_group_rows=MAX_PERIODS, split=False)
    grid = dense(run, "__start", p, zeros=["__sum"])
    return grid.select(
        period_end(F.col("__start"), p).alias("period"),
        rounded(F.col("__sum"), round_decimals).cast("double").alias("period_revenue"),
        rounded(F.col("__run"), round_decimals).cast("double").alias("cumulative_revenue"),
    )


def revenue_growth(
    df: DataFrame,
    revenue_column: str,
    date_column: str,
    period: str | None = None,
    growth_period: int = 1,
    round_decimals: int | None = None,
) -> DataFrame:
    """Percent change of the dense period sums against ``growth_period`` periods before."""
    p = check_period(period)
    grid = dense(_period_sums(df, revenue_column, date_column, p), "__start", p, zeros=["__sum"])
    before = F.lag("__sum", growth_period).over(W.orderBy("__start"))
    change = percent(F.col("__sum").cast("double") - before.cast("double"), before)
    return grid.select(
        period_end(F.col("__start"), p).alias("period"),
        rounded(F.col("__sum"), round_decimals).cast("double").alias("revenue"),
        rounded(change, round_decimals).alias("growth_rate_pct"),
    )


def moving_average_revenue(
    df: DataFrame,
    revenue_column: str,
    date_column: str,
    window: int = 7,
    round_decimals: int | None = None,
    *,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Average over the last ``window`` rows, fewer at the start."""
    name = f"ma_{window}_revenue"
    rows = moving(
        df.filter(F.col(date_column).isNotNull()),
        {
            "__s": lambda w: F.sum(revenue_column).over(w),
            "__n": lambda w: F.count(revenue_column).over(w),
        },
        window - 1,
        0,
        order_by=[date_column, *order_by],
        partition_by=partition_by,
        max_group_rows=max_group_rows,
    )
    return rows.select(
        *partition_by,
        F.col(date_column).alias("date"),
        *order_by,
        rounded(F.col(revenue_column), round_decimals).cast("double").alias("revenue"),
        rounded(ratio(F.col("__s"), F.col("__n")), round_decimals).alias(name),
    )


def calculate_revenue(
    df: DataFrame,
    revenue_column: str = "value",
    date_column: str | None = None,
    category_column: str | None = None,
    metric_type: str = "total",
    period: str | None = None,
    moving_window: int = 7,
    growth_period: int = 1,
    include_breakdown: bool = False,
    exclude_zero: bool = True,
    exclude_negative: bool = False,
    round_decimals: int | None = 2,
    validate_data: bool = True,
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Coerce, filter and compute one revenue metric. Empty input gives 0 or no rows."""
    metric = metric_type.lower()
    if metric not in METRICS:
        raise ValueError(f"metric_type {metric_type!r} is not one of {METRICS}")
    require_columns(df, revenue_column, date_column, category_column)
    if metric in ("cumulative", "growth_rate", "moving_average", "by_period") and date_column is None:
        raise ValueError(f"date_column is required for {metric}")
    if metric == "by_category" and category_column is None:
        raise ValueError("category_column is required for by_category")
    if validate_data:
        validate_measure(df, revenue_column, date_column, category_column)
    if include_breakdown and metric in ("total", "average", "median"):
        return revenue_breakdown(
            df, revenue_column, metric, round_decimals,
            exclude_zero=exclude_zero, exclude_negative=exclude_negative,
        )
    rows = usable_rows(df, revenue_column, exclude_zero=exclude_zero, exclude_negative=exclude_negative)
    if metric == "total":
        return total_revenue(rows, revenue_column, round_decimals)
    if metric == "average":
        return average_revenue(rows, revenue_column, round_decimals)
    if metric == "median":
        return median_revenue(rows, revenue_column, round_decimals)
    if metric == "by_category":
        return revenue_by_category(rows, revenue_column, category_column, round_decimals)
    if metric == "by_period":
        return revenue_by_period(rows, revenue_column, date_column, period, round_decimals)
    if metric == "cumulative":
        return cumulative_revenue(
            rows, revenue_column, date_column, period, round_decimals, order_by=order_by
        )
    if metric == "growth_rate":
        return revenue_growth(rows, revenue_column, date_column, period, growth_period, round_decimals)
    return moving_average_revenue(
        rows, revenue_column, date_column, moving_window, round_decimals, order_by=order_by
    )


def profit_margin(
    df: DataFrame, revenue_column: str, cost_column: str, round_decimals: int | None = None
) -> DataFrame:
    """(revenue - cost) / revenue in percent, 0 without revenue."""
    require_columns(df, revenue_column, cost_column)
    revenue, cost = F.sum(as_number(df, revenue_column)), F.sum(as_number(df, cost_column))
    profit = F.coalesce(revenue, F.lit(0)) - F.coalesce(cost, F.lit(0))
    return df.agg(rounded(percent(profit, revenue, 0.0), round_decimals).alias("profit_margin"))


def arpu(
    df: DataFrame,
    revenue_column: str,
    user_column: str | None = None,
    round_decimals: int | None = None,
    *,
    exact: bool = True,
) -> DataFrame:
    """Revenue per distinct user, or per row without a user column; 0 without users.

    The exact form sums per user first, so no task sees all users.
    """
    require_columns(df, revenue_column, user_column)
    revenue = as_number(df, revenue_column)
    if user_column is None:
        one = df.agg(F.sum(revenue).alias("r"), F.count(F.lit(1)).alias("u"))
    elif exact:
        per_user = df.groupBy(user_column).agg(F.sum(revenue).alias("s"))
        one = per_user.agg(F.sum("s").alias("r"), F.count(user_column).alias("u"))
    else:
        one = df.agg(F.sum(revenue).alias("r"), F.approx_count_distinct(user_column).alias("u"))
    return one.select(rounded(ratio(F.col("r"), F.col("u"), 0.0), round_decimals).alias("arpu"))


def conversion_rate(
    df: DataFrame,
    conversion_column: str,
    total_column: str | None = None,
    round_decimals: int | None = None,
) -> DataFrame:
    """Conversions per row, or per ``total_column``, in percent; 0 without rows."""
    require_columns(df, conversion_column, total_column)
    hits = F.sum(as_number(df, conversion_column))
    base = F.count(F.lit(1)) if total_column is None else F.sum(as_number(df, total_column))
    return df.agg(rounded(percent(hits, base, 0.0), round_decimals).alias("conversion_rate"))
