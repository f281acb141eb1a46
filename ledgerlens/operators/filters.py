"""Row filters, top-k, paging and daily summaries on sales tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numeric import exact_avg, require_columns
from ledgerlens.functions.text import parse_date

# Days looked back per period name; qtd and ytd start at the calendar unit.
PERIOD_DAYS = {"current": 30, "7d": 7, "30d": 30, "90d": 90, "12m": 365}


def in_category(df: DataFrame, category_column: str, category: str) -> DataFrame:
    require_columns(df, category_column)
    return df.filter(F.col(category_column) == F.lit(category))


def in_dates(df: DataFrame, date_column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows from the start day to the end of the end day; either bound may be open."""
    require_columns(df, date_column)
    when = date_of(df, date_column)
    if start is not None:
        df = df.filter(when >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(when < F.date_add(F.lit(end).cast("date"), 1))
    return df


def date_of(df: DataFrame, column: str) -> Column:
    """A date column as it is, so that bounds reach the scan; a text one parsed, null where it is no date."""
    c = F.col(column)
    return parse_date(F.trim(c)) if df.schema[column].dataType.typeName() == "string" else c


def window_start(period: str, anchor: Column) -> Column:
    """First day of the period that ends on the anchor day."""
    p = period.lower()
    if p == "ytd":
        return F.date_trunc("year", anchor).cast("date")
    if p == "qtd":
        return F.date_trunc("quarter", anchor).cast("date")
    if p not in PERIOD_DAYS:
        raise ValueError(f"period {period!r} is not one of {[*PERIOD_DAYS, 'ytd', 'qtd']}")
    return F.date_sub(anchor, PERIOD_DAYS[p] - 1)


def in_period(df: DataFrame, date_column: str, period: str, anchor: str | None = None) -> DataFrame:
    """Rows of the period up to the anchor day, by default the last day in the table."""
    require_columns(df, date_column)
    when = date_of(df, date_column)
    day = when.cast("date")
    if anchor is None:
        # Read first and put in as a literal, so that the bounds reach the scan.
        found = df.agg(F.max(day)).first()[0]
        last = F.lit(found).cast("date")
    else:
        last = F.lit(anchor).cast("date")
    return df.filter(when >= window_start(period, last)).filter(day <= last)


def sorted_top(
    df: DataFrame,
    sort_by: str = "total_revenue",
    sort_order: str = "desc",
    limit: int = 10,
    ties: Sequence[str] = (),
) -> DataFrame:
    """First rows by a column; an unknown column falls back to total_revenue, then the first."""
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if sort_by not in df.columns:
        sort_by = "total_revenue" if "total_revenue" in df.columns else df.columns[0]
    key = F.desc_nulls_last(sort_by) if sort_order == "desc" else F.asc_nulls_last(sort_by)
    return df.orderBy(key, *ties).limit(limit)


def largest(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(column), *ties).limit(n)


def smallest(df: DataFrame, column: str, n: int, ties: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.asc_nulls_last(column), *ties).limit(n)


def sales_summary(df: DataFrame, amount_column: str) -> DataFrame:
    """Total, number and average of the amounts."""
    c = F.col(amount_column)
    return df.agg(
        F.coalesce(F.sum(c).cast("double"), F.lit(0.0)).alias("total_sales"),
        F.count(F.lit(1)).alias("transaction_count"),
        F.coalesce(exact_avg(c), F.lit(0.0)).alias("avg_order_value"),
    )


def daily_sales(df: DataFrame, amount_column: str, date_column: str, days: int | None = 30) -> DataFrame:
    """Sum per day that has rows; the last ``days`` of them."""
    by = (
        df.groupBy(F.col(date_column).cast("date").alias("order_date"))
        .agg(F.sum(amount_column).cast("double").alias("total_amount"))
        .filter(F.col("order_date").isNotNull())
    )
    return by if days is None else by.orderBy(F.desc("order_date")).limit(days)


def as_records(df: DataFrame) -> DataFrame:
    """One JSON text per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("record"))
