"""Calendar periods D, W, M, Q, Y: starts, end labels, names, ordinals."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The five supported periods.
PERIODS = ("D", "W", "M", "Q", "Y")
_TRUNC = {"D": "day", "W": "week", "M": "month", "Q": "quarter", "Y": "year"}
_STEP = {
    "D": "interval 1 day",
    "W": "interval 7 days",
    "M": "interval 1 month",
    "Q": "interval 3 months",
    "Y": "interval 1 year",
}


def check_period(period: str | None, default: str = "M") -> str:
    p = (period or default).upper()
    if p not in PERIODS:
        raise ValueError(f"period {period!r} is not one of {PERIODS}")
    return p


def period_start(ts: Column, period: str) -> Column:
    """First day of the period as DATE; weeks start on Monday. A text that is no ISO date gives null.

    Texts in other layouts go through ``operators.filters.date_of`` first.
    """
    if period == "D":
        return ts.try_cast("date")
    return F.trunc(ts.try_cast("date"), _TRUNC[period])


def period_step(period: str) -> Column:
    return F.expr(_STEP[period])


def period_end(start: Column, period: str) -> Column:
    """Last day of the period that begins at ``start``: the label of a resampled row."""
    if period == "D":
        return start
    if period == "W":
        return F.date_add(start, 6)
    months = {"M": 1, "Q": 3, "Y": 12}[period]
    return F.date_sub(F.add_months(start, months), 1)


def period_name(start: Column, period: str) -> Column:
    """Text name: 2026-01-05, 2026-01-05/2026-01-11, 2026-01, 2026Q1, 2026."""
    if period == "D":
        return F.date_format(start, "yyyy-MM-dd")
    if period == "W":
        return F.concat_ws(
            "/", F.date_format(start, "yyyy-MM-dd"), F.date_format(F.date_add(start, 6), "yyyy-MM-dd")
        )
    if period == "M":
        return F.date_format(start, "yyyy-MM")
    if period == "Q":
        return F.concat(F.date_format(start, "yyyy"), F.lit("Q"), F.quarter(start).cast("string"))
    return F.date_format(start, "yyyy")


def period_ordinal(start: Column, period: str) -> Column:
    """Integer position of the period, so that offsets are plain differences."""
    if period == "D":
        return F.datediff(start, F.lit("1970-01-01").cast("date"))
    if period == "W":
        return (F.datediff(start, F.lit("1969-12-29").cast("date")) / 7).cast("int")
    if period == "M":
        return F.year(start) * 12 + F.month(start) - 1
    if period == "Q":
        return F.year(start) * 4 + F.quarter(start) - 1
    return F.year(start)
