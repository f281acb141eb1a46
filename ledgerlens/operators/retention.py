"""User retention: cohorts, period to period, rolling, by day.

All methods first reduce the log to one row per user and period. What follows per user is
bounded by the number of periods, and no set of users is ever built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.numeric import percent, require_columns, rounded
from ledgerlens.functions.periods import check_period, period_name, period_ordinal, period_start
from ledgerlens.operators.filters import date_of
from ledgerlens.plans.quantiles import quantiles

METHODS = ("cohort", "simple", "rolling", "n_day")
# The days reported by n-day retention.
DAYS = (1, 3, 7, 14, 30, 60, 90)


def activity(
    df: DataFrame,
    user_column: str,
    date_column: str,
    event_column: str | None = None,
    events: Sequence[str] | None = None,
) -> DataFrame:
    """Rows with a user and a date, optionally of some event types, as (user, ts)."""
    require_columns(df, user_column, date_column, event_column)
    if event_column is not None and events is not None:
        df = df.filter(F.col(event_column).isin(*events))
    ts = date_of(df, date_column)
    return df.select(F.col(user_column).alias("user"), ts.alias("ts")).filter(
        F.col("user").isNotNull() & F.col("ts").isNotNull()
    )


def user_periods(log: DataFrame, period: str, min_activity: int = 1) -> DataFrame:
    """One row per user and period in which the user has enough rows."""
    start = period_start(F.col("ts"), period)
    by = log.groupBy("user", start.alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return by.filter(F.col("n") >= min_activity).select("user", "start")


def cohort_counts(pairs: DataFrame, period: str, retention_periods: int) -> DataFrame:
    """Active users per cohort and period offset."""
    first = F.min("start").over(W.partitionBy("user"))
    offset = period_ordinal(F.col("start"), period) - period_ordinal(F.col("cohort"), period)
    return (
        pairs.withColumn("cohort", first)
        .withColumn("offset", offset)
        .filter(F.col("offset") <= retention_periods)
        .groupBy("cohort", "offset")
        .agg(F.count(F.lit(1)).alias("active"))
    )


def cohort_retention(
    log: DataFrame,
    period: str | None = None,
    retention_periods: int = 12,
    min_activity: int = 1,
    include_cohort_size: bool = True,
    round_decimals: int | None = None,
) -> DataFrame:
    """Cohort matrix: percent of each cohort active k periods after its first one."""
    p = check_period(period)
    counts = cohort_counts(user_periods(log, p, min_activity), p, retention_periods)
    cells = [
        F.max(F.when(F.col("offset") == k, F.col("active"))).alias(f"__{k}")
        for k in range(retention_periods + 1)
    ]
    wide = counts.groupBy("cohort").agg(*cells)
    size = [F.col("__0").alias("cohort_size")] if include_cohort_size else []
    return wide.select(
        period_name(F.col("cohort"), p).alias("cohort_period"),
        *size,
        *[
            rounded(percent(F.col(f"__{k}"), F.col("__0")), round_decimals).alias(f"Period_{k}")
            for k in range(retention_periods + 1)
        ],
    )


def _indexed(pairs: DataFrame) -> DataFrame:
    """Number the observed periods; their list is bounded by the calendar."""
    periods = pairs.select("start").distinct()
    numbered = periods.withColumn("idx", F.row_number().over(W.orderBy("start")) - 1)
    return pairs.join(F.broadcast(numbered), "start")


def simple_retention(
    log: DataFrame, period: str | None = None, min_activity: int = 1, round_decimals: int | None = None
) -> DataFrame:
    """Users of each observed period that are active in the next observed one."""
    p = check_period(period)
    rows = _indexed(user_periods(log, p, min_activity))
    following = F.lead("idx").over(W.partitionBy("user").orderBy("idx"))
    by = (
        rows.withColumn("back", F.coalesce(following == F.col("idx") + 1, F.lit(False)).cast("long"))
        .groupBy("start")
        .agg(F.count(F.lit(1)).alias("users"), F.sum("back").alias("retained_users"))
    )
    last = F.lead("start").over(W.orderBy("start"))
    return (
        by.withColumn("__next", last)
        .filter(F.col("__next").isNotNull())
        .select(
            period_name(F.col("start"), p).alias("period"),
            "users",
            "retained_users",
            rounded(percent(F.col("retained_users"), F.col("users")), round_decimals).alias("retention_rate"),
        )
    )


def rolling_retention(
    log: DataFrame,
    period: str | None = None,
    retention_periods: int = 12,
    min_activity: int = 1,
    round_decimals: int | None = None,
) -> DataFrame:
    """Users of each start period active ``offset`` observed periods later, for all offsets.

    Presence at each offset is a one-row range frame over the user's own periods.
    """
    p = check_period(period)
    n = retention_periods
    rows = _indexed(user_periods(log, p, min_activity))
    own = W.partitionBy("user").orderBy("idx")
    here = [F.count(F.lit(1)).over(own.rangeBetween(k, k)).alias(f"__{k}") for k in range(n + 1)]
    by = (
        rows.select("start", "idx", *here)
        .groupBy("start", "idx")
        .agg(*[F.sum(f"__{k}").alias(f"__{k}") for k in range(n + 1)])
    )
    # One row per period from here on.
    later = W.orderBy("idx")
    cells = F.array(
        *[
            F.struct(
                F.lit(k).alias("offset"),
                F.lead("start", k).over(later).alias("target"),
                F.col(f"__{k}").alias("kept"),
            )
            for k in range(n + 1)
        ]
    )
    total = F.count(F.lit(1)).over(W.partitionBy())
    table = by.select("start", "idx", F.col("__0").alias("users"), total.alias("periods"), cells.alias("cells"))
    return (
        table.filter(F.col("idx") + n <= F.col("periods"))
        .select("start", "users", F.explode("cells").alias("c"))
        .filter(F.col("c")["target"].isNotNull())
        .select(
            period_name(F.col("start"), p).alias("start_period"),
            F.col("c")["offset"].alias("offset"),
            period_name(F.col("c")["target"], p).alias("target_period"),
            rounded(percent(F.col("c")["kept"], F.col("users")), round_decimals).alias("retention_rate"),
        )
    )


def reported_days(max_days: int) -> list[int]:
    days = [d for d in DAYS if d <= max_days]
    if max_days not in days and max_days <= 365:
        days.append(max_days)
    return days


def nday_retention(
    log: DataFrame, max_days: int = 12, exact: bool = False, round_decimals: int | None = None, min_activity: int = 1
) -> DataFrame:
    """Percent of each first-day cohort active in the k-th 24 hours after first activity.

    A user counts there with at least ``min_activity`` rows.

    One row per user and calendar day with its earliest and latest time is enough: a day
    touches at most two of the 24-hour blocks that begin at the user's first time of day.
    With more rows asked for, rows are counted by user and block of hours, map-side first, so a user with very many
    rows is no task of its own. ``exact`` makes a cohort of every first timestamp instead of every first day.
    """
    days = reported_days(max_days)
    per_user = _active_days(log, days) if min_activity <= 1 else _busy_days(log, days, min_activity)
    cohort = F.col("first") if exact else F.col("first").cast("date")
    by = per_user.groupBy(cohort.alias("cohort_date")).agg(
        F.count(F.lit(1)).alias("cohort_size"), *[F.sum(f"__{k}").alias(f"__{k}") for k in days]
    )
    return by.select(
        "cohort_date",
        "cohort_size",
        *[
            rounded(percent(F.col(f"__{k}"), F.col("cohort_size")), round_decimals).alias(f"Day_{k}")
            for k in days
        ],
    )


def _clock(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) - F.unix_micros(ts.cast("date").cast("timestamp"))


def _busy_days(log: DataFrame, days: Sequence[int], min_activity: int) -> DataFrame:
    """user, first and a flag for each day: whether the user has so many rows in that block of 24 hours."""
    rows = log.join(log.groupBy("user").agg(F.min("ts").alias("first")), "user")
    early = F.when(_clock(F.col("ts")) < _clock(F.col("first")), 1).otherwise(0)
    block = F.datediff(F.col("ts").cast("date"), F.col("first").cast("date")) - early
    counted = rows.groupBy("user", "first", block.alias("k")).agg(F.count(F.lit(1)).alias("n"))
    busy = F.col("n") >= min_activity
    flags = [F.max(F.when(busy & (F.col("k") == k), 1).otherwise(0)).alias(f"__{k}") for k in days]
    return counted.groupBy("user", "first").agg(*flags)


def _active_days(log: DataFrame, days: Sequence[int]) -> DataFrame:
    """user, first and a flag for each day: whether the user has a row in that block of 24 hours."""
    per_day = log.groupBy("user", F.col("ts").cast("date").alias("day")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    first = F.min("lo").over(W.partitionBy("user"))

    gap = F.datediff(F.col("day"), F.col("first").cast("date"))
    late = F.when(_clock(F.col("hi")) >= _clock(F.col("first")), gap)
    early = F.when(_clock(F.col("lo")) < _clock(F.col("first")), gap - 1)
    flags = [
        F.max(F.when((late == k) | (early == k), 1).otherwise(0)).alias(f"__{k}") for k in days
    ]
    return per_day.withColumn("first", first).groupBy("user").agg(F.min("first").alias("first"), *flags)


def calculate_retention(
    df: DataFrame,
    user_column: str = "user_id",
    date_column: str = "date",
    event_column: str | None = None,
    cohort_period: str = "M",
    retention_periods: int = 12,
    method: str = "cohort",
    min_activity_threshold: int = 1,
    include_cohort_size: bool = True,
    round_decimals: int | None = 2,
    events: Sequence[str] | None = None,
) -> DataFrame:
    """Retention table by one of the methods; a log without valid rows gives no rows."""
    log = activity(df, user_column, date_column, event_column, events)
    if method == "cohort":
        return cohort_retention(
            log, cohort_period, retention_periods, min_activity_threshold, include_cohort_size, round_decimals
        )
    if method == "simple":
        return simple_retention(log, cohort_period, min_activity_threshold, round_decimals)
    if method == "rolling":
        return rolling_retention(log, cohort_period, retention_periods, min_activity_threshold, round_decimals)
    if method == "n_day":
        return nday_retention(log, retention_periods, round_decimals=round_decimals, min_activity=min_activity_threshold)
    raise ValueError(f"method {method!r} is not one of {METHODS}")


def _rate_columns(table: DataFrame) -> list[str]:
    return [c for c in table.columns if c.startswith(("Period_", "Day_")) or c == "retention_rate"]


def retention_long(table: DataFrame, label: str) -> DataFrame:
    """The rates of a retention table as (label, offset name, rate) rows, empty cells left out."""
    return table.unpivot([label], _rate_columns(table), "offset", "rate").filter(F.col("rate").isNotNull())


def retention_rate(table: DataFrame) -> DataFrame:
    """One number for a table: the mean of its column means."""
    names = _rate_columns(table)
    means = table.agg(*[F.avg(c).alias(c) for c in names])
    return means.unpivot([], names, "offset", "mean").agg(F.coalesce(F.avg("mean"), F.lit(0.0)).alias("retention_rate"))


def retention_report(table: DataFrame, log: DataFrame, method: str) -> DataFrame:
    """One row: users, records, date range of the log and spread of the rates."""
    names = _rate_columns(table)
    ids = [c for c in table.columns if c in ("cohort_period", "cohort_date", "period", "start_period")]
    rates = table.unpivot(ids, names, "offset", "rate").filter(F.col("rate").isNotNull())
    spread = rates.agg(
        F.avg("rate").alias("average_retention"),
        F.min("rate").alias("min_retention"),
        F.max("rate").alias("max_retention"),
        F.stddev_pop("rate").alias("std_retention"),
    )
    per_user = log.groupBy("user").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi")
    )
    whole = per_user.agg(
        F.struct(
            F.count(F.lit(1)).alias("total_users"),
            F.sum("n").alias("total_records"),
            F.min("lo").cast("date").alias("start"),
            F.max("hi").cast("date").alias("end"),
        ).alias("w")
    )
    cohorts = table.agg(F.count(F.lit(1)).alias("cohort_count"))
    middle = quantiles(rates, {"m": ("rate", 0.5)})
    return (
        spread.withColumn("w", whole.scalar())
        .withColumn("median_retention", middle.scalar())
        .withColumn("cohort_count", cohorts.scalar())
        .select(
            F.lit(method).alias("method"),
            F.col("w.total_users").alias("total_users"),
            F.col("w.total_records").alias("total_records"),
            F.col("w.start").alias("start_date"),
            F.col("w.end").alias("end_date"),
            "cohort_count",
            "average_retention",
            "median_retention",
            "min_retention",
            "max_retention",
            "std_retention",
        )
    )


def best_cohort(table: DataFrame) -> DataFrame:
    """The cohort with the highest mean rate over the offsets after the first period."""
    names = [c for c in _rate_columns(table) if c != "Period_0"]
    rates = table.unpivot(["cohort_period"], names, "offset", "rate").filter(F.col("rate").isNotNull())
    by = rates.groupBy("cohort_period").agg(F.avg("rate").alias("mean_retention"))
    return by.orderBy(F.desc("mean_retention"), "cohort_period").limit(1)
