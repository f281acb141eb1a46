"""Anomaly detection on a measure, over all rows or within groups."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.functions.numeric import as_number, percent, ratio, require_columns, rounded
from ledgerlens.plans.groups import (
    ROWS, TASK_ROWS, attach, few_groups, largest_group, with_totals,
)
from ledgerlens.plans.ordered import fill_ordered, moving, positions
from ledgerlens.plans.quantiles import quantiles
from ledgerlens.session import cut_lineage

METHODS = ("zscore", "iqr", "mad", "isolation", "moving_avg", "seasonal")
# Fixed value: scales a median absolute deviation to a standard deviation.
MAD_SCALE = 0.6745

FLAGS = ("is_anomaly", "anomaly_score", "upper_bound", "lower_bound")


class Scope:
    """What the statistics of a row range over: its group, or the whole table.

    Groups that one task can hold, once their rows are together anyway or are too many to
    broadcast statistics for, get their statistics by window: one shuffle by group serves every
    step. Otherwise statistics are aggregated with map-side combine and attached to the rows.
    """

    def __init__(self, group_by: Sequence[str], order_by: Sequence[str], max_group_rows: int | None):
        self.group_by = list(group_by)
        self.order_by = list(order_by)
        self.max_group_rows = max_group_rows
        self.in_window = False
        self._small: bool | None = None

    def decide(self, df: DataFrame, ordered: bool) -> None:
        if self.max_group_rows is not None:
            self.in_window = self.max_group_rows <= TASK_ROWS
        elif ordered or (self.group_by and not self.small(df)):
            self.max_group_rows = largest_group(df, self.group_by)
            self.in_window = self.max_group_rows <= TASK_ROWS

    def ordered(self) -> dict:
        return {
            "order_by": self.order_by,
            "partition_by": self.group_by,
            "max_group_rows": self.max_group_rows,
        }

    def small(self, df: DataFrame) -> bool:
        if self._small is None:
            self._small = few_groups(df, self.group_by)
        return self._small

    def add(self, df: DataFrame, also_by: Sequence[str] = (), **stats: Column) -> DataFrame:
        """Add aggregates of the scope, or of its parts by ``also_by``, to its rows."""
        keys = [*self.group_by, *also_by]
        if self.in_window:
            return df.select("*", *[c.over(W.partitionBy(*keys)).alias(n) for n, c in stats.items()])
        if not keys:
            return with_totals(df, df, **stats)
        table = df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(ROWS), *[c.alias(n) for n, c in stats.items()]
        )
        small = self.small(df) if self.group_by else True
        return attach(df, table, keys, small=small).drop(ROWS)

    def add_quantiles(self, df: DataFrame, wanted: dict[str, tuple[str, float]]) -> DataFrame:
        if self.in_window:
            over = W.partitionBy(*self.group_by)
            return df.select(
                "*", *[F.percentile(F.col(c), F.lit(p)).over(over).alias(n) for n, (c, p) in wanted.items()]
            )
        table = quantiles(df, wanted, self.group_by)
        if not self.group_by:
            one = table.select(F.struct(*wanted).alias("s")).scalar()
            return df.withColumn("__q", one).select(
                *df.columns, *[F.col("__q")[n].alias(n) for n in wanted]
            )
        small = self.small(df)
        if not small:
            sizes = df.groupBy(*self.group_by).agg(F.count(F.lit(1)).alias(ROWS))
            table = attach(table, sizes, self.group_by, small=False)
        return attach(df, table, self.group_by, small=small).drop(ROWS)


def handle_missing(df: DataFrame, value: str, how: str, scope: Scope) -> DataFrame:
    """Drop, interpolate or fill missing values, in order and within the group."""
    if how == "interpolate":
        df = fill_ordered(df, value, "interpolate", **scope.ordered())
    elif how == "fill_mean":
        filled = scope.add(df, __m=F.avg(value))
        return filled.withColumn(value, F.coalesce(F.col(value).cast("double"), "__m")).drop("__m")
    elif how == "fill_median":
        filled = scope.add_quantiles(df, {"__m": (value, 0.5)})
        return filled.withColumn(value, F.coalesce(F.col(value).cast("double"), "__m")).drop("__m")
    return df.filter(F.col(value).isNotNull())


def _flag(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def _zscore(df, value, t, scope, service, **_):
    std = F.stddev_samp if service else F.stddev_pop
    rows = scope.add(df, __mean=F.avg(value), __std=std(value))
    mean, sd = F.col("__mean"), F.col("__std")
    score = F.coalesce(F.abs(ratio(F.col(value) - mean, sd)), F.lit(0.0))
    live = sd > 0
    return rows, score > t, score, F.when(live, mean + t * sd), F.when(live, mean - t * sd)


def _iqr(df, value, t, scope, service, **_):
    rows = scope.add_quantiles(
        df, {"__q1": (value, 0.25), "__q2": (value, 0.5), "__q3": (value, 0.75)}
    )
    v, spread = F.col(value), F.col("__q3") - F.col("__q1")
    low, high = F.col("__q1") - t * spread, F.col("__q3") + t * spread
    if service:
        score = F.abs(ratio(v - F.col("__q2"), spread))
    else:
        score = F.least(F.abs(v - low), F.abs(v - high))
    return rows, (v < low) | (v > high), score, high, low


def _mad(df, value, t, scope, service, **_):
    rows = scope.add_quantiles(df, {"__med": (value, 0.5)})
    rows = rows.withColumn("__dev", F.abs(F.col(value) - F.col("__med")))
    rows = scope.add_quantiles(rows, {"__mad": ("__dev", 0.5)})
    med, mad = F.col("__med"), F.col("__mad")
    if service:
        mad = F.when(mad == 0, 1.0).otherwise(mad)
    score = F.coalesce(F.abs(ratio(F.lit(MAD_SCALE) * (F.col(value) - med), mad)), F.lit(0.0))
    reach = F.when(mad > 0, t * mad / F.lit(MAD_SCALE))
    return rows, score > t, score, med + reach, med - reach


def _moving_avg(df, value, t, scope, service, window_size, **_):
    w = window_size
    rows = moving(
        df,
        {
            "__n": lambda f: F.count(value).over(f),
            "__mean": lambda f: F.avg(value).over(f),
            "__std": lambda f: F.stddev_samp(value).over(f),
        },
        w // 2,
        (w - 1) // 2,
        **scope.ordered(),
    )
    full = F.col("__n") == w
    mean, sd = F.when(full, F.col("__mean")), F.when(full, F.col("__std"))
    low, high = mean - t * sd, mean + t * sd
    v = F.col(value)
    score = F.abs(ratio(v - mean, sd))
    flag = score > t if service else (v < low) | (v > high)
    return rows, flag, score, high, low


def decompose(
    df: DataFrame, value: str, period: int, scope: Scope, out: tuple[str, str, str]
) -> DataFrame:
    """Additive decomposition by position: trend, seasonal part and residual.

    The trend is a centred mean over one period; an even period takes one row more with half
    weight at both ends. The seasonal part of a phase is the mean of value - trend, centred.
    """
    trend, seasonal, resid = out
    m = period
    half = m // 2
    rows = moving(
        df,
        {
            "__n": lambda f: F.count(value).over(f),
            "__sum": lambda f: F.sum(value).over(f),
            "__first": lambda f: F.first(value).over(f),
            "__last": lambda f: F.last(value).over(f),
        },
        half,
        half,
        **scope.ordered(),
    )
    total = F.col("__sum")
    if m % 2 == 0:
        total = total - (F.col("__first") + F.col("__last")) / 2
    width = 2 * half + 1
    rows = rows.withColumn(trend, F.when(F.col("__n") == width, total / F.lit(m)))
    rows = positions(rows, "__at", **scope.ordered()).withColumn("__phase", F.col("__at") % m)
    if not scope.in_window:
        rows = cut_lineage(rows, "trend")
    # The mean of the phases counts each phase once, however many rows it has.
    rows = scope.add(rows, ["__phase"], __mean=F.avg(F.col(value) - F.col(trend)), __size=F.count(F.lit(1)))
    weight = F.when(F.col("__mean").isNotNull(), 1 / F.col("__size"))
    rows = scope.add(
        rows.withColumn("__share", F.col("__mean") * weight).withColumn("__weight", weight),
        __top=F.sum("__share"),
        __bottom=F.sum("__weight"),
    )
    rows = rows.withColumn(seasonal, F.col("__mean") - ratio(F.col("__top"), F.col("__bottom")))
    rows = rows.withColumn(resid, F.col(value) - F.col(trend) - F.col(seasonal))
    return rows.select(*df.columns, trend, seasonal, resid)


def _seasonal(df, value, t, scope, service, seasonal_period, **_):
    m = seasonal_period or 7
    rows = decompose(df, value, m, scope, ("__trend", "__season", "__resid"))
    rows = scope.add(
        rows, __mean=F.avg("__resid"), __std=F.stddev_pop("__resid"), __all=F.count(F.lit(1))
    )
    sd = F.when((F.col("__std") > 0) & (F.col("__all") >= 2 * m), F.col("__std"))
    score = F.abs(ratio(F.col("__resid") - F.col("__mean"), sd))
    middle = F.col("__trend") + F.col("__season") + F.col("__mean")
    return rows, score > t, score, middle + t * sd, middle - t * sd


_RULES: dict[str, Callable] = {
    "zscore": _zscore,
    "iqr": _iqr,
    "mad": _mad,
    "moving_avg": _moving_avg,
    "seasonal": _seasonal,
}


def detect_anomalies(
    df: DataFrame,
    value_column: str,
    date_column: str | None = None,
    method: str = "zscore",
    threshold: float = 3.0,
    window_size: int = 7,
    seasonal_period: int | None = None,
    groupby_column: str | None = None,
    handle_missing_values: str = "interpolate",
    round_decimals: int | None = 4,
    *,
    order_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    service: bool = False,
    trees: int = 100,
    sample_size: int = 256,
) -> DataFrame:
    """Add is_anomaly, anomaly_score, upper_bound and lower_bound to the rows.

    ``order_by`` completes the date to a unique order. ``service`` selects the conventions of
    the report endpoint: sample deviation, distance from the median for iqr, a moving window of
    at most a third of the rows, scores decide. ``trees`` and ``sample_size`` are those of the isolation forest.
    """
    if method not in METHODS:
        raise ValueError(f"method {method!r} is not one of {METHODS}")
    require_columns(df, value_column, date_column, groupby_column, *order_by)
    if method in ("moving_avg", "seasonal") and date_column is None:
        raise ValueError(f"method {method!r} needs date_column")
    order = [c for c in (date_column, *order_by) if c]
    scope = Scope([groupby_column] if groupby_column else [], order, max_group_rows)
    rows = df.withColumn(value_column, as_number(df, value_column).cast("double"))
    if groupby_column:
        rows = rows.filter(F.col(groupby_column).isNotNull())
    scope.decide(rows, method in ("moving_avg", "seasonal"))
    how = handle_missing_values
    if how == "interpolate" and not order:
        raise ValueError("interpolation needs date_column or order_by")
    rows = handle_missing(rows, value_column, how, scope)
    if method == "isolation":
        from ledgerlens.operators.isolation import isolation_scores

        rows, flag, score = isolation_scores(rows, value_column, threshold, scope, trees, sample_size)
        high = low = F.lit(None).cast("double")
    else:
        if service and method == "moving_avg" and not groupby_column:
            window_size = max(service_window(rows.count()), 1)
        rows, flag, score, high, low = _RULES[method](
            rows, value_column, threshold, scope, service,
            window_size=window_size, seasonal_period=seasonal_period,
        )
    return rows.select(
        *df.columns,
        _flag(flag).alias("is_anomaly"),
        rounded(score, round_decimals).alias("anomaly_score"),
        rounded(high, round_decimals).alias("upper_bound"),
        rounded(low, round_decimals).alias("lower_bound"),
    )


def service_window(rows: int) -> int:
    """Window of the report endpoint's moving average."""
    return min(7, rows // 3)


def anomaly_summary(flagged: DataFrame, method: str, threshold: float, round_decimals: int | None = 4) -> DataFrame:
    """One row: records, anomalies, rate, and spread of the scores."""
    one = flagged.agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count_if("is_anomaly").alias("total_anomalies"),
        F.min("anomaly_score").alias("score_min"),
        F.max("anomaly_score").alias("score_max"),
        F.avg("anomaly_score").alias("score_mean"),
    )
    median = quantiles(flagged, {"m": ("anomaly_score", 0.5)}).scalar()
    return one.select(
        F.lit(method).alias("method"),
        F.lit(float(threshold)).alias("threshold"),
        "total_records",
        "total_anomalies",
        percent(F.col("total_anomalies"), F.col("total_records"), 0.0).alias("anomaly_rate"),
        "score_min",
        "score_max",
        rounded(F.col("score_mean"), round_decimals).alias("score_mean"),
        rounded(median, round_decimals).alias("score_median"),
    )


def classify(flagged: DataFrame, value_column: str, threshold: float, round_decimals: int | None = 1) -> DataFrame:
    """The anomalies with type against the median of all rows, severity and deviation."""
    median = quantiles(flagged, {"m": (value_column, 0.5)}).scalar()
    rows = flagged.withColumn("__median", median).filter("is_anomaly")
    value, mid = F.col(value_column).cast("double"), F.col("__median")
    return rows.select(
        *flagged.columns,
        F.when(value > mid, "spike").otherwise("drop").alias("type"),
        F.when(F.col("anomaly_score") > threshold * 1.5, "critical").otherwise("warning").alias("severity"),
        rounded(percent(value - mid, mid), round_decimals).alias("deviation_pct"),
    )


def top_anomalies(classified: DataFrame, limit: int, ties: Sequence[str]) -> DataFrame:
    return classified.orderBy(F.desc("anomaly_score"), *ties).limit(limit)


def alerts(
    classified: DataFrame, metric: str, value_column: str, date_column: str, limit: int = 3
) -> DataFrame:
    """Messages for the strongest critical anomalies."""
    top = (
        classified.filter(F.col("severity") == "critical")
        .orderBy(F.desc("anomaly_score"), date_column)
        .limit(limit)
    )
    name = metric.title()
    spike = F.col("type") == "spike"
    day = F.date_format(date_column, "yyyy-MM-dd")
    verb = F.when(spike, "spiked").otherwise("dropped")
    amount = F.format_number(F.col(value_column).cast("double"), 2)
    sign = F.when(F.col("deviation_pct") >= 0, "+").otherwise("")
    deviation = F.concat(sign, F.format_string("%.1f", "deviation_pct"), F.lit("%"))
    return top.select(
        F.lit("critical").alias("type"),
        F.when(spike, f"Unusual {name} Spike Detected")
        .otherwise(f"Significant {name} Drop Detected")
        .alias("title"),
        F.concat(
            F.lit(f"{name} "), verb, F.lit(" to $"), amount, F.lit(" on "), day,
            F.lit(" ("), deviation, F.lit(" from median)"),
        ).alias("message"),
        F.when(spike, "Investigate cause and verify data accuracy")
        .otherwise("Check for system issues or market changes")
        .alias("action"),
        day.alias("date"),
    )
