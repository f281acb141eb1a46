"""Outlier removal and normalisation of numeric columns.

Statistics are one-row aggregates used as scalar subqueries: the rows are not shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.numeric import as_number, numeric_columns, ratio, require_columns
from ledgerlens.plans.quantiles import quantiles


def _columns(df: DataFrame, columns: Sequence[str] | None) -> list[str]:
    if columns is None:
        return numeric_columns(df)
    require_columns(df, *columns)
    return list(columns)


def _quartiles(df: DataFrame, columns: list[str]) -> DataFrame:
    wanted = {}
    for i, c in enumerate(columns):
        wanted |= {f"lo{i}": (c, 0.25), f"mid{i}": (c, 0.5), f"hi{i}": (c, 0.75)}
    return quantiles(df, wanted)


def _moments(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(
        *[
            stat(as_number(df, c).cast("double")).alias(f"{name}{i}")
            for i, c in enumerate(columns)
            for name, stat in (("mean", F.avg), ("sd", F.stddev_samp), ("min", F.min), ("max", F.max))
        ]
    )


def _with(df: DataFrame, one: DataFrame) -> DataFrame:
    return df.withColumn("__s", one.select(F.struct(*one.columns)).scalar())


def outlier_flags(df: DataFrame, columns: list[str], method: str, threshold: float) -> tuple[DataFrame, dict[str, Column]]:
    """The rows with the statistics, and per column whether a value is an outlier; nulls are not."""
    s = F.col("__s")
    flags = {}
    if method == "iqr":
        rows = _with(df, _quartiles(df, columns))
        for i, c in enumerate(columns):
            reach = threshold * (s[f"hi{i}"] - s[f"lo{i}"])
            v = as_number(df, c).cast("double")
            flags[c] = F.coalesce((v < s[f"lo{i}"] - reach) | (v > s[f"hi{i}"] + reach), F.lit(False))
    elif method == "zscore":
        rows = _with(df, _moments(df, columns))
        for i, c in enumerate(columns):
            z = F.abs(ratio(as_number(df, c).cast("double") - s[f"mean{i}"], s[f"sd{i}"]))
            flags[c] = F.coalesce(z > threshold, F.lit(False))
    else:
        raise ValueError(f"method {method!r} is not iqr or zscore")
    return rows, flags


def _any(flags: dict[str, Column]) -> Column:
    out = F.lit(False)
    for f in flags.values():
        out = out | f
    return out


def remove_outliers(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Rows without an outlier in any of the columns; the fences come from all rows."""
    rows, flags = outlier_flags(df, _columns(df, columns), method, threshold)
    return rows.filter(~_any(flags)).select(*df.columns)


def outlier_report(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "iqr", threshold: float = 1.5
) -> DataFrame:
    """Outliers per column, with the rows that removal would drop in all."""
    names = _columns(df, columns)
    rows, flags = outlier_flags(df, names, method, threshold)
    cells = [
        F.struct(F.lit(c).alias("column_name"), F.count_if(flags[c]).alias("outliers")) for c in names
    ]
    one = rows.agg(
        F.array(*cells).alias("c"),
        F.count_if(_any(flags)).alias("rows_removed"),
        F.count(F.lit(1)).alias("rows_before"),
    )
    return one.select(F.inline("c"), "rows_removed", "rows_before")


def normalize(
    df: DataFrame, columns: Sequence[str] | None = None, method: str = "minmax"
) -> DataFrame:
    """Scale columns: minmax to 0..1, zscore by sample deviation, robust by median and IQR.

    A column without spread stays as it is.
    """
    names = _columns(df, columns)
    if method not in ("minmax", "zscore", "robust"):
        raise ValueError(f"method {method!r} is not minmax, zscore or robust")
    rows = _with(df, _quartiles(df, names) if method == "robust" else _moments(df, names))
    s = F.col("__s")
    new = {}
    for i, c in enumerate(names):
        v = as_number(df, c).cast("double")
        if method == "minmax":
            shift, scale = s[f"min{i}"], s[f"max{i}"] - s[f"min{i}"]
        elif method == "zscore":
            shift, scale = s[f"mean{i}"], s[f"sd{i}"]
        else:
            shift, scale = s[f"mid{i}"], s[f"hi{i}"] - s[f"lo{i}"]
        new[c] = F.when(scale != 0, (v - shift) / scale).otherwise(v)
    return rows.withColumns(new).select(*df.columns)
