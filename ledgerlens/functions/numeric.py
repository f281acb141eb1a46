"""Numeric columns: coercion, safe ratios, exact averages, rounding."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, functions as F, types as T


def require_columns(df: DataFrame, *names: str | None) -> None:
    """Raise ValueError for columns the table does not have."""
    missing = [n for n in names if n is not None and n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}; available: {df.columns}")


def is_numeric(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def as_number(df: DataFrame, name: str) -> Column:
    """The column as a number; text that is no number and NaN become null."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        c = F.trim(c).try_cast("double")
        return F.when(~F.isnan(c), c)
    if isinstance(kind, T.BooleanType):
        return c.cast("int")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, T.NumericType):
        return c
    raise ValueError(f"column {name} of type {kind.simpleString()} is not numeric")


def ratio(top: Column, bottom: Column, default: float | None = None) -> Column:
    """Double division; a zero or null divisor gives ``default``."""
    value = F.try_divide(top.cast("double"), bottom.cast("double"))
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def percent(top: Column, bottom: Column, default: float | None = None) -> Column:
    value = F.try_divide(top.cast("double"), bottom.cast("double")) * F.lit(100.0)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def exact_avg(c: Column) -> Column:
    """Average as sum / count: a decimal input is summed exactly, in any order."""
    return ratio(F.sum(c), F.count(c))


def rounded(c: Column, digits: int | None) -> Column:
    """Round doubles to the nearest step, ties to the even one; None leaves the value as it is."""
    if digits is None:
        return c
    step = F.lit(10.0**digits)
    return F.rint(c.cast("double") * step) / step


def scaled(c: Column, scale: int = 2) -> Column:
    """A double amount as a whole number of its smallest unit, e.g. cents."""
    return F.rint(c * F.lit(10.0**scale)).cast("long")


def from_scaled(units: Column, scale: int) -> Column:
    """Whole units back to an exact decimal of 18 digits; cheaper than casting each double."""
    step = F.lit(Decimal(1).scaleb(-scale)).cast(f"decimal({scale},{scale})")
    return (units.cast(f"decimal({17 - scale},0)") * step).cast(f"decimal(18,{scale})")
