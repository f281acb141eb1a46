"""Null handling and the cleaning pipeline."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.functions.numeric import (
    is_numeric, numeric_columns, percent, require_columns, string_columns,
)
from ledgerlens.functions.text import simple_name, strip
from ledgerlens.operators import dedup
from ledgerlens.plans.ordered import fill_ordered
from ledgerlens.plans.quantiles import quantiles

STRATEGIES = (
    "drop", "fill_mean", "fill_median", "fill_mode", "fill_forward", "fill_backward",
    "fill_interpolate", "fill_constant", "fill_zero", "keep",
)
# Columns counted in one pass; a grouping set is told apart by one bit for each column.
MODES = 32


def _present(df: DataFrame, column: str) -> Column:
    """Whether a cell holds a value; NaN is none."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        return c.isNotNull() & ~F.isnan(c)
    return c.isNotNull()


def drop_empty_rows(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df
    return df.filter(reduce(or_, [_present(df, c) for c in df.columns]))


def null_counts(df: DataFrame) -> tuple[int, dict[str, int]]:
    """Number of rows and of nulls per column, in one pass."""
    if not df.columns:
        return df.count(), {}
    row = df.agg(
        F.count(F.lit(1)).alias("__all"),
        *[(F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(df.columns)],
    ).first()
    return row["__all"], {c: row[f"n{i}"] for i, c in enumerate(df.columns)}


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Leave out the columns without a single value; one pass decides."""
    rows, nulls = null_counts(df)
    return df.drop(*[c for c, n in nulls.items() if rows and n == rows])


def standardize_names(df: DataFrame) -> DataFrame:
    """Rename to a-z, 0-9 and underscore; two names that become one are an error."""
    names = [simple_name(c) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after renaming: {names}")
    return df.toDF(*names)


def strip_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def strip_values(df: DataFrame) -> DataFrame:
    """Strip white space from text cells."""
    texts = set(string_columns(df))
    cells = [(c, F.col(f"`{c}`")) for c in df.columns]
    return df.select(*[strip(cell).alias(c) if c in texts else cell for c, cell in cells])


def drop_nulls(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Drop the columns with a larger share of nulls than the threshold, then rows with nulls."""
    rows, nulls = null_counts(df)
    sparse = [c for c, n in nulls.items() if rows and n / rows > threshold]
    return df.drop(*sparse).na.drop(how="any")


def most_frequent(df: DataFrame, columns: Sequence[str]) -> Column:
    """The most frequent value of each column, the smallest of several, as one scalar subquery.

    All columns are counted in one scan and one shuffle; a row of a grouping set holds its own column only.
    The struct's fields are m0, m1, ... in the order of the columns, each (-count, value).
    """
    names = [f"m{i}" for i in range(len(columns))]
    cells = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names, strict=True)])
    counts = cells.groupingSets([[n] for n in names], *names).agg(F.count(F.lit(1)).alias("n"))
    best = [F.min(F.when(F.col(n).isNotNull(), F.struct((-F.col("n")).alias("n"), F.col(n).alias("v")))) for n in names]
    return counts.agg(F.struct(*[b.alias(n) for b, n in zip(best, names, strict=True)]).alias("s")).scalar()


def _fill_with_statistics(df: DataFrame, columns: Sequence[str], strategy: str) -> DataFrame:
    columns = [c for c in columns if is_numeric(df, c)]
    if not columns:
        return df
    if strategy == "fill_mean":
        one = df.agg(F.struct(*[F.avg(c).alias(c) for c in columns]).alias("s")).scalar()
    else:
        table = quantiles(df, {f"q{i}": (c, 0.5) for i, c in enumerate(columns)})
        one = table.select(
            F.struct(*[F.col(f"q{i}").alias(c) for i, c in enumerate(columns)]).alias("s")
        ).scalar()
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col("__fill")[c]) for c in columns}
    return df.withColumn("__fill", one).withColumns(filled).drop("__fill")


def fill_nulls(
    df: DataFrame,
    columns: Sequence[str],
    strategy: str,
    *,
    fill_value=None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
) -> DataFrame:
    """Fill the nulls of some columns. Means and medians go to numeric columns only; filling
    from neighbours needs ``order_by``."""
    if strategy not in STRATEGIES:
        raise ValueError(f"strategy {strategy!r} is not one of {STRATEGIES}")
    require_columns(df, *columns)
    if strategy in ("drop", "keep"):
        return df
    if strategy in ("fill_mean", "fill_median"):
        return _fill_with_statistics(df, columns, strategy)
    if strategy == "fill_mode":
        for k in range(0, len(columns), MODES):
            some = columns[k : k + MODES]
            filled = {c: F.coalesce(F.col(c), F.col("__modes")[f"m{i}"]["v"]) for i, c in enumerate(some)}
            df = df.withColumn("__modes", most_frequent(df, some)).withColumns(filled).drop("__modes")
        return df
    if strategy in ("fill_forward", "fill_backward", "fill_interpolate"):
        if not order_by:
            raise ValueError(f"{strategy} needs order_by")
        how = strategy.removeprefix("fill_")
        for c in columns:
            if how == "interpolate" and not is_numeric(df, c):
                continue
            df = fill_ordered(
                df, c, how, order_by=order_by, partition_by=partition_by, max_group_rows=max_group_rows
            )
        return df
    if strategy == "fill_zero":
        return df.na.fill(0, subset=[c for c in columns if is_numeric(df, c)])
    if fill_value is None:
        raise ValueError("fill_constant needs fill_value")
    fits = string_columns(df) if isinstance(fill_value, str) else numeric_columns(df)
    return df.na.fill(fill_value, subset=[c for c in columns if c in fits])


def handle_nulls(
    df: DataFrame,
    strategy: str = "drop",
    threshold: float = 0.5,
    *,
    fill_value=None,
    column_strategies: dict[str, str] | None = None,
    order_by: Sequence[str] = (),
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Column strategies first, then the default one for the other columns."""
    options = {"fill_value": fill_value, "order_by": order_by, "partition_by": partition_by}
    special = {c: s for c, s in (column_strategies or {}).items() if c in df.columns}
    for c, s in special.items():
        df = fill_nulls(df, [c], s, **options)
    if strategy == "drop":
        return drop_nulls(df, threshold)
    others = [c for c in df.columns if c not in special and c not in order_by and c not in partition_by]
    if strategy not in ("keep", "fill_constant", "fill_zero"):
        _, nulls = null_counts(df)
        others = [c for c in others if nulls[c]]
    return fill_nulls(df, others, strategy, **options)


@dataclass
class CleaningOptions:
    """Switches of the cleaning pipeline, in the order of its steps."""

    remove_empty_rows: bool = True
    remove_empty_columns: bool = True
    standardize_columns: bool = True
    remove_whitespace: bool = True
    null_strategy: str = "drop"
    null_threshold: float = 0.5
    fill_value: object = None
    column_specific_strategies: dict[str, str] = field(default_factory=dict)
    drop_duplicates: bool = True
    duplicate_subset: Sequence[str] | None = None
    duplicate_keep: str | bool = "first"
    mark_duplicates_only: bool = False
    order_by: Sequence[str] = ()
    validate: bool = True


def clean_data(df: DataFrame, options: CleaningOptions | None = None, **switches) -> DataFrame:
    """Empty rows, empty columns, names, white space, nulls, duplicates - in that order.

    With ``validate``, a table that the steps before the duplicates leave without a row or a column is an
    error; looking for one row there needs no shuffle.
    """
    o = options or CleaningOptions(**switches)
    if o.remove_empty_rows:
        df = drop_empty_rows(df)
    if o.remove_empty_columns:
        df = drop_empty_columns(df)
    if o.standardize_columns:
        df = standardize_names(df)
    if o.remove_whitespace:
        df = strip_values(df)
    df = handle_nulls(
        df,
        o.null_strategy,
        o.null_threshold,
        fill_value=o.fill_value,
        column_strategies=o.column_specific_strategies,
        order_by=o.order_by,
    )
    if o.validate:
        validate_cleaned(df)
    if o.mark_duplicates_only:
        return dedup.mark_duplicates(df, o.duplicate_subset, o.duplicate_keep, o.order_by)
    if o.drop_duplicates:
        return dedup.drop_duplicates(df, o.duplicate_subset, o.duplicate_keep, o.order_by)
    return df


def _size(df: DataFrame, suffix: str):
    nulls = [F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0) for c in df.columns]
    total = sum(nulls[1:], nulls[0]) if nulls else F.lit(0)
    return df.agg(
        F.struct(
            F.count(F.lit(1)).alias("rows"),
            F.lit(len(df.columns)).alias("columns"),
            F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("nulls"),
        ).alias(suffix)
    )


def cleaning_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows, columns and nulls on both sides, what was removed, and the quality score."""
    one = _size(after, "a").withColumn("b", _size(before, "b").scalar())
    cells = F.col("a.rows") * F.col("a.columns")
    null_share = percent(F.col("a.nulls"), cells)
    warnings = F.array_compact(
        F.array(
            F.when(F.col("a.rows") == 0, F.lit("cleaning left no rows")),
            F.when(null_share > 30, F.lit("more than 30 % nulls after cleaning")),
            F.when(
                F.col("a.rows") * 2 < F.col("b.rows"), F.lit("less than half of the rows retained")
            ),
        )
    )
    return one.select(
        F.col("b.rows").alias("rows_before"),
        F.col("b.columns").alias("columns_before"),
        F.col("b.nulls").alias("nulls_before"),
        F.col("a.rows").alias("rows_after"),
        F.col("a.columns").alias("columns_after"),
        F.col("a.nulls").alias("nulls_after"),
        (F.col("b.nulls") - F.col("a.nulls")).alias("nulls_handled"),
        (F.col("b.rows") - F.col("a.rows")).alias("rows_removed"),
        (F.col("b.columns") - F.col("a.columns")).alias("columns_removed"),
        F.coalesce(null_share, F.lit(0.0)).alias("null_percentage_after"),
        F.coalesce(100 - null_share, F.lit(0.0)).alias("data_quality_score"),
        F.array_join(warnings, "; ").alias("warnings"),
    )


def validate_cleaned(df: DataFrame) -> DataFrame:
    """Raise when cleaning left nothing."""
    if not df.columns:
        raise ValueError("all columns were removed during cleaning")
    if df.isEmpty():
        raise ValueError("cleaning left no rows")
    return df


def clean_on_load(df: DataFrame) -> DataFrame:
    """Empty rows, empty columns, stripped names."""
    return strip_names(drop_empty_columns(drop_empty_rows(df)))


def process_upload(df: DataFrame) -> DataFrame:
    """Empty rows, empty columns, standard names, stripped values."""
    return strip_values(standardize_names(drop_empty_columns(drop_empty_rows(df))))
