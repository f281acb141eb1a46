"""Duplicate rows: drop, mark, find, report, priority.

A group of copies may be a large part of the table, so groups are never sorted in one task:
the row to keep is the smallest or largest struct of its group, which is combined map-side.
``order_by`` says which copy comes first and has to be unique within a group; without it, the
copies are told apart by all columns.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import wraps

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlens.functions.numeric import percent, require_columns
from ledgerlens.plans.groups import ROWS, attach
from ledgerlens.plans.ordered import fits_one_task

KEEP = ("first", "last", False)
FLAG = "__duplicate"
# Copies of one row that one task makes at a time.
COPIES = 1_000_000


def any_names(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """Let an operator take columns whose names hold dots or backticks: they have other names while it works."""

    @wraps(fn)
    def run(df: DataFrame, *args, **kwargs) -> DataFrame:
        odd = {c: f"__odd{i}" for i, c in enumerate(df.columns) if "." in c or "`" in c}
        if not odd:
            return fn(df, *args, **kwargs)

        def named(x):
            if isinstance(x, str):
                return odd.get(x, x)
            return [named(y) for y in x] if isinstance(x, (list, tuple)) else x

        out = fn(df.toDF(*[odd.get(c, c) for c in df.columns]), *map(named, args), **{k: named(v) for k, v in kwargs.items()})
        back = {v: k for k, v in odd.items()}
        ends = {f"{e}_{v}": f"{e}_{k}" for e in ("first", "last") for v, k in back.items()}
        return out.toDF(*[(back | ends).get(c, c) for c in out.columns])

    return run


def key_columns(df: DataFrame, subset: Sequence[str] | None) -> list[str]:
    """The columns of the subset the table has, or all columns when none is left."""
    known = [c for c in subset or [] if c in df.columns]
    return known or list(df.columns)


def _order(df: DataFrame, order_by: Sequence[str], keys: Sequence[str]) -> list[str]:
    require_columns(df, *order_by)
    rest = [c for c in df.columns if c not in keys]
    return [*order_by, *[c for c in rest if c not in order_by]]


def _check_keep(keep) -> None:
    if keep not in KEEP:
        raise ValueError(f"keep {keep!r} is not one of {KEEP}")


@any_names
def drop_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """One row per key (first or last), or only the rows whose key occurs once (False)."""
    _check_keep(keep)
    keys = key_columns(df, subset)
    rest = _order(df, order_by, keys)
    if not rest:
        by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))
        return (by if keep else by.filter(F.col(ROWS) == 1)).select(*df.columns)
    row = F.struct(*rest)
    pick = F.max(row) if keep == "last" else F.min(row)
    by = df.groupBy(*keys).agg(pick.alias("__row"), F.count(F.lit(1)).alias(ROWS))
    if keep is False:
        by = by.filter(F.col(ROWS) == 1)
    fields = {c: F.col("__row")[c].alias(c) for c in rest}
    return by.select(*[fields.get(c, F.col(c)) for c in df.columns])


def _flagged(df: DataFrame, keys: list[str], order: list[str], keep) -> DataFrame:
    """Each row with the size of its group and whether dropping with ``keep`` would remove it.

    One shuffle and a window while every group fits a task. Otherwise sizes and the row to keep
    are aggregated map-side and joined back; there, identical rows are counted as one and
    told apart again by number at the end.
    """
    if fits_one_task(df, keys):
        group = W.partitionBy(*keys)
        rows = df.withColumn(ROWS, F.count(F.lit(1)).over(group))
        if keep is False:
            return rows.withColumn(FLAG, F.col(ROWS) > 1)
        direction = F.desc if keep == "last" else F.asc
        number = F.row_number().over(group.orderBy(*[direction(c) for c in order or keys]))
        return rows.withColumn(FLAG, number > 1)
    if keep is False:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))
        return attach(df, sizes, keys).withColumn(FLAG, F.col(ROWS) > 1)
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__copies"))
    position = F.struct(*order) if order else F.lit(0)
    pick = F.max if keep == "last" else F.min
    stats = copies.groupBy(*keys).agg(F.sum("__copies").alias(ROWS), pick(position).alias("__kept"))
    rows = attach(copies, stats, keys, small=False)
    rows = rows.withColumn("__other", ~position.eqNullSafe(F.col("__kept"))).drop("__kept")
    return _repeated(rows).withColumn(FLAG, F.col("__other") | (F.col("__number") > 1))


def _repeated(rows: DataFrame) -> DataFrame:
    """Each row ``__copies`` times, numbered; very many copies are made by several tasks."""
    n = F.col("__copies")
    parts = rows.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / COPIES))))
    spread = parts.repartition(*[F.col(c) for c in rows.columns], F.col("__part"))
    first = F.col("__part") * COPIES + 1
    return spread.withColumn("__number", F.explode(F.sequence(first, F.least(n, first + COPIES - 1))))


@any_names
def mark_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = "first",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Add ``_is_duplicate``: the rows that dropping with the same arguments would remove."""
    _check_keep(keep)
    keys = key_columns(df, subset)
    rows = _flagged(df, keys, _order(df, order_by, keys), keep)
    return rows.select(*df.columns, F.col(FLAG).alias("_is_duplicate"))


@any_names
def find_duplicates(
    df: DataFrame,
    subset: Sequence[str] | None = None,
    keep: str | bool = False,
    order_by: Sequence[str] = (),
    with_group: bool = False,
) -> DataFrame:
    """The duplicate rows; ``with_group`` adds the size of each row's group."""
    _check_keep(keep)
    keys = key_columns(df, subset)
    rows = _flagged(df, keys, _order(df, order_by, keys), keep).filter(FLAG)
    extra = [F.col(ROWS).alias("group_rows")] if with_group else []
    return rows.select(*df.columns, *extra)


@any_names
def duplicate_groups(
    df: DataFrame, subset: Sequence[str] | None = None, order_by: Sequence[str] = ()
) -> DataFrame:
    """One row per key that occurs more than once: its size, first and last position.

    The member rows are those of ``find_duplicates(..., with_group=True)``: they stay rows,
    because a group of copies may not fit into one value.
    """
    keys = key_columns(df, subset)
    ends = []
    for c in order_by:
        ends += [F.min(c).alias(f"first_{c}"), F.max(c).alias(f"last_{c}")]
    by = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *ends)
    return by.filter(F.col("group_rows") > 1)


@any_names
def duplicate_report(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first") -> DataFrame:
    """Rows in duplicate groups, number of groups, rows removed and share of rows retained."""
    _check_keep(keep)
    by = df.groupBy(*key_columns(df, subset)).agg(F.count(F.lit(1)).alias("n"))
    several = F.col("n") > 1
    removed = F.when(several, F.col("n") if keep is False else F.col("n") - 1).otherwise(0)
    one = by.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_before"),
        F.coalesce(F.sum(F.when(several, F.col("n"))), F.lit(0)).alias("duplicates_found"),
        F.count_if(several).alias("duplicate_groups"),
        F.coalesce(F.sum(removed), F.lit(0)).cast("long").alias("duplicates_removed"),
    )
    after = F.col("rows_before") - F.col("duplicates_removed")
    return one.select(
        "*", after.alias("rows_after"), percent(after, F.col("rows_before"), 0.0).alias("retention_rate")
    )


@any_names
def drop_by_priority(
    df: DataFrame,
    subset: Sequence[str],
    priority_column: str,
    priority_order: str = "max",
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Per key the row with the largest or smallest priority, nulls last, first row on ties.

    The first row of each (key, priority) is picked first, the best priority after that.
    """
    if priority_order not in ("max", "min"):
        raise ValueError(f"priority_order {priority_order!r} is not max or min")
    require_columns(df, *subset, priority_column)
    keys = list(subset)
    per_priority = drop_duplicates(df, [*keys, priority_column], "first", order_by)
    rest = [c for c in df.columns if c not in keys and c != priority_column]
    best = F.struct(F.col(priority_column).isNull().alias("n"), F.col(priority_column).alias("p"),
                    F.struct(*rest).alias("r") if rest else F.lit(None).alias("r"))
    if priority_order == "max":
        best = F.struct(F.col(priority_column).isNotNull().alias("n"), *[best[f].alias(f) for f in ("p", "r")])
    pick = F.max(best) if priority_order == "max" else F.min(best)
    by = per_priority.groupBy(*keys).agg(pick.alias("__b"))
    fields = {c: F.col("__b.r")[c].alias(c) for c in rest}
    fields[priority_column] = F.col("__b.p").alias(priority_column)
    return by.select(*[fields.get(c, F.col(c)) for c in df.columns])
