"""Order-dependent columns (running sums, positions, moving frames, fills) on any group size.

A plain window sorts each group in one task. That is the plan while the largest group is known
to be small; ``max_group_rows`` states a bound (periods of a calendar), otherwise it is counted.
Beyond TASK_ROWS the rows are range-partitioned by (group, order) into slices, each slice is
worked on by itself, and one summary row per (group, slice) carries totals and last values over.
``order_by`` has to be unique within a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.plans.groups import TASK_ROWS, largest_group, null_safe_join
from ledgerlens.session import cut_lineage

SLICE = "__slice"
EARLIER = (W.unboundedPreceding, -1)


def fits_one_task(
    df: DataFrame, partition_by: Sequence[str], max_group_rows: int | None = None
) -> bool:
    rows = largest_group(df, partition_by) if max_group_rows is None else max_group_rows
    return rows <= TASK_ROWS


def sliced(df: DataFrame, partition_by: Sequence[str], order_by: Sequence[str]) -> DataFrame:
    """Rows in contiguous ranges of (group, order), with the number of the range written down.

    There are as many ranges as keep each below TASK_ROWS, however few partitions the session shuffles into.
    """
    spark = df.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // (TASK_ROWS // 2 or 1)))
    ranged = df.repartitionByRange(ranges, *[F.col(c) for c in (*partition_by, *order_by)])
    return cut_lineage(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _carry(
    rows: DataFrame, partition_by: Sequence[str], per_slice: dict[str, Column], *steps: dict
) -> DataFrame:
    """Join to each row what its group's earlier (or later) slices contribute.

    A group has at most one summary row per slice, so the windows over them are small, and a
    (group, slice) pair has at most one slice of rows, so the join is even. Each step maps
    names to functions from the group's window; a later step may use an earlier one's columns.
    """
    carry = rows.groupBy(*partition_by, SLICE).agg(*[v.alias(k) for k, v in per_slice.items()])
    over_slices = W.partitionBy(*partition_by)
    names = []
    for step in steps:
        carry = carry.select("*", *[make(over_slices).alias(k) for k, make in step.items()])
        names += list(step)
    return null_safe_join(rows, carry.select(*partition_by, SLICE, *names), [*partition_by, SLICE], "left")


def running_sum(
    df: DataFrame,
    value: str | Column,
    out: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add the sum of ``value`` from the group's first row up to the current one."""
    value = F.col(value) if isinstance(value, str) else value
    if split is None:
        split = not fits_one_task(df, partition_by, max_group_rows)
    if not split:
        frame = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
        return df.withColumn(out, F.sum(value).over(frame))
    rows = sliced(df.withColumn("__v", value), partition_by, order_by)
    rows = _carry(
        rows,
        partition_by,
        {"__s": F.sum("__v")},
        {"__before": lambda w: F.sum("__s").over(w.orderBy(SLICE).rowsBetween(*EARLIER))},
    )
    frame = (
        W.partitionBy(*partition_by, SLICE).orderBy(*order_by).rowsBetween(W.unboundedPreceding, 0)
    )
    local = F.sum("__v").over(frame)
    total = (
        F.when(F.col("__before").isNull(), local)
        .when(local.isNull(), F.col("__before"))
        .otherwise(F.col("__before") + local)
    )
    return rows.withColumn(out, total).select(*df.columns, out)


def positions(
    df: DataFrame,
    out: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add the zero-based position of each row within its group."""
    counted = running_sum(
        df,
        F.lit(1).cast("long"),
        out,
        order_by=order_by,
        partition_by=partition_by,
        max_group_rows=max_group_rows,
        split=split,
    )
    return counted.withColumn(out, F.col(out) - 1)


def moving(
    df: DataFrame,
    columns: dict,
    before: int,
    after: int,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    split: bool | None = None,
    block: int | None = None,
) -> DataFrame:
    """Add columns over the frame of ``before`` rows before to ``after`` rows after each row.

    ``columns`` maps a name to a function from the window to a column.
    """
    if split is None:
        split = not fits_one_task(df, partition_by, max_group_rows)
    if not split:
        frame = W.partitionBy(*partition_by).orderBy(*order_by).rowsBetween(-before, after)
        return df.select("*", *[make(frame).alias(k) for k, make in columns.items()])
    # Cut the positions into blocks; rows near a block's edge are copied to the neighbour
    # as context and dropped again after the frame is computed.
    size = max(block or TASK_ROWS // 4, before + after + 1)
    rows = positions(df, "__pos", order_by=order_by, partition_by=partition_by, split=True)
    at = F.col("__pos") % size
    home = F.floor(F.col("__pos") / size).cast("long")
    targets = F.array_compact(
        F.array(
            home,
            F.when(at >= size - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((at < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = rows.withColumn("__home", home).withColumn("__block", F.explode(targets))
    frame = W.partitionBy(*partition_by, "__block").orderBy("__pos").rowsBetween(-before, after)
    framed = spread.select("*", *[make(frame).alias(k) for k, make in columns.items()])
    return framed.filter(F.col("__block") == F.col("__home")).select(*df.columns, *columns)


def _nearest(value: str, by, order: str) -> tuple[Column, Column]:
    """Last known value up to the row, and first one from it on.

    Both frames run from the start of their own order, so that each row is visited once; a
    frame that ends at the end of the group would be evaluated anew for every row.
    """
    upto = (W.unboundedPreceding, 0)
    return (
        F.last(value, True).over(by.orderBy(order).rowsBetween(*upto)),
        F.last(value, True).over(by.orderBy(F.desc(order)).rowsBetween(*upto)),
    )


def neighbours(
    df: DataFrame,
    value: str,
    *,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
    max_group_rows: int | None = None,
    split: bool | None = None,
) -> DataFrame:
    """Add ``__prev`` and ``__next``: (position, value) of the nearest non-null value at or
    before, and at or after, each row; and ``__pos``, the row's position."""
    if split is None:
        split = not fits_one_task(df, partition_by, max_group_rows)
    if not split:
        by = W.partitionBy(*partition_by)
        number = F.row_number().over(by.orderBy(*order_by)).cast("long") - 1
        rows = df.withColumn("__pos", number).withColumn("__known", _known("__pos", value))
        prev, nxt = _nearest("__known", by, "__pos")
        return rows.withColumn("__prev", prev).withColumn("__next", nxt).drop("__known")
    # Positions within the slice first; the rows of earlier slices are added afterwards.
    by = W.partitionBy(*partition_by, SLICE)
    rows = sliced(df, partition_by, order_by)
    rows = rows.withColumn("__at", F.row_number().over(by.orderBy(*order_by)).cast("long") - 1)
    rows = rows.withColumn("__known", _known("__at", value))
    rows = _carry(
        rows,
        partition_by,
        {"__n": F.count(F.lit(1)), "__lo": F.min("__known"), "__hi": F.max("__known")},
        {"__base": lambda w: F.coalesce(F.sum("__n").over(w.orderBy(SLICE).rowsBetween(*EARLIER)), F.lit(0))},
        {
            "__before": lambda w: F.last(_shifted("__hi"), True).over(w.orderBy(SLICE).rowsBetween(*EARLIER)),
            "__after": lambda w: F.last(_shifted("__lo"), True).over(
                w.orderBy(F.desc(SLICE)).rowsBetween(*EARLIER)
            ),
        },
    )
    prev, nxt = _nearest("__known", by, "__at")
    rows = rows.withColumn("__p", prev).withColumn("__f", nxt)
    return rows.select(
        *df.columns,
        (F.col("__at") + F.col("__base")).alias("__pos"),
        F.coalesce(_shifted("__p"), F.col("__before")).alias("__prev"),
        F.coalesce(_shifted("__f"), F.col("__after")).alias("__next"),
    )


def _known(position: str, value: str) -> Column:
    pair = F.struct(F.col(position).alias("p"), F.col(value).alias("v"))
    return F.when(F.col(value).isNotNull(), pair)


def _shifted(pair: str) -> Column:
    """A (position, value) of a slice with the position in the whole group."""
    moved = F.struct((F.col(pair)["p"] + F.col("__base")).alias("p"), F.col(pair)["v"].alias("v"))
    return F.when(F.col(pair).isNotNull(), moved)


def fill_ordered(df: DataFrame, value: str, how: str, **scope) -> DataFrame:
    """Fill nulls of ``value`` from its neighbours: forward, backward or interpolate.

    Interpolation is linear by position; leading nulls stay, trailing ones take the last value.
    """
    rows = neighbours(df, value, **scope)
    prev, nxt = F.col("__prev"), F.col("__next")
    if how == "forward":
        filled = prev["v"]
    elif how == "backward":
        filled = nxt["v"]
    elif how == "interpolate":
        slope = F.try_divide(
            nxt["v"].cast("double") - prev["v"].cast("double"), nxt["p"] - prev["p"]
        )
        line = slope * (F.col("__pos") - prev["p"]) + prev["v"].cast("double")
        filled = (
            F.when(F.col(value).isNotNull(), F.col(value).cast("double"))
            .when(prev.isNull(), F.lit(None))
            .when(nxt.isNull(), prev["v"].cast("double"))
            .otherwise(line)
        )
    else:
        raise ValueError(f"unknown fill {how!r}")
    return rows.withColumn(value, filled).select(*df.columns)
