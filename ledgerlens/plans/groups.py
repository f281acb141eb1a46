"""Joining per-group aggregates back to rows when one group may hold most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Rows of a per-group table that may be broadcast after its size was checked.
BROADCAST_ROWS = 200_000
# A group above this size is hot. There are at most (all rows / HOT_ROWS) hot groups,
# which bounds the table of hot groups whatever the data.
HOT_ROWS = 5_000_000
# Rows of one group that one task may sort.
TASK_ROWS = 2_000_000

ROWS = "__rows"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; counted with map-side combine, so a hot key is cheap."""
    if not keys:
        return df.count()
    return df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0


def few_groups(df: DataFrame, keys: Sequence[str], limit: int = BROADCAST_ROWS) -> bool:
    """Whether the keys have at most ``limit`` values. The sketch needs no shuffle of rows;
    its error (5 %) is covered by asking for a tenth less."""
    key = F.struct(*[F.col(k) for k in keys]) if len(keys) != 1 else F.col(keys[0])
    return (df.agg(F.approx_count_distinct(F.xxhash64(key))).first()[0] or 0) <= limit * 0.9


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner"
) -> DataFrame:
    """Equi join in which nulls match; the key columns of the left side are kept."""
    renamed = right.select(
        *[F.col(k).alias(f"__r{i}") for i, k in enumerate(keys)],
        *[F.col(c) for c in right.columns if c not in keys],
    )
    cond = [left[k].eqNullSafe(renamed[f"__r{i}"]) for i, k in enumerate(keys)]
    return left.join(renamed, cond, how).drop(*[f"__r{i}" for i in range(len(keys))])


def attach(
    df: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    *,
    rows: str = ROWS,
    small: bool | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left-join ``stats`` (one row per key, group size in column ``rows``) to the rows.

    Few groups: a broadcast join, after the number of groups was checked; the rows do not move.
    Many groups: a shuffle join, unless some group turns out to be hot. Then the hot groups,
    whose number is bounded by their size, are broadcast to their rows, which stay where they
    are, and only the rows of the other groups are shuffled.
    """
    keys = list(keys)
    values = [c for c in stats.columns if c not in keys]
    if small is None:
        small = few_groups(df, keys)
    if small:
        return null_safe_join(df, F.broadcast(stats), keys, "left")

    if largest_group(df, keys) <= hot_rows:
        return null_safe_join(df, stats, keys, "left")
    hot = F.broadcast(stats.filter(F.col(rows) > hot_rows))
    cold = stats.filter(F.col(rows) <= hot_rows)
    in_hot = null_safe_join(df, hot, keys, "inner")
    in_cold = null_safe_join(null_safe_join(df, hot.select(*keys), keys, "left_anti"), cold, keys, "left")
    columns = [*df.columns, *values]
    return in_hot.select(*columns).unionByName(in_cold.select(*columns))


def with_totals(df: DataFrame, source: DataFrame, **totals: Column) -> DataFrame:
    """Add one-row aggregates of ``source`` as scalar subqueries: no join, no shuffle of rows."""
    names = list(totals)
    one = source.agg(F.struct(*[totals[n].alias(n) for n in names]).alias("s"))
    out = df.withColumn("__one", one.scalar())
    return out.select(*df.columns, *[F.col("__one")[n].alias(n) for n in names])


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join to a table with unique keys, also when one key holds most of the rows.

    A dimension whose counted size allows it is broadcast; a larger one is shuffled, while the
    rows of hot keys meet the few dimension rows they need by broadcast.
    """
    keys = list(keys)
    if dim.count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(dim), keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(ROWS))
    stats = dim.join(sizes, keys)
    return attach(df, stats, keys, small=False).filter(F.col(ROWS).isNotNull()).drop(ROWS)
