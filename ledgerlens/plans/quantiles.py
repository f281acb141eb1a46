"""Exact interpolated quantiles without sorting or holding a group's values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ledgerlens.plans.groups import ROWS, attach, few_groups, largest_group, null_safe_join
from ledgerlens.plans.ordered import running_sum

# Rows of one group up to which the built-in percentile, which holds them in a map, is the plan.
SMALL_GROUP = 50_000
# Sketch accuracy: a sketched quantile is off by at most 1 / ACCURACY of the ranks. Brackets
# reach MARGIN times as far to both sides, so that they hold the wanted ranks for sure.
ACCURACY = 10_000
MARGIN = 4
# Rows of one group up to which a bracket's distinct values fit one task.
BRACKET_ROWS = 1_000_000_000


def quantiles(
    df: DataFrame,
    wanted: dict[str, tuple[str, float]],
    group_by: Sequence[str] = (),
    *,
    plan: str | None = None,
) -> DataFrame:
    """One row per group (one row in all without ``group_by``) with the named quantiles.

    ``wanted`` maps an output name to (column, probability). Small groups go to the built-in
    percentile. Otherwise a sketch gives a narrow bracket of values around each wanted rank;
    a second pass counts the rows between the brackets and, per distinct value, those inside,
    and the counts summed in order lead to the exact values. Only the rows inside the brackets,
    about one in a thousand, are told apart. ``plan`` forces small, bracket or split.
    """
    columns = sorted({c for c, _ in wanted.values()})
    by_column = {c: {n: p for n, (k, p) in wanted.items() if k == c} for c in columns}
    brackets: dict[str, tuple[list[float], int]] = {}
    if not group_by and plan != "small":
        brackets = _sketched(df, by_column)
    if plan is None:
        rows = max(n for _, n in brackets.values()) if brackets else largest_group(df, group_by)
        plan = "small" if rows <= SMALL_GROUP else "bracket" if rows <= BRACKET_ROWS else "split"
    if plan == "small":
        return _built_in(df, by_column, group_by).select(*group_by, *wanted)
    result = None
    for column, names in by_column.items():
        part = _bracketed(df, column, names, list(group_by), plan == "split", brackets.get(column))
        if result is None:
            result = part
        elif group_by:
            result = null_safe_join(result, part, list(group_by), "left")
        else:
            one = part.select(F.struct(*names).alias("s"))
            result = result.withColumn("__q", one.scalar()).select(
                *result.columns, *[F.col("__q")[n].alias(n) for n in names]
            )
    return result.select(*group_by, *wanted)


def _built_in(df: DataFrame, by_column: dict[str, dict[str, float]], group_by: Sequence[str]) -> DataFrame:
    lists = [
        F.percentile(F.col(c).cast("double"), F.array(*[F.lit(p) for p in names.values()])).alias(f"__p{i}")
        for i, (c, names) in enumerate(by_column.items())
    ]
    picks = [
        F.col(f"__p{i}")[j].alias(n) for i, names in enumerate(by_column.values()) for j, n in enumerate(names)
    ]
    return df.groupBy(*group_by).agg(*lists).select(*group_by, *picks)


def _between(low: Column, high: Column, position: Column) -> Column:
    """Interpolate between the values at the ranks around a fractional position."""
    down, up = F.floor(position), F.ceil(position)
    return F.when((low == high) | (down == up), low).otherwise(
        (up - position) * low + (position - down) * high
    )


def _edges(names: dict[str, float]) -> list[float]:
    """Probabilities at the lower and upper end of each wanted one's bracket."""
    reach = MARGIN / ACCURACY
    return [e for p in sorted(set(names.values())) for e in (max(p - reach, 0.0), min(p + reach, 1.0))]


def _sketched(df: DataFrame, by_column: dict[str, dict[str, float]]) -> dict[str, tuple[list[float], int]]:
    """Bracket ends and number of values of all columns, by one pass that returns one row."""
    cells = []
    for i, (c, names) in enumerate(by_column.items()):
        v = F.col(c).cast("double")
        cells += [F.percentile_approx(v, _edges(names), ACCURACY).alias(f"e{i}"), F.count(v).alias(f"n{i}")]
    row = df.agg(*cells).first()
    out = {}
    for i, (c, names) in enumerate(by_column.items()):
        rows = row[f"n{i}"]
        whole = [float("-inf"), float("inf")] * len(set(names.values()))
        out[c] = (whole if rows <= SMALL_GROUP else list(row[f"e{i}"]), rows)
    return out


def _bracketed(
    df: DataFrame,
    column: str,
    names: dict[str, float],
    group_by: list[str],
    split: bool,
    bracket: tuple[list[float], int] | None,
) -> DataFrame:
    value = F.col(column).cast("double").alias("__value")
    known = df.select(*group_by, value).filter(F.col("__value").isNotNull())
    probs = sorted(set(names.values()))
    if bracket is not None:
        rows = known.withColumn("__edges", F.array(*[F.lit(float(e)) for e in bracket[0]]))
    else:
        # A group of few rows is taken whole: its brackets would be narrower than one rank.
        whole = F.array(*[F.lit(x) for _ in probs for x in (float("-inf"), float("inf"))])
        sketch = (
            F.when(F.count(F.lit(1)) <= SMALL_GROUP, whole)
            .otherwise(F.percentile_approx("__value", _edges(names), ACCURACY))
            .alias("__edges")
        )
        small = few_groups(known, group_by)
        ends = known.groupBy(*group_by).agg(sketch, F.count(F.lit(1)).alias(ROWS))
        rows = attach(known, ends, group_by, small=small).drop(ROWS)

    # Rows in the order of their segment: those inside a bracket first, by value, then the
    # rest up to the next bracket as one count.
    v = F.col("__value")
    k = len(probs)
    inside, passed = F.lit(False), F.lit(0)
    for i in range(k):
        lo, hi = F.col("__edges")[2 * i], F.col("__edges")[2 * i + 1]
        inside = inside | ((v >= lo) & (v <= hi))
        passed = passed + F.when(v >= lo, 1).otherwise(0)
    counts = (
        rows.select(
            *group_by,
            passed.alias("__segment"),
            F.when(inside, 0).otherwise(1).alias("__rest"),
            F.when(inside, v).alias("__value"),
        )
        .groupBy(*group_by, "__segment", "__rest", "__value")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    upto = running_sum(
        counts,
        "__n",
        "__upto",
        order_by=["__segment", "__rest", "__value"],
        partition_by=group_by,
        split=split,
    )
    if bracket is not None:
        upto = upto.withColumn("__all", F.lit(bracket[1]).cast("long"))
    elif not split:
        upto = upto.withColumn("__all", F.sum("__n").over(W.partitionBy(*group_by)))
    else:
        sizes = counts.groupBy(*group_by).agg(
            F.sum("__n").alias("__all"), F.count(F.lit(1)).alias(ROWS)
        )
        upto = attach(upto, sizes, group_by, small=small).drop(ROWS)

    def at(rank: Column) -> Column:
        here = (F.col("__upto") - F.col("__n") <= rank) & (rank < F.col("__upto"))
        return F.max(F.when(here, F.col("__value")))

    picks = []
    for i, p in enumerate(names.values()):
        pos = (F.col("__all") - 1) * F.lit(p)
        picks += [at(F.floor(pos)).alias(f"__lo{i}"), at(F.ceil(pos)).alias(f"__hi{i}")]
    picked = upto.groupBy(*group_by).agg(F.max("__all").alias("__all"), *picks)
    out = []
    for i, (name, p) in enumerate(names.items()):
        low, high = F.col(f"__lo{i}"), F.col(f"__hi{i}")
        missed = (F.col("__all") > 0) & (low.isNull() | high.isNull())
        pos = (F.col("__all") - 1) * F.lit(p)
        exact = F.when(
            missed, F.raise_error(F.lit(f"quantile {p} of {column} lies outside its bracket")).cast("double")
        ).otherwise(_between(low, high, pos))
        out.append(exact.alias(name))
    return picked.select(*group_by, *out)
