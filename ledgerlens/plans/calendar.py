"""Dense period tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlens.functions.periods import period_step

# No calendar column has more periods than this (days of 10,000 years).
MAX_PERIODS = 3_700_000


def dense(
    by_period: DataFrame, start: str, period: str, zeros: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Fill the gaps between periods that have rows.

    Each period row is repeated up to the next one; repeats get 0 in ``zeros`` and null
    elsewhere. The input has one row per period, so the ordered window is bounded by the
    calendar and the facts are read once.
    """
    by = W.partitionBy(*partition_by).orderBy(start)
    step = period_step(period)
    last = F.coalesce((F.lead(start).over(by) - step).cast("date"), F.col(start))
    rows = by_period.withColumn("__last", last).withColumn(
        "__at", F.explode(F.sequence(F.col(start), F.col("__last"), step))
    )
    real = F.col("__at") == F.col(start)
    out = []
    for c in by_period.columns:
        if c in partition_by:
            out.append(F.col(c))
        elif c == start:
            out.append(F.col("__at").alias(c))
        elif c in zeros:
            out.append(F.when(real, F.col(c)).otherwise(F.lit(0).cast(by_period.schema[c].dataType)).alias(c))
        else:
            out.append(F.when(real, F.col(c)).alias(c))
    return rows.select(*out)
