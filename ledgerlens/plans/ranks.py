"""Dense ranks over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ledgerlens.plans.groups import ROWS, TASK_ROWS, attach
from ledgerlens.plans.ordered import positions
from ledgerlens.session import cut_lineage


def dense_ranks(df: DataFrame, ranks: dict[str, str], *, split: bool | None = None) -> DataFrame:
    """Add dense ranks, highest value first; ``ranks`` maps an output name to a column.

    A table one task can sort uses the window. A larger one is ranked by its distinct values,
    numbered over range slices, and the numbers are joined back by value. A null has no rank.
    """
    if split is None:
        split = df.count() > TASK_ROWS
    if not split:
        return df.select(
            "*",
            *[
                F.when(F.col(c).isNotNull(), F.dense_rank().over(W.orderBy(F.desc(c)))).alias(n)
                for n, c in ranks.items()
            ],
        )
    # The table is read once per rank and again for the join, so it is written down first.
    df = out = cut_lineage(df, "ranked")
    for name, column in ranks.items():
        values = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias(ROWS))
        falling = values.withColumn("__fall", -F.col(column))
        numbered = positions(falling, "__at", order_by=["__fall"], split=True)
        numbered = numbered.select(column, ROWS, (F.col("__at") + 1).cast("int").alias(name))
        out = attach(out, numbered, [column], small=False).drop(ROWS)
    return out
