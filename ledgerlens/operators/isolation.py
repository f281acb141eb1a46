"""Isolation forest on one measure.

On a single measure a random tree is a set of intervals with a path length each, and a forest
is the mean of such step functions. Each tree is grown on its own small sub-sample, as the
method asks; every row of the table is then scored against the merged steps. The draw follows
one rule at every size, for a whole table as for a group, and sends no row twice.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.plans.groups import largest_group
from ledgerlens.plans.ordered import running_sum
from ledgerlens.plans.quantiles import quantiles
from ledgerlens.session import cut_lineage

# The functions of this module travel by value, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TREES = 100
SAMPLE = 256
SEED = 42


def _mean_depth(n: int) -> float:
    """Average path length of an unsuccessful search in a tree of n values."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def grow_tree(values: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Lower edges and path lengths of the steps of one tree grown on its sub-sample."""
    values = np.sort(values)
    limit = int(np.ceil(np.log2(max(len(values), 2))))
    steps = []
    todo = [(values, -np.inf, 0)]
    while todo:
        part, edge, depth = todo.pop()
        if depth >= limit or len(part) <= 1 or part[0] == part[-1]:
            steps.append((edge, depth + _mean_depth(len(part))))
            continue
        cut = rng.uniform(part[0], part[-1])
        at = int(np.searchsorted(part, cut, side="left"))
        todo.append((part[at:], cut, depth + 1))
        todo.append((part[:at], edge, depth + 1))
    edges, depths = zip(*sorted(steps), strict=True)
    return np.array(edges), np.array(depths)


def grow_forest(values: np.ndarray, marks: np.ndarray, trees: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges and summed path lengths of all trees.

    Rows lie on a circle by their marks in [0, 1). A tree takes the `sample` rows that follow its own point
    on the circle, all rows where there are no more.
    """
    order = np.lexsort((values, marks))
    values, marks = values[order], marks[order]
    taken = min(sample, len(values))
    grown = []
    for tree in range(trees):
        first = int(np.searchsorted(marks, tree / trees))
        own = values[(first + np.arange(taken)) % len(values)]
        grown.append(grow_tree(own, np.random.default_rng(SEED + tree)))
    edges = np.unique(np.concatenate([e for e, _ in grown]))
    total = np.zeros(len(edges))
    for own, depths in grown:
        total += depths[np.searchsorted(own, edges, side="right") - 1]
    return edges, total


def candidates(df: DataFrame, value: str, size: Column, keep: Sequence[str], key: Sequence[str], trees: int, sample: int) -> DataFrame:
    """keep, value and mark of the rows that some tree may take: those near behind a tree's point on the circle.

    Behind each point an arc is kept that holds four times the sample on average, the whole circle for few rows. So a group
    sends at most some 4 * trees * sample rows, each once, and the trees of a group take the same rows as from all of it.
    The mark is a hash of the rows' unique key; without one it is random, so that copies of one row do not lie together.
    """
    draw = F.xxhash64(*[F.col(c) for c in key]) if key else F.xxhash64(F.rand(SEED))
    mark = F.shiftrightunsigned(draw, 11) / F.lit(float(1 << 53))
    rows = df.select(*keep, F.col(value).cast("double").alias("value"), mark.alias("mark"), size.cast("long").alias("size"))
    arc = (F.col("mark") * trees - F.floor(F.col("mark") * trees)) / trees
    return rows.filter(F.col("value").isNotNull() & (arc * F.col("size") < float(4 * sample)))


def forest_steps(df: DataFrame, value: str, key: Sequence[str], size: int, trees: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges and mean path lengths of the whole forest: at most trees * sample steps."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        edges, total = grow_forest(pdf["value"].to_numpy(float), pdf["mark"].to_numpy(float), trees, sample)
        return pd.DataFrame({"edge": edges, "depth": total / trees})

    rows = candidates(df, value, F.lit(size), [], key, trees, sample).withColumn("g", F.lit(0))
    steps = rows.groupBy("g").applyInPandas(grow, "edge double, depth double").toPandas().sort_values("edge")
    if steps.empty:  # no value at all
        return np.array([-np.inf]), np.array([np.nan])
    return steps["edge"].to_numpy(), steps["depth"].to_numpy()


def group_steps(df: DataFrame, value: str, groups: Sequence[str], key: Sequence[str], trees: int, sample: int) -> DataFrame:
    """Changes of the summed path length (group, edge, change) of one forest per group.

    A group whose rows are all here needs them at its own values only, no more rows than it has; a larger one at the cuts.
    """

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        values = pdf["value"].to_numpy(float)
        edges, total = grow_forest(values, pdf["mark"].to_numpy(float), trees, sample)
        if len(pdf) == pdf["size"].iloc[0]:
            own = np.unique(values)
            edges, total = own, total[np.searchsorted(edges, own, side="right") - 1]
        out = pd.DataFrame({"edge": edges, "change": np.diff(total, prepend=0.0)})
        for g in groups:
            out[g] = pdf[g].iloc[0]
        return out

    rows = candidates(df, value, F.col("__size"), groups, key, trees, sample)
    fields = ", ".join(f"`{g}` {df.schema[g].dataType.simpleString()}" for g in groups)
    return rows.groupBy(*groups).applyInPandas(grow, f"edge double, change double, {fields}")


def grouped_scores(df: DataFrame, value: str, scope, trees: int, sample: int) -> DataFrame:
    """Score each row against its group's forest: the summed path length at a value is the
    running sum of the changes at the edges up to it."""
    groups, key = scope.group_by, scope.order_by
    sized = scope.add(df, __size=F.count(F.lit(1)))
    steps = cut_lineage(group_steps(sized, value, groups, key, trees, sample), "steps")
    largest = scope.max_group_rows or largest_group(df, groups)
    line = F.struct(*[F.col(c) for c in df.columns])
    rows = sized.select(
        *groups, F.col(value).alias("__x"), F.lit(1).alias("__kind"), F.lit(0.0).alias("__change"),
        F.col("__size"), line.alias("__line"), F.xxhash64(*df.columns).alias("__tie"),
    )
    edges = steps.select(
        *groups, F.col("edge").alias("__x"), F.lit(0).alias("__kind"), F.col("change").alias("__change"),
        F.lit(None).cast("long").alias("__size"),
        F.lit(None).cast(rows.schema["__line"].dataType).alias("__line"),
        F.xxhash64("edge", "change").alias("__tie"),
    )
    summed = running_sum(
        rows.unionByName(edges),
        "__change",
        "__depth",
        order_by=["__x", "__kind", "__tie"],
        partition_by=groups,
        max_group_rows=largest + trees * sample,
    ).filter(F.col("__kind") == 1)
    n = F.least(F.col("__size"), F.lit(sample)).cast("double")
    norm = (
        F.when(n <= 1, F.lit(None))
        .when(n == 2, F.lit(1.0))
        .otherwise(2 * (F.ln(n - 1) + F.lit(float(np.euler_gamma))) - 2 * (n - 1) / n)
    )
    score = F.pow(F.lit(2.0), -(F.col("__depth") / trees) / norm)
    scored = summed.select(*[F.col("__line")[c].alias(c) for c in df.columns], score.alias("__score"))
    return cut_lineage(scored, "scores")


def isolation_scores(df: DataFrame, value: str, threshold: float, scope, trees: int = TREES, sample: int = SAMPLE):
    """Rows with their score, and the flag and score columns. trees and sample: how many trees, of how many rows.

    The share of anomalies asked for is threshold / 10, between 1 % and 50 %.
    """
    contamination = min(max(threshold / 10, 0.01), 0.5)
    if scope.group_by:
        rows = grouped_scores(df, value, scope, trees, sample)
        rows = scope.add_quantiles(rows, {"__cut": ("__score", 1.0 - contamination)})
        return rows, F.col("__score") > F.col("__cut"), F.col("__score")
    size = df.count()
    edges, depths = forest_steps(df, value, scope.order_by, size, trees, sample)
    norm = _mean_depth(min(sample, max(size, 2)))

    @F.pandas_udf("double")
    def score(values: pd.Series) -> pd.Series:
        at = np.searchsorted(edges, values.to_numpy(dtype=float), side="right") - 1
        return pd.Series(np.exp2(-depths[at] / norm))

    rows = cut_lineage(df.withColumn("__score", score(F.col(value))), "scores")  # the cut and the result read it again
    cut = quantiles(rows, {"cut": ("__score", 1.0 - contamination)}).scalar()
    rows = rows.withColumn("__cut", cut)
    return rows, F.col("__score") > F.col("__cut"), F.col("__score")
