"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.session import cut_lineage


def _least(pairs: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself."""
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of edges a, b.

    Every step joins on one node, so a node with very many neighbours is split by the skew join. The edges are
    written between rounds; their number never grows, and a round about halves the depth of the trees.
    Nulls and edges from a node to itself are left out.
    """
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "graph")
    before = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if mark["n"] == 0 or mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select("v", "v")).distinct()
        before = mark
        # Large star: each larger neighbour of a node points to the smallest node around it.
        both = now.union(now.select("v", "u"))
        large = both.where("v > u").join(_least(both), F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(large.where("u <> v").distinct(), "graph")
        # Small star: a node and its smaller neighbours point to the smallest of them.
        small = large.join(_least(large), F.col("u") == F.col("x"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.u", "e.v").where("u <> v").distinct(), "graph")
