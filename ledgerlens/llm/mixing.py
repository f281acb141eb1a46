"""Mix sources to target weights by systematic sampling.

Targets: sources share all words by weight; a target stops at `most` times its source's words and the
excess is shared again by weight until none is above. Sampling: every document expects target / source
words copies; the copies are prefix-summed within the source in order of size, one random offset is added,
and a document is emitted once for each integer the sum crosses. In order of size neighbours stand for each
other, so a source's words come near its target.

Prefix sums are exact whole numbers (units of 2^-32 copies) and are taken in slices: a source is cut by size
class and, within a class, by a hash of the id into as many slices as keep a slice near SLICE_ROWS rows. So a
hot source, or a third of all rows of one size, is summed by many tasks, and one small table of slice
totals carries the sums over. Everything is DataFrame functions; results do not depend on partitioning.

Defined cases: null text has size 0; null sources are one source, the last; sources without words take
no words and keep their documents once; an empty table gives an empty mix; rows that agree in source,
size and id are interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.rows import others, quoted
from ledgerlens.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
SLICE_ROWS = 1_000_000
UNIT = 1 << 32
SEED = "mix"


def size_of(text: Column) -> Column:
    """Number of words: runs of anything but blanks, tabs and line breaks."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def random_unit(*parts: Column) -> Column:
    """A whole number below 2^32 that depends on the parts alone."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from the sizes (source, size) of all documents.

    Works on one row per source. Sources whose target stops at `most` times their words are those with the
    fewest words for their weight; a running sum in that order finds the share of the rest at once.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("long")
    per = per.withColumn("weight", weight)
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_room.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    ) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    # level: what a unit of weight gets if all sources before this one are full. Full ones come first.
    per = per.withColumn("level", level).withColumn("full", most * F.col("source_size") < F.col("weight") * F.col("level"))
    share = F.max(F.when(~F.col("full"), F.col("level"))).over(everything)  # that of the first which is not full
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(F.col("weight") * share)
    return per.select("source", "source_size", target.alias("target"))


def systematic(
    rows: DataFrame, group: str, order: list[str], expected: str, slice_rows: int = SLICE_ROWS, seed: str = SEED
) -> DataFrame:
    """rows (with row columns of unique names) and `copies`: integer boundaries each row's sum crosses.

    expected holds whole units of 2^-32 copies. order names the columns that sort a group; the first one must be
    a non-negative whole number and is binned by its bit length, the second is hashed into slices.
    """
    n = F.greatest(F.lit(1), F.ceil(F.col("rows") / slice_rows)).cast("long")
    classed = rows.withColumn("bin", F.length(F.bin(order[0])))
    bins = classed.groupBy(group, "bin").agg(F.count("*").alias("rows")).select(F.col(group).alias("g"), F.col("bin").alias("b"), n.alias("slices"))
    classed = classed.join(bins, F.col(group).eqNullSafe(F.col("g")) & (F.col("bin") == F.col("b")))
    mark = random_unit(F.lit(seed), F.coalesce(F.col(order[1]).cast("string"), F.lit("")))
    sliced = classed.withColumn("slice", mark % F.col("slices")).drop("g", "b", "slices")
    totals = sliced.groupBy(group, "bin", "slice").agg(F.sum(F.col(expected).cast("decimal(38,0)")).alias("total"))
    before = Window.partitionBy(group).orderBy("bin", "slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = random_unit(F.lit(seed), F.coalesce(F.col(group), F.lit("")))
    start = (F.coalesce(F.sum("total").over(before), F.lit(0)) + offset) % F.lit(UNIT)
    starts = totals.select(F.col(group).alias("g"), F.col("bin").alias("b"), F.col("slice").alias("s"), start.cast("long").alias("start"))
    on = F.col(group).eqNullSafe(F.col("g")) & (F.col("bin") == F.col("b")) & (F.col("slice") == F.col("s"))
    placed = sliced.join(starts, on).drop("g", "b", "s")
    upto = Window.partitionBy(group, "bin", "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.col("start") + F.sum(expected).over(upto)
    copies = F.shiftright(total, 32) - F.shiftright(total - F.col(expected), 32)
    return placed.withColumn("copies", copies).drop("bin", "slice", "start")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST,
    slice_rows: int = SLICE_ROWS,
    carry: list[str] | None = None,
) -> DataFrame:
    """Columns of docs with size, source_size, target and taken_copies, one row per document.

    Names that clash with these give way. carry names the columns to keep, all by default.
    """
    new = ["size", "source_size", "target", "taken_copies"]
    kept = [c for c in others(docs, new) if carry is None or c in carry]
    names = [f"c{i}" for i in range(len(kept))]
    rows = docs.select(
        *(docs[quoted(c)].alias(n) for c, n in zip(kept, names, strict=True)),
        docs[quoted(source)].cast("string").alias("source"), docs[quoted(doc_id)].alias("id"), size_of(docs[quoted(text)]).alias("size"),
    )
    rows = cut_lineage(rows, "mix-sizes")  # texts are read and counted once
    goals = targets(rows.select("source", "size"), weights, most).withColumnRenamed("source", "g")
    rows = rows.join(goals, F.col("source").eqNullSafe(F.col("g"))).drop("g")
    expected = F.when(F.col("source_size") > 0, F.floor(F.col("target") * float(UNIT) / F.col("source_size")).cast("long")).otherwise(F.lit(UNIT))
    out = systematic(rows.withColumn("expected", expected), "source", ["size", "id"], "expected", slice_rows)
    return out.select(*names, "size", "source_size", "target", "copies").toDF(*kept, *new)


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **settings) -> DataFrame:
    """Rows of docs as often as the mix takes them.

    Rows are numbered in a written table; only ids, sources and sizes go through the sums, and texts move once.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    whole = cut_lineage(docs.toDF(*names).withColumn("row", F.monotonically_increasing_id()), "mix")
    at = {c: f"c{i}" for i, c in reversed(list(enumerate(docs.columns)))}
    slim = whole.select("row", at[doc_id], at[text], at[source])
    found = mix(slim, at[doc_id], at[text], at[source], carry=["row"], **settings).where("taken_copies > 0")
    times = F.explode(F.array_repeat(F.lit(1), F.col("taken_copies").cast("int")))
    return whole.join(found.select("row", "taken_copies"), "row").select(*names, times).select(*names).toDF(*docs.columns)
