"""Column profiles, load and upload validation, table constraints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.functions.numeric import percent, require_columns
from ledgerlens.plans.groups import ROWS, attach


def _as_text(df: DataFrame, column: str) -> Column:
    """Text that is equal exactly where the values are; zero has one sign."""
    c = F.col(f"`{column}`")
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        c = c + F.lit(0.0)
    if isinstance(df.schema[column].dataType, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        return F.to_json(c)
    return c.cast("string")


def value_counts(df: DataFrame) -> DataFrame:
    """(column_name, value, n) for every column.

    All columns are counted in one shuffle, and copies of a value meet before it.
    """
    cells = [
        F.struct(F.lit(c).alias("column_name"), _as_text(df, c).alias("value")) for c in df.columns
    ]
    long = df.select(F.inline(F.array(*cells)))
    return long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))


def samples(df: DataFrame, order_by: Sequence[str], n: int = 3) -> DataFrame:
    """Per column its values in the first n rows by the order."""
    first = df.orderBy(*order_by).limit(n)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.struct(*order_by).alias("at"),
            _as_text(df, c).alias("value"),
        )
        for c in df.columns
    ]
    long = first.select(F.inline(F.array(*cells)))
    # At most n values per column.
    listed = F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"])
    return long.groupBy("column_name").agg(F.concat_ws(", ", listed).alias("sample_values"))


def profile(
    df: DataFrame, order_by: Sequence[str] = (), exact: bool = True
) -> DataFrame:
    """Per column: type, rows, nulls, null percentage, distinct values, sample values.

    ``exact=False`` estimates the distinct values in one pass without a shuffle of values.
    """
    kinds = F.create_map(
        *[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())]
    )
    if exact:
        by = value_counts(df).groupBy("column_name").agg(
            F.sum("n").alias("row_count"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
            F.count("value").alias("distinct_count"),
        )
    else:
        cells = [
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count(F.lit(1)) - F.count(F.col(f"`{c}`"))).alias("null_count"),
                F.approx_count_distinct(F.col(f"`{c}`")).alias("distinct_count"),
            )
            for c in df.columns
        ]
        by = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    out = by.select(
        "column_name",
        F.element_at(kinds, F.col("column_name")).alias("data_type"),
        "row_count",
        "null_count",
        percent(F.col("null_count"), F.col("row_count"), 0.0).alias("null_percentage"),
        "distinct_count",
    )
    if order_by:
        out = out.join(F.broadcast(samples(df, order_by)), "column_name", "left")
    return out


_ISSUE = "check string, column_name string, severity string, detail string"


def _issues(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, _ISSUE)


def _extremes(df: DataFrame) -> DataFrame:
    """Per column: rows, nulls, and whether its least value is its largest. One pass without a shuffle of values."""
    cells = []
    for c, kind in ((f.name, f.dataType) for f in df.schema.fields):
        complex_ = isinstance(kind, (T.ArrayType, T.MapType, T.StructType, T.VariantType))
        cell = _as_text(df, c) if complex_ else F.col(f"`{c}`")
        cells.append(
            F.struct(
                F.lit(c).alias("column_name"),
                F.count(F.lit(1)).alias("row_count"),
                (F.count(F.lit(1)) - F.count(cell)).alias("null_count"),
                F.coalesce(F.min(cell) == F.max(cell), F.lit(False)).alias("one_value"),
            )
        )
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def load_issues(df: DataFrame, header: Sequence[str] | None = None) -> DataFrame:
    """Findings after a load: empty table, no columns, repeated names in the raw header,
    all-null, mostly-null and single-valued columns."""
    spark = df.sparkSession
    names = list(header or df.columns)
    repeated = sorted({n for n in names if names.count(n) > 1})
    fixed = [("duplicate_name", n, "warning", "name occurs more than once") for n in repeated]
    if not df.columns:
        return _issues(spark, [*fixed, ("no_columns", None, "critical", "table has no columns")])
    p = _extremes(df)
    rows, nulls = F.col("row_count"), F.col("null_count")
    share = percent(nulls, rows, 0.0)
    found = F.array_compact(
        F.array(
            F.when(
                (nulls == rows) & (rows > 0),
                F.struct(F.lit("all_null").alias("check"), F.lit("no values").alias("detail")),
            ),
            F.when(
                (share > 50) & (nulls < rows),
                F.struct(
                    F.lit("many_nulls").alias("check"),
                    F.concat(F.round(share, 1).cast("string"), F.lit("% nulls")).alias("detail"),
                ),
            ),
            F.when(
                F.col("one_value") & (rows > 1),
                F.struct(F.lit("single_value").alias("check"), F.lit("one distinct value").alias("detail")),
            ),
        )
    )
    per_column = p.select("column_name", F.explode(found).alias("f")).select(
        F.col("f.check").alias("check"),
        "column_name",
        F.lit("warning").alias("severity"),
        F.col("f.detail").alias("detail"),
    )
    empty = df.agg(F.count(F.lit(1)).alias("n")).filter("n = 0").select(
        F.lit("empty_table").alias("check"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit("critical").alias("severity"),
        F.lit("table has no rows").alias("detail"),
    )
    return per_column.unionByName(empty).unionByName(_issues(spark, fixed))


def upload_report(df: DataFrame, header: Sequence[str] | None = None) -> DataFrame:
    """One row: size, empty rows, null share, all-null columns, types, errors, warnings."""
    require_columns(df)
    names = list(header or df.columns)
    repeated = sorted({n for n in names if names.count(n) > 1})
    cols = [F.col(f"`{c}`") for c in df.columns]
    nulls = [F.when(c.isNull(), 1).otherwise(0) for c in cols]
    width = len(cols)
    in_row = sum(nulls[1:], nulls[0])
    one = df.agg(
        F.count(F.lit(1)).alias("row_count"),
        F.coalesce(F.sum(in_row), F.lit(0)).cast("long").alias("null_count"),
        F.count_if(in_row == width).alias("empty_rows"),
        F.array(*[F.struct(F.lit(c).alias("c"), F.count(F.col(f"`{c}`")).alias("n")) for c in df.columns]).alias("k"),
    )
    kinds: dict[str, int] = {}
    for f in df.schema.fields:
        kinds[f.dataType.simpleString()] = kinds.get(f.dataType.simpleString(), 0) + 1
    histogram = ", ".join(f"{k}: {n}" for k, n in sorted(kinds.items()))
    dead = F.transform(F.filter("k", lambda x: x["n"] == 0), lambda x: x["c"])
    share = percent(F.col("null_count"), F.col("row_count") * width, 0.0)
    errors = F.array_compact(
        F.array(
            F.when(F.col("row_count") == 0, F.lit("table is empty")),
            F.lit(f"repeated names: {', '.join(repeated)}") if repeated else F.lit(None).cast("string"),
        )
    )
    warnings = F.array_compact(
        F.array(
            F.when(F.size(dead) > 0, F.lit("columns without values")),
            F.when(share > 50, F.lit("more than half of the cells are null")),
            F.when(F.col("empty_rows") > 0, F.lit("empty rows")),
        )
    )
    return one.select(
        "row_count",
        F.lit(width).alias("column_count"),
        "null_count",
        share.alias("null_percentage"),
        "empty_rows",
        F.array_join(dead, ", ").alias("all_null_columns"),
        F.lit(histogram).alias("types"),
        F.array_join(errors, "; ").alias("errors"),
        F.array_join(warnings, "; ").alias("warnings"),
        (F.size(errors) == 0).alias("is_valid"),
    )


def rule_violations(
    df: DataFrame, rules: dict[str, Column], key: Sequence[str]
) -> DataFrame:
    """One row per rule and row that breaks it; a rule that is null counts as kept (SQL CHECK)."""
    broken = F.array_compact(
        F.array(*[F.when(F.coalesce(~rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()])
    )
    return df.select(
        F.explode(broken).alias("rule"), F.to_json(F.struct(*key)).alias("row_key")
    )


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Violations per rule, all rules in one pass."""
    cells = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(F.coalesce(~rule, F.lit(False))).alias("violations"),
        )
        for name, rule in rules.items()
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.inline("c"))


def unique_violations(df: DataFrame, columns: Sequence[str], rule: str = "unique") -> DataFrame:
    """Keys that occur more than once; rows with a null in the key are free (SQL UNIQUE)."""
    require_columns(df, *columns)
    whole = df.na.drop(subset=list(columns))
    by = whole.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
    return by.select(F.lit(rule).alias("rule"), *columns, "rows")


def orphans(df: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has no parent; a null key is free.

    Which keys lack a parent is found on the distinct keys, so a key that most rows share is
    one row there; the answer is then attached to the rows, hot keys by broadcast.
    """
    return _by_parent(df, foreign_key, parent, parent_key, "left_anti")


def valid_references(df: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose key has a parent."""
    return _by_parent(df, foreign_key, parent, parent_key, "left_semi")


def _by_parent(df: DataFrame, foreign_key: str, parent: DataFrame, parent_key: str, how: str) -> DataFrame:
    require_columns(df, foreign_key)
    require_columns(parent, parent_key)
    keys = df.filter(F.col(foreign_key).isNotNull()).groupBy(foreign_key).agg(F.count(F.lit(1)).alias(ROWS))
    wanted = keys.join(parent.select(F.col(parent_key).alias(foreign_key)), foreign_key, how)
    return attach(df, wanted, [foreign_key]).filter(F.col(ROWS).isNotNull()).select(*df.columns)


# The states and limits of the data catalogue's tables.
SOURCE_STATES = ("active", "inactive", "error", "testing")
DATASET_STATES = ("pending", "validating", "processing", "completed", "failed", "archived")


def source_rules() -> dict[str, Column]:
    return {
        "name_not_null": F.col("name").isNotNull(),
        "source_type_not_null": F.col("source_type").isNotNull(),
        "connection_config_not_null": F.col("connection_config").isNotNull(),
        "valid_status": F.col("status").isin(*SOURCE_STATES),
    }


def dataset_rules() -> dict[str, Column]:
    def at_least_zero(*names: str) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & (F.col(n).isNull() | (F.col(n) >= 0))
        return out

    score = F.col("data_quality_score")
    return {
        "name_not_null": F.col("name").isNotNull(),
        "valid_status": F.col("status").isin(*DATASET_STATES),
        "valid_quality_score": score.isNull() | score.between(0, 100),
        "valid_duration": at_least_zero("processing_duration_seconds"),
        "valid_counts": at_least_zero(
            "row_count", "column_count", "records_processed", "records_failed", "records_skipped"
        ),
    }
