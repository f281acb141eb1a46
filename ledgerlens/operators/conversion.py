"""Type conversion and standardisation of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ledgerlens.functions.numeric import percent, require_columns, string_columns
from ledgerlens.functions.text import (
    clean_email, digits_only, parse_currency, parse_date, simple_name, standard_name,
)

TYPES = ("int", "float", "str", "datetime", "bool", "category")


def converted(df: DataFrame, column: str, to: str) -> Column:
    """The column as the wanted type; what does not convert becomes null."""
    c = F.col(column)
    text = isinstance(df.schema[column].dataType, T.StringType)
    if to == "int":
        if not text:
            return c.try_cast("long")
        # Digits stay exact; 1e3 and 4.0 are whole too, a fraction does not convert.
        number = F.trim(c).try_cast("double")
        whole = (number == F.floor(number)) & (F.abs(number) < float(1 << 53))
        return F.coalesce(F.trim(c).try_cast("long"), F.when(whole, number.try_cast("long")))
    if to == "float":
        return F.trim(c).try_cast("double") if text else c.try_cast("double")
    if to in ("str", "category"):
        return c.cast("string")
    if to == "datetime":
        return parse_date(F.trim(c)) if text else c.try_cast("timestamp")
    if to == "bool":
        return F.trim(c).try_cast("boolean") if text else c.try_cast("boolean")
    raise ValueError(f"type {to!r} is not one of {TYPES}")


def convert_types(df: DataFrame, mapping: dict[str, str], errors: str = "coerce") -> DataFrame:
    """Convert columns by name. ``errors='raise'`` fails on the first value that does not convert."""
    require_columns(df, *mapping)
    new = {}
    for column, to in mapping.items():
        value = converted(df, column, to)
        if errors == "raise":
            failed = F.col(column).isNotNull() & value.isNull()
            message = F.concat(F.lit(f"cannot convert {column} to {to}: "), F.col(column).cast("string"))
            value = F.when(failed, F.raise_error(message).cast(_spark_type(to))).otherwise(value)
        new[column] = value
    return df.withColumns(new)


def _spark_type(to: str) -> str:
    return {"int": "long", "float": "double", "datetime": "timestamp", "bool": "boolean"}.get(to, "string")


def conversion_report(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Per column: values converted, values lost, success rate. One pass, one row per column."""
    require_columns(df, *mapping)
    cells = []
    for column, to in mapping.items():
        value = converted(df, column, to)
        cells.append(
            F.struct(
                F.lit(column).alias("column_name"),
                F.lit(to).alias("target_type"),
                F.count(value).alias("converted"),
                F.count_if(F.col(column).isNotNull() & value.isNull()).alias("failed"),
            )
        )
    long = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    total = F.col("converted") + F.col("failed")
    return long.withColumn("success_rate", percent(F.col("converted"), total, 100.0))


def detect_types(df: DataFrame, share: float = 0.9) -> dict[str, str]:
    """Text columns of which more than ``share`` of the rows read as numbers, else as dates.

    One pass over all text columns; only the shares come to the driver.
    """
    columns = string_columns(df)
    if not columns:
        return {}
    measures = []
    for i, c in enumerate(columns):
        measures += [
            F.avg(converted(df, c, "float").isNotNull().cast("int")).alias(f"n{i}"),
            F.avg(converted(df, c, "datetime").isNotNull().cast("int")).alias(f"d{i}"),
        ]
    row = df.agg(*measures).first()
    found = {}
    for i, c in enumerate(columns):
        if (row[f"n{i}"] or 0) > share:
            found[c] = "float"
        elif (row[f"d{i}"] or 0) > share:
            found[c] = "datetime"
    return found


def auto_convert(df: DataFrame, share: float = 0.9) -> DataFrame:
    return convert_types(df, detect_types(df, share))


def standard_names(df: DataFrame, case_sensitive: bool = False) -> DataFrame:
    names = [standard_name(c, case_sensitive) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"column names collide after renaming: {names}")
    return df.toDF(*names)


def map_names(df: DataFrame, mapping: dict[str, str], case_sensitive: bool = False) -> DataFrame:
    """Rename columns; targets are lower case with underscores."""
    lookup = mapping if case_sensitive else {k.lower(): v for k, v in mapping.items()}
    renamed = {}
    for c in df.columns:
        target = lookup.get(c if case_sensitive else c.lower())
        if target is not None:
            renamed[c] = simple_name(target)
    return df.withColumnsRenamed(renamed)


def expected_columns(df: DataFrame, expected: Sequence[str], strict: bool = False) -> DataFrame:
    """Missing and extra columns against a list, the share found, and the rows concerned."""
    missing = sorted(set(expected) - set(df.columns))
    extra = sorted(set(df.columns) - set(expected))
    if strict and missing:
        raise ValueError(f"missing columns: {missing}")
    share = 100.0 * (len(set(expected)) - len(missing)) / max(len(set(expected)), 1)
    return df.agg(
        F.lit(",".join(missing)).alias("missing"),
        F.lit(",".join(extra)).alias("extra"),
        F.lit(share).alias("match_percentage"),
        F.count(F.lit(1)).alias("row_count"),
    )


def map_values(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    """Replace values by a mapping; others stay. A mapping of many entries becomes a table and a join."""
    if len(mapping) > 200:
        pairs = df.sparkSession.createDataFrame(list(mapping.items()), ["__from", "__to"])
        return map_values_table(df, column, pairs)
    entries = [x for pair in mapping.items() for x in (F.lit(pair[0]), F.lit(pair[1]))]
    known = F.create_map(*entries)
    return df.withColumn(column, F.coalesce(F.try_element_at(known, F.col(column)), F.col(column)))


def map_values_table(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """Replace values by a two-column table (from, to) with unique sources.

    A plain equi-join: Spark broadcasts the table if its bytes allow it, and splits a hot value otherwise.
    """
    source, target = pairs.columns
    joined = df.join(pairs, df[column] == pairs[source], "left")
    return joined.withColumn(column, F.coalesce(F.col(target), F.col(column))).select(*df.columns)


def _standardizers(
    date_columns=(), date_format=None, currency_columns=(), currency_symbol="$",
    phone_columns=(), email_columns=(),
) -> dict[str, tuple[Column, Column]]:
    """Per column the new value and whether the old one could not be read."""
    out = {}
    for c in date_columns:
        parsed = parse_date(F.col(c))
        value = F.date_format(parsed, date_format) if date_format else parsed
        out[c] = (value, F.col(c).isNotNull() & parsed.isNull())
    for c in currency_columns:
        value = parse_currency(F.col(c).cast("string"), currency_symbol)
        out[c] = (value, F.col(c).isNotNull() & value.isNull())
    for c in phone_columns:
        out[c] = (digits_only(F.col(c).cast("string")), F.lit(False))
    for c in email_columns:
        out[c] = (clean_email(F.col(c)), ~F.contains(clean_email(F.col(c)), F.lit("@")))
    return out


def standardize(
    df: DataFrame,
    column_mapping: dict[str, str] | None = None,
    expected: Sequence[str] | None = None,
    date_columns: Sequence[str] = (),
    date_format: str | None = None,
    currency_columns: Sequence[str] = (),
    currency_symbol: str = "$",
    phone_columns: Sequence[str] = (),
    email_columns: Sequence[str] = (),
    categorical_mappings: dict[str, dict] | None = None,
    case_sensitive: bool = False,
    strict: bool = False,
    auto_detect_types: bool = False,
) -> DataFrame:
    """Names, expected columns, dates, amounts, phones, emails, categories, types - in that order."""
    df = standard_names(df, case_sensitive)
    if column_mapping:
        df = map_names(df, column_mapping, case_sensitive)
    if expected and strict:
        require_columns(df, *expected)
    made = _standardizers(
        date_columns, date_format, currency_columns, currency_symbol, phone_columns, email_columns
    )
    require_columns(df, *made)
    df = df.withColumns({c: value for c, (value, _) in made.items()})
    for column, mapping in (categorical_mappings or {}).items():
        df = map_values(df, column, mapping)
    return auto_convert(df) if auto_detect_types else df


def standardize_report(df: DataFrame, **roles) -> DataFrame:
    """Per standardised column: values present, values that could not be read, success rate."""
    made = _standardizers(**roles)
    require_columns(df, *made)
    cells = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.count(F.col(c)).alias("present"),
            F.count_if(F.coalesce(failed, F.lit(False))).alias("failed"),
        )
        for c, (_, failed) in made.items()
    ]
    long = df.agg(F.array(*cells).alias("c")).select(F.inline("c"))
    good = F.col("present") - F.col("failed")
    return long.withColumn("success_rate", percent(good, F.col("present"), 100.0))
