"""Duplicates, profiles, validation, conversion and standardisation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import conversion as V, dedup as D, quality as Q
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import table

KEY = ["l_orderkey", "l_linenumber"]
ORDER = ["l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey"]
REST = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


def items(spark, d):
    return table(spark, d, "lineitem")


def ranked(direction: str = "") -> str:
    order = ", ".join(f"{c} {direction}" for c in ORDER + REST)
    return f"""
WITH r AS (
  SELECT *, row_number() OVER w AS r, COUNT(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linenumber ORDER BY {order})
)"""


@query("dedup_first", ranked() + " SELECT * EXCLUDE (r, n) FROM r WHERE r = 1")
def dedup_first(spark, d):
    return D.drop_duplicates(items(spark, d), KEY, "first", ORDER)


@query("dedup_last", ranked("DESC") + " SELECT * EXCLUDE (r, n) FROM r WHERE r = 1")
def dedup_last(spark, d):
    return D.drop_duplicates(items(spark, d), KEY, "last", ORDER)


@query("dedup_none", ranked() + " SELECT * EXCLUDE (r, n) FROM r WHERE n = 1")
def dedup_none(spark, d):
    return D.drop_duplicates(items(spark, d), KEY, False, ORDER)


@query(
    "dedup_all_columns",
    "SELECT DISTINCT user_id, event_type FROM events",
)
def dedup_all_columns(spark, d):
    return D.drop_duplicates(table(spark, d, "events").select("user_id", "event_type"))


@query("dedup_mark", ranked() + " SELECT * EXCLUDE (r, n), r > 1 AS _is_duplicate FROM r")
def dedup_mark(spark, d):
    return D.mark_duplicates(items(spark, d), KEY, "first", ORDER)


@query("dedup_mark_all", ranked() + " SELECT * EXCLUDE (r, n), n > 1 AS _is_duplicate FROM r")
def dedup_mark_all(spark, d):
    return D.mark_duplicates(items(spark, d), KEY, False)


@query(
    "dedup_priority",
    """
WITH r AS (
  SELECT l_orderkey, l_partkey, l_quantity, l_extendedprice, l_shipdate, row_number() OVER (
    PARTITION BY l_orderkey
    ORDER BY l_quantity DESC, l_shipdate, l_extendedprice, l_partkey) AS r FROM lineitem
)
SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
)
def dedup_priority(spark, d):
    """Per order the line with the largest quantity."""
    rows = items(spark, d).select("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return D.drop_by_priority(
        rows, ["l_orderkey"], "l_quantity", "max", ["l_shipdate", "l_extendedprice", "l_partkey"]
    )


@query(
    "dedup_priority_min",
    """
WITH t AS (SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS value FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, ts, event_id) AS r FROM t)
SELECT * EXCLUDE (r) FROM r WHERE r = 1""",
)
def dedup_priority_min(spark, d):
    rows = table(spark, d, "events").select(
        "event_id", "user_id", "ts", F.when(F.col("event_type") != "error", F.col("value")).alias("value")
    )
    return D.drop_by_priority(rows, ["user_id"], "value", "min", ["ts", "event_id"])


@query("dup_find", ranked() + " SELECT * EXCLUDE (r, n), n AS group_rows FROM r WHERE n > 1")
def dup_find(spark, d):
    return D.find_duplicates(items(spark, d), KEY, with_group=True)


@query("dup_find_later", ranked() + " SELECT * EXCLUDE (r, n) FROM r WHERE r > 1")
def dup_find_later(spark, d):
    return D.find_duplicates(items(spark, d), KEY, "first", ORDER)


@query(
    "dup_groups",
    """
SELECT l_orderkey, l_linenumber, COUNT(*) AS group_rows, MIN(l_shipdate) AS first_l_shipdate,
       MAX(l_shipdate) AS last_l_shipdate
FROM lineitem GROUP BY 1, 2 HAVING COUNT(*) > 1""",
)
def dup_groups(spark, d):
    return D.duplicate_groups(items(spark, d), KEY, ["l_shipdate"])


@query(
    "dup_report",
    """
WITH g AS (SELECT COUNT(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber)
SELECT CAST(SUM(n) AS BIGINT) AS rows_before, CAST(SUM(n) FILTER (WHERE n > 1) AS BIGINT) AS duplicates_found,
       COUNT(*) FILTER (WHERE n > 1) AS duplicate_groups,
       CAST(SUM(n) - COUNT(*) AS BIGINT) AS duplicates_removed, COUNT(*) AS rows_after,
       CAST(COUNT(*) AS DOUBLE) / CAST(SUM(n) AS DOUBLE) * 100.0 AS retention_rate FROM g""",
)
def dup_report(spark, d):
    return D.duplicate_report(items(spark, d), KEY)


ORDER_TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double",
    "o_orderdate": "timestamp_ntz", "o_orderpriority": "string",
}


def profile_sql(columns: dict[str, str], source: str, key: str | None) -> str:
    parts = []
    for c, kind in columns.items():
        sample = (
            f", (SELECT string_agg(CAST({c} AS VARCHAR), ', ' ORDER BY {key}) FROM"
            f" (SELECT * FROM {source} ORDER BY {key} LIMIT 3)) AS sample_values"
            if key else ""
        )
        parts.append(f"""
SELECT '{c}' AS column_name, '{kind}' AS data_type, COUNT(*) AS row_count, COUNT(*) - COUNT({c}) AS null_count,
       CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) * 100.0 AS null_percentage,
       COUNT(DISTINCT {c}) AS distinct_count{sample} FROM {source}""")
    return " UNION ALL ".join(parts)


@query("profile", profile_sql(ORDER_TYPES, "orders", "o_orderkey"))
def profile(spark, d):
    return Q.profile(table(spark, d, "orders"), ["o_orderkey"])


PART_EVENTS = """
(SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS value, 1 AS version,
        CAST(NULL AS VARCHAR) AS note FROM events)"""


def part_events(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        F.when(F.col("event_type") == "purchase", F.col("value")).alias("value"),
        F.lit(1).alias("version"),
        F.lit(None).cast("string").alias("note"),
    )


@query(
    "profile_with_nulls",
    profile_sql({"event_id": "bigint", "value": "double", "version": "int", "note": "string"}, PART_EVENTS, None),
)
def profile_with_nulls(spark, d):
    return Q.profile(part_events(spark, d))


@query("profile_approximate")
def profile_approximate(spark, d):
    return Q.profile(items(spark, d), exact=False)


@query(
    "validate_load",
    f"""
WITH p AS ({profile_sql({"event_id": "", "value": "", "version": "", "note": ""}, PART_EVENTS, None)})
SELECT 'all_null' AS "check", column_name, 'warning' AS severity, 'no values' AS detail
FROM p WHERE null_count = row_count
UNION ALL SELECT 'many_nulls', column_name, 'warning', CAST(ROUND(null_percentage, 1) AS VARCHAR) || '% nulls'
FROM p WHERE null_percentage > 50 AND null_count < row_count
UNION ALL SELECT 'single_value', column_name, 'warning', 'one distinct value' FROM p WHERE distinct_count = 1
UNION ALL SELECT 'duplicate_name', 'id', 'warning', 'name occurs more than once'""",
)
def validate_load(spark, d):
    return Q.load_issues(part_events(spark, d), ["id", "value", "id", "note"])


@query(
    "validate_upload",
    f"""
SELECT COUNT(*) AS row_count, 4 AS column_count, COUNT(*) - COUNT(value) + COUNT(*) AS null_count,
       CAST(COUNT(*) - COUNT(value) + COUNT(*) AS DOUBLE) / CAST(COUNT(*) * 4 AS DOUBLE) * 100.0 AS null_percentage,
       CAST(0 AS BIGINT) AS empty_rows, 'note' AS all_null_columns, 'bigint: 1, double: 1, int: 1, string: 1' AS types,
       '' AS errors, 'columns without values' AS warnings, true AS is_valid
FROM {PART_EVENTS}""",
)
def validate_upload(spark, d):
    return Q.upload_report(part_events(spark, d))


DATASETS = """
datasets AS (
  SELECT o_orderkey AS id, o_custkey AS data_source_id, 'set_' || CAST(o_custkey AS VARCHAR) AS name,
         1 AS version, o_orderstatus = 'F' AS is_deleted,
         CASE o_orderstatus WHEN 'O' THEN 'completed' WHEN 'F' THEN 'archived' ELSE 'paused' END AS status,
         CAST(o_totalprice / 4000 AS DECIMAL(7,2)) AS data_quality_score,
         CAST(o_totalprice - 5000 AS BIGINT) AS row_count FROM orders
)"""


def datasets(spark, d):
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("data_source_id"),
        F.concat(F.lit("set_"), F.col("o_custkey").cast("string")).alias("name"),
        F.lit(1).alias("version"),
        (status == "F").alias("is_deleted"),
        F.when(status == "O", "completed").when(status == "F", "archived").otherwise("paused").alias("status"),
        (F.col("o_totalprice") / 4000).cast("decimal(7,2)").alias("data_quality_score"),
        (F.col("o_totalprice") - 5000).alias("price"),
        *[
            F.lit(None).cast("bigint").alias(c)
            for c in ("processing_duration_seconds", "column_count", "records_processed", "records_failed", "records_skipped")
        ],
    ).withColumn("row_count", F.rint("price").cast("bigint")).drop("price")


@query(
    "constraint_counts",
    "WITH" + DATASETS + """
SELECT 'name_not_null' AS rule, COUNT(*) FILTER (WHERE name IS NULL) AS violations FROM datasets
UNION ALL SELECT 'valid_status', COUNT(*) FILTER (WHERE status NOT IN
  ('pending', 'validating', 'processing', 'completed', 'failed', 'archived')) FROM datasets
UNION ALL SELECT 'valid_quality_score', COUNT(*) FILTER (WHERE data_quality_score NOT BETWEEN 0 AND 100) FROM datasets
UNION ALL SELECT 'valid_duration', 0 FROM (SELECT 1)
UNION ALL SELECT 'valid_counts', COUNT(*) FILTER (WHERE row_count < 0) FROM datasets""",
)
def constraint_counts(spark, d):
    return Q.rule_counts(datasets(spark, d), Q.dataset_rules())


@query(
    "constraint_violations",
    "WITH" + DATASETS + """
SELECT rule, '{"id":' || CAST(id AS VARCHAR) || '}' AS row_key FROM (
  SELECT 'valid_status' AS rule, id FROM datasets WHERE status = 'paused'
  UNION ALL SELECT 'valid_quality_score', id FROM datasets WHERE data_quality_score NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'valid_counts', id FROM datasets WHERE row_count < 0)""",
)
def constraint_violations(spark, d):
    return Q.rule_violations(datasets(spark, d), Q.dataset_rules(), ["id"])


@query(
    "constraint_unique",
    "WITH" + DATASETS + """
SELECT 'unique_dataset_name_version' AS rule, name, version, is_deleted, COUNT(*) AS rows
FROM datasets GROUP BY name, version, is_deleted HAVING COUNT(*) > 1""",
)
def constraint_unique(spark, d):
    return Q.unique_violations(
        datasets(spark, d), ["name", "version", "is_deleted"], "unique_dataset_name_version"
    )


LABELLED = "SELECT doc_id FROM labels WHERE doc_id IS NOT NULL"


def texts_of(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")


@query("foreign_key_orphans", f"SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id NOT IN ({LABELLED})")
def foreign_key_orphans(spark, d):
    """Documents without a label."""
    return Q.orphans(texts_of(spark, d), "doc_id", table(spark, d, "labels"), "doc_id")


@query("foreign_key_valid", f"SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id IN ({LABELLED})")
def foreign_key_valid(spark, d):
    """Documents with a label."""
    return Q.valid_references(texts_of(spark, d), "doc_id", table(spark, d, "labels"), "doc_id")


# Text columns as exports write them, built alike on both sides.
TEXTS = """
texts AS (
  SELECT o_orderkey AS id, o_orderstatus AS status,
         CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE '$' || format('{:,.2f}', o_totalprice) END AS amount,
         CASE o_orderstatus WHEN 'O' THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN 'F' THEN strftime(o_orderdate, '%m/%d/%Y') ELSE 'someday' END AS day,
         CASE WHEN o_orderpriority = '5-LOW' THEN 'n/a' ELSE '  ' || CAST(o_custkey AS VARCHAR) || ' ' END AS buyer,
         CASE o_orderstatus WHEN 'O' THEN 'true' WHEN 'F' THEN 'no' ELSE 'maybe' END AS flag,
         '+1 (' || CAST(o_custkey AS VARCHAR) || ') 555-' || CAST(o_orderkey AS VARCHAR) AS phone,
         CASE WHEN o_orderstatus = 'F' THEN 'No Mail' ELSE '  User' || CAST(o_custkey AS VARCHAR) || '@Shop.COM ' END AS email
  FROM orders
)"""


def texts(spark, d):
    status, cust = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        status.alias("status"),
        F.when(status == "P", "unknown")
        .otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2)))
        .alias("amount"),
        F.when(status == "O", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(status == "F", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise("someday")
        .alias("day"),
        F.when(F.col("o_orderpriority") == "5-LOW", "n/a")
        .otherwise(F.concat(F.lit("  "), cust, F.lit(" ")))
        .alias("buyer"),
        F.when(status == "O", "true").when(status == "F", "no").otherwise("maybe").alias("flag"),
        F.concat(F.lit("+1 ("), cust, F.lit(") 555-"), F.col("o_orderkey").cast("string")).alias("phone"),
        F.when(status == "F", "No Mail")
        .otherwise(F.concat(F.lit("  User"), cust, F.lit("@Shop.COM ")))
        .alias("email"),
    )


DAY = """CASE status WHEN 'O' THEN CAST(strptime(day, '%Y-%m-%d') AS TIMESTAMP)
     WHEN 'F' THEN CAST(strptime(day, '%m/%d/%Y') AS TIMESTAMP) END"""
CONVERSIONS = {"buyer": "int", "day": "datetime", "flag": "bool", "id": "str"}


@query(
    "convert_types",
    "WITH" + TEXTS + f"""
SELECT CAST(id AS VARCHAR) AS id, TRY_CAST(trim(buyer) AS BIGINT) AS buyer, {DAY} AS day,
       CASE flag WHEN 'true' THEN true WHEN 'no' THEN false END AS flag FROM texts""",
)
def convert_types(spark, d):
    rows = texts(spark, d).select("id", "buyer", "day", "flag")
    out = V.convert_types(rows, CONVERSIONS)
    return out.withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "convert_types_report",
    "WITH" + TEXTS + """
, c AS (
  SELECT 'buyer' AS column_name, 'int' AS target_type, COUNT(*) FILTER (WHERE buyer <> 'n/a') AS converted, COUNT(*) AS n FROM texts
  UNION ALL SELECT 'day', 'datetime', COUNT(*) FILTER (WHERE day <> 'someday'), COUNT(*) FROM texts
  UNION ALL SELECT 'flag', 'bool', COUNT(*) FILTER (WHERE flag <> 'maybe'), COUNT(*) FROM texts
  UNION ALL SELECT 'id', 'str', COUNT(id), COUNT(*) FROM texts
)
SELECT column_name, target_type, converted, n - converted AS failed,
       CAST(converted AS DOUBLE) / n * 100.0 AS success_rate FROM c""",
)
def convert_types_report(spark, d):
    return V.conversion_report(texts(spark, d), CONVERSIONS)


@query(
    "auto_types",
    """
SELECT CAST(o_custkey AS DOUBLE) AS number, o_orderdate AS day, 'x' || o_orderstatus AS label,
       CASE WHEN o_orderstatus = 'P' THEN 'n/a' ELSE CAST(o_custkey AS VARCHAR) END AS mixed FROM orders""",
)
def auto_types(spark, d):
    """Numbers and dates as text are recognised; a third of unreadable values keeps text."""
    status, cust = F.col("o_orderstatus"), F.col("o_custkey").cast("string")
    rows = table(spark, d, "orders").select(
        F.concat(cust, F.lit(" ")).alias("number"),
        F.date_format("o_orderdate", "yyyy/MM/dd").alias("day"),
        F.concat(F.lit("x"), status).alias("label"),
        F.when(status == "P", "n/a").otherwise(cust).alias("mixed"),
    )
    return V.auto_convert(rows).withColumn("day", F.col("day").cast("timestamp_ntz"))


@query(
    "std_date_currency",
    "WITH" + TEXTS + f"""
SELECT id, strftime({DAY}, '%d.%m.%Y') AS day,
       TRY_CAST(replace(replace(amount, '$', ''), ',', '') AS DOUBLE) AS amount FROM texts""",
)
def std_date_currency(spark, d):
    rows = texts(spark, d).select("id", "day", "amount")
    return V.standardize(rows, date_columns=["day"], date_format="dd.MM.yyyy", currency_columns=["amount"])


@query(
    "std_phone_email_category",
    "WITH" + TEXTS + """
SELECT id, regexp_replace(phone, '[^0-9]', '', 'g') AS phone, lower(trim(email)) AS email,
       CASE status WHEN 'O' THEN 'open' WHEN 'F' THEN 'final' ELSE status END AS state FROM texts""",
)
def std_phone_email_category(spark, d):
    rows = texts(spark, d).select(
        F.col("id").alias("  ID "), F.col("phone").alias("Phone"), F.col("email").alias("E-Mail"),
        F.col("status").alias("Order  Status"),
    )
    return V.standardize(
        rows,
        column_mapping={"EMAIL": "Email", "order_status": "State"},
        expected=["id", "phone", "email", "state"],
        phone_columns=["phone"],
        email_columns=["email"],
        categorical_mappings={"state": {"O": "open", "F": "final"}},
        strict=True,
    )


@query(
    "std_report",
    "WITH" + TEXTS + """
, c AS (
  SELECT 'day' AS column_name, COUNT(day) AS present, COUNT(*) FILTER (WHERE day = 'someday') AS failed FROM texts
  UNION ALL SELECT 'amount', COUNT(amount), COUNT(*) FILTER (WHERE amount = 'unknown') FROM texts
  UNION ALL SELECT 'phone', COUNT(phone), 0 FROM texts
  UNION ALL SELECT 'email', COUNT(email), COUNT(*) FILTER (WHERE email NOT LIKE '%@%') FROM texts
)
SELECT *, CAST(present - failed AS DOUBLE) / present * 100.0 AS success_rate FROM c""",
)
def std_report(spark, d):
    return V.standardize_report(
        texts(spark, d), date_columns=["day"], currency_columns=["amount"],
        phone_columns=["phone"], email_columns=["email"],
    )


@query(
    "std_expected_columns",
    "SELECT 'region' AS missing, 'o_orderpriority,o_orderstatus,o_totalprice' AS extra, 75.0::DOUBLE AS match_percentage,"
    " COUNT(*) AS row_count FROM orders",
)
def std_expected_columns(spark, d):
    return V.expected_columns(
        table(spark, d, "orders"), ["o_orderkey", "o_custkey", "o_orderdate", "region"]
    )
