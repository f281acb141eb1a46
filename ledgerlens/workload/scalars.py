"""The scalar functions, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import numeric, periods, text
from ledgerlens.functions.jsonmatch import contains
from ledgerlens.operators import conversion as V
from ledgerlens.workload.quality import TEXTS, texts
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import table


@query(
    "scalar_cast",
    "WITH" + TEXTS + """
SELECT id, TRY_CAST(trim(buyer) AS DOUBLE) AS number, TRY_CAST(trim(buyer) AS BIGINT) AS whole,
       CAST(id AS VARCHAR) AS name FROM texts""",
)
def scalar_cast(spark, d):
    rows = texts(spark, d)
    return rows.select(
        "id",
        numeric.as_number(rows, "buyer").alias("number"),
        V.converted(rows, "buyer", "int").alias("whole"),
        V.converted(rows, "id", "str").alias("name"),
    )


@query(
    "scalar_string",
    r"""
SELECT doc_id, regexp_replace(regexp_replace(text, '^[ \t\n\r\f\v]+', ''), '[ \t\n\r\f\v]+$', '') AS stripped,
       regexp_replace(text, '[^0-9]', '', 'g') AS digits, contains(text, '@') AS has_at, substring(text, 1, 20) AS label
FROM documents""",
)
def scalar_string(spark, d):
    c = F.col("text")
    return table(spark, d, "documents").select(
        "doc_id",
        text.strip(c).alias("stripped"),
        text.digits_only(c).alias("digits"),
        F.contains(c, F.lit("@")).alias("has_at"),
        F.substring(c, 1, 20).alias("label"),
    )


_ORDINALS = {
    "d": ("strftime(o_orderdate, '%Y-%m-%d')", "date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))"),
    "w": (
        "strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') || '/' || "
        "strftime(date_trunc('week', o_orderdate) + INTERVAL 6 DAY, '%Y-%m-%d')",
        "date_diff('week', DATE '1969-12-29', CAST(o_orderdate AS DATE))",
    ),
    "m": ("strftime(o_orderdate, '%Y-%m')", "year(o_orderdate) * 12 + month(o_orderdate) - 1"),
    "q": (
        "strftime(o_orderdate, '%Y') || 'Q' || CAST(quarter(o_orderdate) AS VARCHAR)",
        "year(o_orderdate) * 4 + quarter(o_orderdate) - 1",
    ),
    "y": ("strftime(o_orderdate, '%Y')", "year(o_orderdate)"),
}


@query(
    "scalar_date",
    "SELECT o_orderkey, "
    + ", ".join(f"{n} AS name_{p}, CAST({o} AS INTEGER) AS ordinal_{p}" for p, (n, o) in _ORDINALS.items())
    + ", isodow(o_orderdate) < 6 AS weekday FROM orders",
)
def scalar_date(spark, d):
    out = []
    for p in periods.PERIODS:
        start = periods.period_start(F.col("o_orderdate"), p)
        out += [
            periods.period_name(start, p).alias(f"name_{p.lower()}"),
            periods.period_ordinal(start, p).alias(f"ordinal_{p.lower()}"),
        ]
    return table(spark, d, "orders").select(
        "o_orderkey", *out, (F.weekday("o_orderdate") < 5).alias("weekday")
    )


@query(
    "scalar_math",
    """
SELECT l_orderkey, l_linenumber, l_partkey, round_even(l_extendedprice / 7, 2) AS rounded,
       abs(l_discount - l_tax) AS gap, least(l_discount, l_tax) AS low, greatest(l_discount, l_tax) AS high,
       CASE WHEN l_tax <> 0 THEN l_discount / l_tax ELSE 0 END AS share, CASE WHEN l_tax <> 0 THEN l_discount / l_tax END AS share_or_null
FROM lineitem""",
)
def scalar_math(spark, d):
    discount, tax = F.col("l_discount"), F.col("l_tax")
    return table(spark, d, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        numeric.rounded(F.col("l_extendedprice") / 7, 2).alias("rounded"),
        F.abs(discount - tax).alias("gap"),
        F.least(discount, tax).alias("low"),
        F.greatest(discount, tax).alias("high"),
        numeric.ratio(discount, tax, 0.0).alias("share"),
        numeric.ratio(discount, tax).alias("share_or_null"),
    )


@query(
    "scalar_map_json",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' WHEN 'click' THEN 'pressed' ELSE event_type END AS event_type,
       json_contains(props, '{"k": 7}') AS seven FROM events""",
)
def scalar_map_json(spark, d):
    rows = table(spark, d, "events").select("event_id", "event_type", contains(F.col("props"), {"k": 7}).alias("seven"))
    return V.map_values(rows, "event_type", {"view": "seen", "click": "pressed"})


@query("scalar_hash", "SELECT doc_id, sha256(text) AS sha256 FROM documents")
def scalar_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))
