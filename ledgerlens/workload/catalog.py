"""The seventeen catalogue queries, on orders in the shape of a source catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import catalog as C, quality as Q
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import table

AS_OF = "1999-06-30 12:00:00"


def sources(spark, d):
    """Orders as data sources: status, priority and date give state, type and times."""
    key, status, day = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderdate")
    priority, price, cust = F.col("o_orderpriority"), F.col("o_totalprice"), F.col("o_custkey")
    failed = status == "F"
    none = F.lit(None).cast("timestamp_ntz")
    return table(spark, d, "orders").select(
        key.alias("id"),
        F.concat(F.lit("source_"), key.cast("string")).alias("name"),
        F.concat(F.lit("orders of customer "), cust.cast("string")).alias("description"),
        priority.alias("source_type"),
        F.concat(F.lit('{"host": "h'), cust.cast("string"), F.lit('"}')).alias("connection_config"),
        F.lit("basic").alias("auth_type"),
        F.when(status == "O", "active").when(failed, "error").otherwise("inactive").alias("status"),
        (price > 40000).alias("is_enabled"),
        F.when(price > 20000, day).alias("last_connection_test"),
        F.when(failed, "failed").when(status == "O", "success").alias("last_connection_status"),
        F.when(failed, "timeout").alias("last_error_message"),
        F.lit("0 * * * *").alias("refresh_schedule"),
        F.when(price > 60000, day).alias("last_sync_time"),
        F.when(price > 80000, day + F.expr("interval 1 hour")).otherwise(none).alias("next_sync_time"),
        F.concat(F.lit('["orders", "'), priority, F.lit('", "'), status, F.lit('"]')).alias("tags"),
        F.concat(
            F.lit('{"owner": {"id": '), cust.cast("string"), F.lit(', "tier": "'),
            F.when(price > 400000, "gold").otherwise("base"), F.lit('"}, "status": "'), status, F.lit('"}'),
        ).alias("metadata"),
        F.lit("loader").alias("created_by"),
        F.lit(None).cast("string").alias("updated_by"),
        day.alias("created_at"),
        day.alias("updated_at"),
        none.alias("deleted_at"),
        (price < 10000).alias("is_deleted"),
    )


SOURCES = """
WITH data_sources AS (
  SELECT o_orderkey AS id, 'source_' || CAST(o_orderkey AS VARCHAR) AS name,
         'orders of customer ' || CAST(o_custkey AS VARCHAR) AS description, o_orderpriority AS source_type,
         '{"host": "h' || CAST(o_custkey AS VARCHAR) || '"}' AS connection_config, 'basic' AS auth_type,
         CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'error' ELSE 'inactive' END AS status,
         o_totalprice > 40000 AS is_enabled,
         CASE WHEN o_totalprice > 20000 THEN o_orderdate END AS last_connection_test,
         CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'success' END AS last_connection_status,
         CASE o_orderstatus WHEN 'F' THEN 'timeout' END AS last_error_message, '0 * * * *' AS refresh_schedule,
         CASE WHEN o_totalprice > 60000 THEN o_orderdate END AS last_sync_time,
         CASE WHEN o_totalprice > 80000 THEN o_orderdate + INTERVAL 1 HOUR END AS next_sync_time,
         '["orders", "' || o_orderpriority || '", "' || o_orderstatus || '"]' AS tags,
         '{"owner": {"id": ' || CAST(o_custkey AS VARCHAR) || ', "tier": "'
           || CASE WHEN o_totalprice > 400000 THEN 'gold' ELSE 'base' END || '"}, "status": "' || o_orderstatus || '"}' AS metadata,
         'loader' AS created_by, CAST(NULL AS VARCHAR) AS updated_by, o_orderdate AS created_at,
         o_orderdate AS updated_at, CAST(NULL AS TIMESTAMP) AS deleted_at, o_totalprice < 10000 AS is_deleted
  FROM orders
)
"""
NOW = f"TIMESTAMP '{AS_OF}'"


@query(
    "cat_q01_active",
    SOURCES + """
SELECT id, name, description, source_type, status, last_sync_time, next_sync_time, created_at, updated_at
FROM data_sources WHERE is_enabled AND status = 'active' AND NOT is_deleted ORDER BY name""",
)
def cat_q01(spark, d):
    return C.active_sources(sources(spark, d))


@query(
    "cat_q02_by_type",
    SOURCES + """
SELECT id, name, source_type, status, last_connection_status, last_connection_test, last_error_message, is_enabled
FROM data_sources WHERE source_type = '2-HIGH' AND NOT is_deleted ORDER BY last_connection_test DESC NULLS LAST""",
)
def cat_q02(spark, d):
    return C.sources_of_type(sources(spark, d), "2-HIGH")


@query(
    "cat_q03_due",
    SOURCES + f"""
SELECT id, name, source_type, last_sync_time, next_sync_time, refresh_schedule FROM data_sources
WHERE is_enabled AND status = 'active' AND NOT is_deleted
  AND (next_sync_time IS NULL OR next_sync_time <= {NOW})
ORDER BY COALESCE(next_sync_time, TIMESTAMP '1970-01-01')""",
)
def cat_q03(spark, d):
    return C.due_for_sync(sources(spark, d), AS_OF)


@query(
    "cat_q04_by_name",
    SOURCES + """
SELECT id, name, description, source_type, connection_config, auth_type, status, is_enabled, last_sync_time,
       next_sync_time, refresh_schedule, tags, metadata, created_at, updated_at
FROM data_sources WHERE name = 'source_17' AND NOT is_deleted""",
)
def cat_q04(spark, d):
    return C.source_by_name(sources(spark, d), "source_17")


@query(
    "cat_q05_tags",
    SOURCES + """
SELECT id, name, source_type, tags, status, created_at FROM data_sources
WHERE json_contains(tags, '["1-URGENT", "O"]') AND NOT is_deleted ORDER BY created_at DESC""",
)
def cat_q05(spark, d):
    return C.sources_with_tags(sources(spark, d), ["1-URGENT", "O"])


@query(
    "cat_q06_failed",
    SOURCES + """
SELECT id, name, source_type, status, last_connection_status, last_connection_test, last_error_message, last_sync_time
FROM data_sources WHERE last_connection_status = 'failed' AND is_enabled AND NOT is_deleted""",
)
def cat_q06(spark, d):
    return C.failed_connections(sources(spark, d))


@query(
    "cat_q07_type_statistics",
    SOURCES + """
SELECT source_type, COUNT(*) AS total_sources, COUNT(*) FILTER (WHERE status = 'active') AS active_count,
       COUNT(*) FILTER (WHERE status = 'inactive') AS inactive_count,
       COUNT(*) FILTER (WHERE status = 'error') AS error_count,
       COUNT(*) FILTER (WHERE is_enabled) AS enabled_count,
       COUNT(*) FILTER (WHERE last_connection_status = 'success') AS healthy_count,
       COUNT(*) FILTER (WHERE last_connection_status = 'failed') AS failed_count
FROM data_sources WHERE NOT is_deleted GROUP BY source_type""",
)
def cat_q07(spark, d):
    return C.type_statistics(sources(spark, d))


@query(
    "cat_q08_recent",
    SOURCES + """
SELECT id, name, source_type, status, created_at, created_by FROM data_sources
WHERE NOT is_deleted ORDER BY created_at DESC, id LIMIT 20""",
)
def cat_q08(spark, d):
    return C.recently_added(sources(spark, d), 20)


@query(
    "cat_q09_touch_sync",
    SOURCES + f"""
SELECT id, name, {NOW} AS last_sync_time, {NOW} + INTERVAL 1 HOUR AS next_sync_time
FROM data_sources WHERE id = 42 AND NOT is_deleted""",
)
def cat_q09(spark, d):
    match, changes = C.touch_sync(42, "ops", AS_OF)
    return C.returning(sources(spark, d), match, changes, ["id", "name", "last_sync_time", "next_sync_time"])


@query(
    "cat_q09_snapshot",
    SOURCES + f"""
SELECT id, CASE WHEN id = 42 AND NOT is_deleted THEN {NOW} ELSE last_sync_time END AS last_sync_time,
       CASE WHEN id = 42 AND NOT is_deleted THEN {NOW} + INTERVAL 1 HOUR ELSE next_sync_time END AS next_sync_time,
       CASE WHEN id = 42 AND NOT is_deleted THEN 'ops' ELSE updated_by END AS updated_by FROM data_sources""",
)
def cat_q09_snapshot(spark, d):
    match, changes = C.touch_sync(42, "ops", AS_OF)
    out = C.update(sources(spark, d), match, changes)
    return out.select("id", "last_sync_time", "next_sync_time", "updated_by")


@query(
    "cat_q10_connection_ok",
    SOURCES + """
SELECT id, name, CASE WHEN status = 'error' THEN 'active' ELSE status END AS status,
       'success' AS last_connection_status
FROM data_sources WHERE source_type = '1-URGENT' AND NOT is_deleted""",
)
def cat_q10_ok(spark, d):
    match, changes = C.connection_result(F.col("source_type") == "1-URGENT", "success", None, AS_OF)
    return C.returning(sources(spark, d), match, changes, ["id", "name", "status", "last_connection_status"])


@query(
    "cat_q10_connection_failed",
    SOURCES + f"""
SELECT id, status, last_connection_status, last_error_message, last_connection_test FROM (
  SELECT id, CASE WHEN hit THEN 'error' ELSE status END AS status,
         CASE WHEN hit THEN 'failed' ELSE last_connection_status END AS last_connection_status,
         CASE WHEN hit THEN 'refused' ELSE last_error_message END AS last_error_message,
         CASE WHEN hit THEN {NOW} ELSE last_connection_test END AS last_connection_test
  FROM (SELECT *, source_type = '3-MEDIUM' AND NOT is_deleted AS hit FROM data_sources))""",
)
def cat_q10_failed(spark, d):
    match, changes = C.connection_result(F.col("source_type") == "3-MEDIUM", "failed", "refused", AS_OF)
    out = C.update(sources(spark, d), match, changes)
    return out.select("id", "status", "last_connection_status", "last_error_message", "last_connection_test")


@query(
    "cat_q11_soft_delete",
    SOURCES + f"""
SELECT id, is_deleted OR id = 42 AS is_deleted,
       CASE WHEN id = 42 AND NOT is_deleted THEN {NOW} END AS deleted_at FROM data_sources""",
)
def cat_q11(spark, d):
    match, changes = C.soft_delete(42, "ops", AS_OF)
    return C.update(sources(spark, d), match, changes).select("id", "is_deleted", "deleted_at")


@query(
    "cat_q12_enable_type",
    SOURCES + "SELECT id, name, false AS is_enabled FROM data_sources WHERE source_type = '5-LOW' AND NOT is_deleted",
)
def cat_q12(spark, d):
    match, changes = C.enable_type("5-LOW", False, "ops", AS_OF)
    return C.returning(sources(spark, d), match, changes, ["id", "name", "is_enabled"])


@query(
    "cat_q13_sync_health",
    SOURCES + f"""
, m AS (
  SELECT source_type, (epoch_us({NOW}) - epoch_us(last_sync_time)) / 3600000000.0 AS h
  FROM data_sources WHERE NOT is_deleted AND is_enabled
)
SELECT source_type, COUNT(*) AS total_sources, COUNT(*) FILTER (WHERE h < 1) AS recently_synced,
       COUNT(*) FILTER (WHERE h >= 1 AND h < 24) AS stale, COUNT(*) FILTER (WHERE h >= 24) AS very_stale,
       COUNT(*) FILTER (WHERE h IS NULL) AS never_synced, ROUND(AVG(h), 2) AS avg_hours_since_sync
FROM m GROUP BY source_type""",
)
def cat_q13(spark, d):
    return C.sync_health(sources(spark, d), AS_OF)


@query(
    "cat_q14_metadata",
    SOURCES + """
SELECT id, name, source_type, metadata, created_at FROM data_sources
WHERE json_contains(metadata, '{"owner": {"tier": "gold"}, "status": "F"}') AND NOT is_deleted""",
)
def cat_q14(spark, d):
    return C.sources_with_metadata(sources(spark, d), {"owner": {"tier": "gold"}, "status": "F"})


@query(
    "cat_q15_page",
    SOURCES + """
SELECT id, name, source_type, status, last_sync_time, created_at FROM data_sources
WHERE NOT is_deleted AND is_enabled AND id > 500 ORDER BY id LIMIT 50""",
)
def cat_q15(spark, d):
    return C.page_after(sources(spark, d), 500, 50)


def tests_log(spark, d):
    """Every event as a connection test of its user's source."""
    user = F.col("user_id")
    return table(spark, d, "events").select(
        user.alias("id"),
        F.concat(F.lit("source_"), user.cast("string")).alias("name"),
        F.lit("event").alias("source_type"),
        F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("last_connection_status"),
        F.col("ts").alias("last_connection_test"),
        F.lit(False).alias("is_deleted"),
    )


@query(
    "cat_q16_test_gaps",
    """
WITH t AS (
  SELECT user_id AS id, 'source_' || CAST(user_id AS VARCHAR) AS name, 'event' AS source_type,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'success' END AS last_connection_status,
         ts AS last_connection_test, LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) AS prev FROM events
)
SELECT id, name, source_type, last_connection_status, last_connection_test,
       ROUND((epoch_us(last_connection_test) - epoch_us(prev)) / 3600000000.0, 2) AS hours_between_tests
FROM t WHERE prev IS NOT NULL""",
)
def cat_q16(spark, d):
    return C.test_gaps(tests_log(spark, d))


SNAPSHOT = SOURCES + f"""
, snap AS (
  SELECT id, name, source_type, status, is_enabled, last_sync_time, last_connection_status,
         (epoch_us({NOW}) - epoch_us(last_sync_time)) / 3600000000.0 AS hours_since_sync,
         CASE WHEN status = 'active' AND last_connection_status = 'success' THEN 'healthy'
              WHEN status = 'error' OR last_connection_status = 'failed' THEN 'unhealthy'
              WHEN status = 'inactive' THEN 'disabled' ELSE 'unknown' END AS health_status, created_at, updated_at
  FROM data_sources WHERE NOT is_deleted
)
"""


@query("cat_snapshot", SNAPSHOT + "SELECT * FROM snap")
def cat_snapshot(spark, d):
    return C.summary_snapshot(sources(spark, d), AS_OF)


@query(
    "cat_q17_health",
    SNAPSHOT + """
SELECT source_type, COUNT(*) AS total, COUNT(*) FILTER (WHERE health_status = 'healthy') AS healthy,
       COUNT(*) FILTER (WHERE health_status = 'unhealthy') AS unhealthy,
       COUNT(*) FILTER (WHERE health_status = 'disabled') AS disabled FROM snap GROUP BY source_type""",
)
def cat_q17(spark, d):
    return C.health_by_type(C.summary_snapshot(sources(spark, d), AS_OF))


@query(
    "cat_constraints",
    SOURCES + """
SELECT 'name_not_null' AS rule, COUNT(*) FILTER (WHERE name IS NULL) AS violations FROM data_sources
UNION ALL SELECT 'source_type_not_null', COUNT(*) FILTER (WHERE source_type IS NULL) FROM data_sources
UNION ALL SELECT 'connection_config_not_null', COUNT(*) FILTER (WHERE connection_config IS NULL) FROM data_sources
UNION ALL SELECT 'valid_status', COUNT(*) FILTER (WHERE status IN ('error', 'paused')) FROM data_sources""",
)
def cat_constraints(spark, d):
    """Sources in error are given a state the catalogue does not know."""
    state = F.when(F.col("status") == "error", "paused").otherwise(F.col("status"))
    return Q.rule_counts(sources(spark, d).withColumn("status", state), Q.source_rules())
