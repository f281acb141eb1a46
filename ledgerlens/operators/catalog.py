"""Queries and updates on the catalogue of data sources.

The catalogue is a snapshot table. An update gives the next snapshot and the rows it touched;
``as_of`` stands for the current time, so that a result can be repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from ledgerlens.functions.jsonmatch import contains
from ledgerlens.plans.ordered import moving


def _live() -> Column:
    return ~F.col("is_deleted")


def _now(as_of: datetime | str | None) -> Column:
    return F.current_timestamp() if as_of is None else F.lit(str(as_of)).cast("timestamp_ntz")


def active_sources(df: DataFrame) -> DataFrame:
    """Enabled, active sources by name."""
    return (
        df.filter(F.col("is_enabled") & (F.col("status") == "active") & _live())
        .select(
            "id", "name", "description", "source_type", "status", "last_sync_time",
            "next_sync_time", "created_at", "updated_at",
        )
        .orderBy("name")
    )


def sources_of_type(df: DataFrame, source_type: str) -> DataFrame:
    """Sources of a type, the most recently tested first, untested last."""
    return (
        df.filter((F.col("source_type") == source_type) & _live())
        .select(
            "id", "name", "source_type", "status", "last_connection_status",
            "last_connection_test", "last_error_message", "is_enabled",
        )
        .orderBy(F.desc_nulls_last("last_connection_test"), "id")
    )


def due_for_sync(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Active sources never planned or planned up to now, the longest overdue first."""
    due = F.col("next_sync_time").isNull() | (F.col("next_sync_time") <= _now(as_of))
    first = F.coalesce(F.col("next_sync_time"), F.lit("1970-01-01").cast("timestamp_ntz"))
    return (
        df.filter(F.col("is_enabled") & (F.col("status") == "active") & _live() & due)
        .select("id", "name", "source_type", "last_sync_time", "next_sync_time", "refresh_schedule")
        .orderBy(first.asc(), "id")
    )


def source_by_name(df: DataFrame, name: str) -> DataFrame:
    return df.filter((F.col("name") == name) & _live()).select(
        "id", "name", "description", "source_type", "connection_config", "auth_type", "status",
        "is_enabled", "last_sync_time", "next_sync_time", "refresh_schedule", "tags", "metadata",
        "created_at", "updated_at",
    )


def sources_with_tags(df: DataFrame, tags: list) -> DataFrame:
    """Sources whose tag array holds all of the tags, newest first."""
    return (
        df.filter(contains(F.col("tags"), tags) & _live())
        .select("id", "name", "source_type", "tags", "status", "created_at")
        .orderBy(F.desc("created_at"), "id")
    )


def failed_connections(df: DataFrame) -> DataFrame:
    failed = F.col("last_connection_status") == "failed"
    return (
        df.filter(failed & F.col("is_enabled") & _live())
        .select(
            "id", "name", "source_type", "status", "last_connection_status",
            "last_connection_test", "last_error_message", "last_sync_time",
        )
        .orderBy(F.desc("last_connection_test"), "id")
    )


def type_statistics(df: DataFrame) -> DataFrame:
    """Sources per type: all, by status, enabled, by connection result."""
    return (
        df.filter(_live())
        .groupBy("source_type")
        .agg(
            F.count(F.lit(1)).alias("total_sources"),
            F.count_if(F.col("status") == "active").alias("active_count"),
            F.count_if(F.col("status") == "inactive").alias("inactive_count"),
            F.count_if(F.col("status") == "error").alias("error_count"),
            F.count_if("is_enabled").alias("enabled_count"),
            F.count_if(F.col("last_connection_status") == "success").alias("healthy_count"),
            F.count_if(F.col("last_connection_status") == "failed").alias("failed_count"),
        )
        .orderBy(F.desc("total_sources"), "source_type")
    )


def recently_added(df: DataFrame, limit: int) -> DataFrame:
    return (
        df.filter(_live())
        .select("id", "name", "source_type", "status", "created_at", "created_by")
        .orderBy(F.desc("created_at"), "id")
        .limit(limit)
    )


def update(df: DataFrame, match: Column, changes: dict[str, Column]) -> DataFrame:
    """The next snapshot: matching live rows changed, all others as they were."""
    hit = F.coalesce(match & _live(), F.lit(False))
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {
        c: F.when(hit, value.cast(types[c])).otherwise(F.col(c)) for c, value in changes.items()
    }
    return df.withColumns(new)


def returning(df: DataFrame, match: Column, changes: dict[str, Column], columns: list[str]) -> DataFrame:
    """The rows an update touches, as they are after it."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.filter(match & _live()).select(
        *[
            (changes[c].cast(types[c]) if c in changes else F.col(c)).alias(c)
            for c in columns
        ]
    )


def touch_sync(source_id: int, user: str, as_of: str | None = None) -> tuple[Column, dict[str, Column]]:
    """A source was synchronised now; the next run is in an hour."""
    now = _now(as_of)
    return F.col("id") == source_id, {
        "last_sync_time": now,
        "next_sync_time": now + F.expr("interval 1 hour"),
        "updated_at": now,
        "updated_by": F.lit(user),
    }


def connection_result(
    match: Column, result: str, message: str | None, as_of: str | None = None
) -> tuple[Column, dict[str, Column]]:
    """A connection test ended; failures set the status to error, a success lifts it."""
    now = _now(as_of)
    status = F.col("status")
    if result == "failed":
        status = F.lit("error")
    elif result == "success":
        status = F.when(F.col("status") == "error", "active").otherwise(F.col("status"))
    return match, {
        "last_connection_status": F.lit(result),
        "last_connection_test": now,
        "last_error_message": F.lit(message if result == "failed" else None),
        "status": status,
        "updated_at": now,
    }


def soft_delete(source_id: int, user: str, as_of: str | None = None) -> tuple[Column, dict[str, Column]]:
    now = _now(as_of)
    return F.col("id") == source_id, {
        "is_deleted": F.lit(True),
        "deleted_at": now,
        "updated_at": now,
        "updated_by": F.lit(user),
    }


def enable_type(
    source_type: str, enabled: bool, user: str, as_of: str | None = None
) -> tuple[Column, dict[str, Column]]:
    now = _now(as_of)
    return F.col("source_type") == source_type, {
        "is_enabled": F.lit(enabled),
        "updated_at": now,
        "updated_by": F.lit(user),
    }


def _hours(later: Column, earlier: Column) -> Column:
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(3_600_000_000.0)


def sync_health(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """Enabled sources per type by age of the last synchronisation, with the mean age in hours."""
    hours = _hours(_now(as_of), F.col("last_sync_time"))
    state = (
        F.when(F.col("last_sync_time").isNull(), "never_synced")
        .when(hours < 1, "recent")
        .when(hours < 24, "stale")
        .otherwise("very_stale")
    )
    return (
        df.filter(_live() & F.col("is_enabled"))
        .select("source_type", hours.alias("hours"), state.alias("state"))
        .groupBy("source_type")
        .agg(
            F.count(F.lit(1)).alias("total_sources"),
            F.count_if(F.col("state") == "recent").alias("recently_synced"),
            F.count_if(F.col("state") == "stale").alias("stale"),
            F.count_if(F.col("state") == "very_stale").alias("very_stale"),
            F.count_if(F.col("state") == "never_synced").alias("never_synced"),
            F.round(F.avg("hours"), 2).alias("avg_hours_since_sync"),
        )
        .orderBy(F.desc("total_sources"), "source_type")
    )


def sources_with_metadata(df: DataFrame, wanted: dict) -> DataFrame:
    """Sources whose metadata holds the given object, newest first."""
    return (
        df.filter(contains(F.col("metadata"), wanted) & _live())
        .select("id", "name", "source_type", "metadata", "created_at")
        .orderBy(F.desc("created_at"), "id")
    )


def page_after(df: DataFrame, last_id: int | None, limit: int) -> DataFrame:
    """The next page of enabled sources by id."""
    rows = df.filter(_live() & F.col("is_enabled"))
    if last_id is not None:
        rows = rows.filter(F.col("id") > last_id)
    return (
        rows.select("id", "name", "source_type", "status", "last_sync_time", "created_at")
        .orderBy("id")
        .limit(limit)
    )


def test_gaps(df: DataFrame, order_by: Sequence[str] = ()) -> DataFrame:
    """Hours between successive connection tests of a source.

    The test before is the first row of a frame of two, so a source with very many tests is
    worked on in blocks. ``order_by`` orders tests of the same time.
    """
    rows = df.filter(_live() & F.col("last_connection_test").isNotNull())
    paired = moving(
        rows,
        {
            "__n": lambda w: F.count(F.lit(1)).over(w),
            "__prev": lambda w: F.first("last_connection_test").over(w),
        },
        1,
        0,
        order_by=["last_connection_test", *order_by],
        partition_by=["id"],
    )
    return (
        paired.filter(F.col("__n") == 2)
        .select(
            "id", "name", "source_type", "last_connection_status", "last_connection_test",
            F.round(_hours(F.col("last_connection_test"), F.col("__prev")), 2).alias("hours_between_tests"),
        )
        .orderBy(F.desc("last_connection_test"), "id")
    )


def summary_snapshot(df: DataFrame, as_of: str | None = None) -> DataFrame:
    """The summary table: live sources with time since synchronisation and health."""
    status, link = F.col("status"), F.col("last_connection_status")
    health = (
        F.when((status == "active") & (link == "success"), "healthy")
        .when((status == "error") | (link == "failed"), "unhealthy")
        .when(status == "inactive", "disabled")
        .otherwise("unknown")
    )
    return df.filter(_live()).select(
        "id", "name", "source_type", "status", "is_enabled", "last_sync_time", "last_connection_status",
        _hours(_now(as_of), F.col("last_sync_time")).alias("hours_since_sync"),
        health.alias("health_status"), "created_at", "updated_at",
    )


def health_by_type(snapshot: DataFrame) -> DataFrame:
    state = F.col("health_status")
    return snapshot.groupBy("source_type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(state == "healthy").alias("healthy"),
        F.count_if(state == "unhealthy").alias("unhealthy"),
        F.count_if(state == "disabled").alias("disabled"),
    )
