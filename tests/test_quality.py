import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.jsonmatch import contains
from ledgerlens.functions.text import simple_name, standard_name
from ledgerlens.operators import catalog as C, quality as Q
from ledgerlens.plans import groups


def test_names():
    assert simple_name(" Total Price ($) ") == "total_price_"
    assert standard_name("  Total   Price ($) ") == "total_price"
    assert standard_name("Order__ID", keep_case=True) == "Order_ID"


def test_profile(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (2, None, -0.0), (3, "a", None)], "id int, s string, d double")
    rows = {r["column_name"]: r for r in Q.profile(df, ["id"]).collect()}
    assert (rows["s"]["null_count"], rows["s"]["distinct_count"], rows["s"]["sample_values"]) == (1, 1, "a, a")
    assert rows["d"]["distinct_count"] == 1 and rows["d"]["data_type"] == "double"
    about = {r["column_name"]: r["distinct_count"] for r in Q.profile(df, exact=False).collect()}
    assert about["id"] == 3


def test_load_issues(spark):
    df = spark.range(100).select(
        F.when(F.col("id") == 0, 1.0).alias("A"), F.lit(5).alias("B"), F.lit(None).cast("int").alias("C")
    )
    got = {(r["check"], r["column_name"]) for r in Q.load_issues(df, ["A", "B", "A"]).collect()}
    assert got == {("many_nulls", "A"), ("single_value", "A"), ("single_value", "B"), ("all_null", "C"), ("duplicate_name", "A")}
    assert ("empty_table", "critical") in {
        (r["check"], r["severity"]) for r in Q.load_issues(df.limit(0)).collect()
    }


def test_upload_report(spark):
    df = spark.createDataFrame([(None, None), (1, None)], "a int, b int")
    row = Q.upload_report(df, ["a", "a"]).first()
    assert (row["empty_rows"], row["all_null_columns"], row["null_percentage"]) == (1, "b", 75.0)
    assert not row["is_valid"] and "repeated" in row["errors"]
    assert "empty" in Q.upload_report(df.limit(0)).first()["errors"]


def test_constraints(spark):
    rows = [
        (1, "a", 1, False, "completed", 50.0, 10), (2, "a", 1, False, "lost", 101.0, -1),
        (3, None, 1, False, None, None, None),
    ]
    df = spark.createDataFrame(
        rows, "id int, name string, version int, is_deleted boolean, status string, data_quality_score double, row_count int"
    )
    for c in ("column_count", "records_processed", "records_failed", "records_skipped", "processing_duration_seconds"):
        df = df.withColumn(c, F.lit(None).cast("int"))
    counts = {r["rule"]: r["violations"] for r in Q.rule_counts(df, Q.dataset_rules()).collect()}
    assert counts == {"name_not_null": 1, "valid_status": 1, "valid_quality_score": 1, "valid_duration": 0, "valid_counts": 1}
    assert Q.rule_violations(df, Q.dataset_rules(), ["id"]).count() == 4
    assert Q.unique_violations(df, ["name", "version", "is_deleted"]).first()["rows"] == 2


@pytest.mark.parametrize("split", [False, True])
def test_references(spark, monkeypatch, split):
    if split:
        monkeypatch.setattr(
            Q, "attach", lambda df, s, keys: groups.attach(df, s, keys, small=False, hot_rows=1)
        )
    child = spark.createDataFrame([(1, 7), (2, 8), (3, 8), (4, None)], "id int, parent int")
    parent = spark.createDataFrame([(7,), (7,)], "pid int")
    assert [r["id"] for r in Q.orphans(child, "parent", parent, "pid").orderBy("id").collect()] == [2, 3]
    assert [r["id"] for r in Q.valid_references(child, "parent", parent, "pid").collect()] == [1]


@pytest.mark.parametrize(
    "text,wanted,want",
    [
        ('["a", "b"]', ["b"], True),
        ('["a", "b"]', ["b", "c"], False),
        ('["a"]', [], True),
        ('{"a": {"b": 1, "c": 2}}', {"a": {"b": 1}}, True),
        ('{"a": {"b": 1}}', {"a": {"b": 1.0}}, True),
        ('{"a": {"b": "1"}}', {"a": {"b": 1}}, False),
        ('{"a": true}', {"a": True}, True),
        ('{"a": "true"}', {"a": True}, False),
        ('{"a": null}', {"a": None}, True),
        ('{"b": 1}', {"a": None}, False),
        ('{"a": [1, {"k": [2, 3]}]}', {"a": [{"k": [3]}]}, True),
        ('{"a.b": 1}', {"a.b": 1}, True),
        ("{broken", {"a": 1}, False),
        (None, {"a": 1}, False),
        ('"text"', {}, False),
        ("{}", {}, True),
    ],
)
def test_json_containment(spark, text, wanted, want):
    df = spark.createDataFrame([(text,)], "j string")
    assert df.select(contains(F.col("j"), wanted)).first()[0] is want


@pytest.fixture(scope="module")
def sources(spark):
    rows = [
        (1, "db", "database", "active", True, "success", "2026-01-01 10:00:00", "2026-01-02 00:00:00", False),
        (2, "api", "api", "error", True, "failed", "2026-01-01 23:30:00", None, False),
        (3, "old", "file", "inactive", False, None, None, None, False),
        (4, "gone", "api", "active", True, "success", None, None, True),
        (5, "new", "api", "active", True, "success", None, None, False),
    ]
    df = spark.createDataFrame(
        rows, "id int, name string, source_type string, status string, is_enabled boolean,"
        " last_connection_status string, last_sync_time string, next_sync_time string, is_deleted boolean"
    )
    stamp = "timestamp_ntz"
    return df.withColumns(
        {
            "last_sync_time": F.col("last_sync_time").cast(stamp),
            "next_sync_time": F.col("next_sync_time").cast(stamp),
            "last_connection_test": F.col("last_sync_time").cast(stamp),
            "created_at": F.lit("2026-01-01").cast(stamp),
            "updated_at": F.lit("2026-01-01").cast(stamp),
            "deleted_at": F.lit(None).cast(stamp),
            "updated_by": F.lit(None).cast("string"),
            "last_error_message": F.lit(None).cast("string"),
            "refresh_schedule": F.lit("hourly"),
            "description": F.lit(""),
        }
    )


NOW = "2026-01-02 00:00:00"


def ids(df):
    return [r["id"] for r in df.collect()]


def test_catalogue_reads(sources):
    assert ids(C.active_sources(sources)) == [1, 5]
    assert ids(C.sources_of_type(sources, "api")) == [2, 5]
    assert ids(C.due_for_sync(sources, NOW)) == [5, 1]
    assert ids(C.failed_connections(sources)) == [2]
    assert ids(C.page_after(sources, None, 2)) == [1, 2]
    assert ids(C.page_after(sources, 2, 5)) == [5]
    health = {r["source_type"]: r for r in C.sync_health(sources, NOW).collect()}
    assert (health["api"]["recently_synced"], health["api"]["never_synced"]) == (1, 1)
    assert (health["database"]["stale"], health["database"]["avg_hours_since_sync"]) == (1, 14.0)
    states = {r["id"]: r["health_status"] for r in C.summary_snapshot(sources, NOW).collect()}
    assert states == {1: "healthy", 2: "unhealthy", 3: "disabled", 5: "healthy"}


def test_catalogue_updates(sources):
    match, changes = C.touch_sync(1, "me", NOW)
    after = {r["id"]: r for r in C.update(sources, match, changes).collect()}
    assert str(after[1]["next_sync_time"]) == "2026-01-02 01:00:00" and after[2]["updated_by"] is None
    match, changes = C.soft_delete(4, "me", NOW)
    assert C.returning(sources, match, changes, ["id"]).count() == 0
    match, changes = C.connection_result(F.col("id") == 2, "success", None, NOW)
    assert C.returning(sources, match, changes, ["id", "status"]).first()["status"] == "active"
    match, changes = C.connection_result(F.col("id") == 1, "failed", "boom", NOW)
    row = C.returning(sources, match, changes, ["status", "last_error_message"]).first()
    assert tuple(row) == ("error", "boom")
    match, changes = C.enable_type("api", False, "me", NOW)
    assert [r["is_enabled"] for r in C.update(sources, match, changes).orderBy("id").collect()] == [True, False, False, True, False]
