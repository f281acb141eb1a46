"""The registry, and the shape of plans that must hold at any size."""

import re

import pytest

import __spark_entry__ as entry
from ledgerlens.operators import anomalies, revenue
from ledgerlens.workload.views import order_sales


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "revenue_rank" in df.columns


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# Queries over rows as they are, which no single task may see.
ROW_QUERIES = (
    "anomaly_grouped_moving_avg", "anomaly_grouped_zscore", "anomaly_grouped_iqr", "anomaly_missing_fill_mean",
    "fill_mean", "fill_mode", "dedup_first", "dedup_none", "dedup_mark", "dup_find", "outliers_iqr",
    "outliers_zscore", "normalize_minmax", "convert_types", "cat_q10_connection_ok", "cat_q16_test_gaps",
    "foreign_key_orphans", "retention_cohort_month", "product_trends", "revenue_by_category", "kpi_customer",
)


@pytest.mark.parametrize("name", ROW_QUERIES)
def test_no_task_sees_all_rows_in_order(spark, sf, name):
    plan = executed(entry.queries()[name](spark, sf))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    main = re.split(r"Subquery", plan)[0]
    assert not re.search(r"Window.*\n(?:.*Sort.*\n)?.*Exchange SinglePartition", main)


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    entry.queries()["revenue_filtered"](spark, sf).explain("formatted")
    plan = capsys.readouterr().out
    pushed = " ".join(line for line in plan.splitlines() if line.startswith("PushedFilters"))
    assert "GreaterThanOrEqual(l_shipdate" in pushed and "EqualTo(p_type,ECONOMY)" in pushed
    assert "l_returnflag" not in plan and "p_brand" not in plan


def test_category_share_reads_the_facts_once(spark, sf):
    df = entry.queries()["revenue_by_category"](spark, sf)
    df.collect()
    assert "ReusedExchange" in executed(df)


def test_split_plans_range_partition(spark, sf, monkeypatch):
    from ledgerlens.plans import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    rows = order_sales(spark, sf)
    out = revenue.cumulative_revenue(rows, "total_amount", "order_date", order_by=["order_id"])
    assert out.count() == rows.count()
    total = rows.agg({"total_amount": "sum"}).first()[0]
    assert out.agg({"cumulative_revenue": "max"}).first()[0] == float(total)


def test_large_groups_give_the_same_anomalies(spark, sf, monkeypatch):
    rows = order_sales(spark, sf)

    def run(method):
        return anomalies.detect_anomalies(
            rows, "total_amount", "order_date", method, 2.0, order_by=["order_id"]
        ).orderBy("order_id").select("order_id", "is_anomaly", "anomaly_score").collect()

    plain = {m: run(m) for m in ("moving_avg", "seasonal")}
    from ledgerlens.plans import ordered

    monkeypatch.setattr(ordered, "TASK_ROWS", 10)
    monkeypatch.setattr(anomalies, "TASK_ROWS", 10)
    for method, want in plain.items():
        got = run(method)
        assert [r["is_anomaly"] for r in got] == [r["is_anomaly"] for r in want]
        assert [r["anomaly_score"] for r in got] == pytest.approx([r["anomaly_score"] for r in want], abs=1e-3)


def test_date_windows_reach_the_scan(spark, sf, capsys):
    for name in ("sales_summary_90d", "kpi_daily_30d"):
        entry.queries()[name](spark, sf).explain("formatted")
        plan = capsys.readouterr().out
        pushed = " ".join(line for line in plan.splitlines() if line.startswith("PushedFilters"))
        assert "GreaterThanOrEqual(o_orderdate" in pushed or "GreaterThanOrEqual(l_shipdate" in pushed, name
