import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomalies as A, isolation

EIGHT = (10, 12, 11, 13, 12, 11, 10, 100)


def series(spark, values, group=None):
    first = dt.datetime(2026, 1, 1)
    rows = [(first + dt.timedelta(days=i), None if v is None else float(v), group) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date timestamp, value double, grp string")


def at(df, value):
    return df.filter(F.col("value") == value).first()


@pytest.fixture(scope="module", params=[None, 1000], ids=["aggregated", "windowed"])
def bound(request):
    return request.param


def test_zscore(spark, bound):
    out = A.detect_anomalies(series(spark, EIGHT), "value", "date", max_group_rows=bound)
    row = at(out, 100)
    assert row["anomaly_score"] == 2.6443 and not row["is_anomaly"]
    sample = A.detect_anomalies(series(spark, EIGHT), "value", "date", service=True, max_group_rows=bound)
    assert at(sample, 100)["anomaly_score"] == 2.4735


def test_iqr(spark, bound):
    out = A.detect_anomalies(series(spark, EIGHT), "value", "date", "iqr", 1.5, max_group_rows=bound)
    assert [r["value"] for r in out.filter("is_anomaly").collect()] == [100.0]
    assert tuple(at(out, 100))[-2:] == (14.5, 8.5)


def test_mad(spark, bound):
    out = A.detect_anomalies(series(spark, EIGHT), "value", "date", "mad", 3.0, max_group_rows=bound)
    assert at(out, 100)["anomaly_score"] == 59.6932
    flat = A.detect_anomalies(series(spark, [5, 5, 5, 9]), "value", "date", "mad", 3.0, max_group_rows=bound)
    assert flat.filter("is_anomaly").count() == 0


def test_moving_average_needs_full_windows(spark, bound):
    out = A.detect_anomalies(
        series(spark, EIGHT), "value", "date", "moving_avg", 1.0, window_size=3, max_group_rows=bound
    ).orderBy("date").collect()
    assert out[0]["upper_bound"] is None and out[-1]["upper_bound"] is None
    middle = [(r["upper_bound"] + r["lower_bound"]) / 2 for r in out[1:-1]]
    assert middle == pytest.approx([11, 12, 12, 12, 11, 40.3333], abs=1e-3)
    short = A.detect_anomalies(series(spark, [1, 9]), "value", "date", "moving_avg", 1.0, max_group_rows=bound)
    assert short.filter("is_anomaly").count() == 0


@pytest.mark.parametrize("windowed", [True, False])
def test_decomposition(spark, windowed):
    scope = A.Scope([], ["date"], 1000 if windowed else None)
    scope.in_window = windowed
    rows = A.decompose(
        series(spark, [1, 2, 3, 2, 3, 4, 3, 4, 5]), "value", 3, scope, ("t", "s", "r")
    ).orderBy("date").collect()
    assert [r["t"] for r in rows][1:-1] == pytest.approx([2, 7 / 3, 8 / 3, 3, 10 / 3, 11 / 3, 4])
    assert rows[0]["t"] is None and rows[-1]["t"] is None
    assert [r["s"] for r in rows[:3]] == pytest.approx([-2 / 3, 0, 2 / 3])
    assert [r["r"] for r in rows[1:-1]] == pytest.approx([0] * 7)


def test_seasonal_edges_are_not_anomalies(spark):
    values = [10, 20, 30, 40, 50, 60, 70] * 6
    values[20] = 500
    out = A.detect_anomalies(series(spark, values), "value", "date", "seasonal", 3.0, max_group_rows=100)
    assert [r["value"] for r in out.filter("is_anomaly").collect()] == [500.0]
    assert out.filter("is_anomaly is null").count() == 0
    short = A.detect_anomalies(series(spark, values[:13]), "value", "date", "seasonal", 0.1, max_group_rows=100)
    assert short.filter("is_anomaly").count() == 0


@pytest.mark.parametrize("method", ["zscore", "iqr", "mad", "moving_avg", "seasonal"])
def test_groups_are_independent(spark, method):
    a = series(spark, [float(i % 7) for i in range(40)] + [90.0] + [float(i % 7) for i in range(20)], "a")
    b = series(spark, [1000.0 + i % 5 for i in range(50)], "b")
    none = series(spark, [1.0], None)
    both = a.union(b).union(none)
    one = A.detect_anomalies(a, "value", "date", method, 2.0)
    many = A.detect_anomalies(both, "value", "date", method, 2.0, groupby_column="grp")
    assert many.filter("grp is null").count() == 0
    got = many.filter("grp = 'a'").orderBy("date").select("is_anomaly", "anomaly_score").collect()
    assert got == one.orderBy("date").select("is_anomaly", "anomaly_score").collect()


def test_missing_values(spark):
    df = series(spark, [None, 1, None, None, 4, None])
    scope = A.Scope([], ["date"], None)
    filled = A.handle_missing(df, "value", "interpolate", scope).orderBy("date").collect()
    assert [r["value"] for r in filled] == pytest.approx([1, 2, 3, 4, 4])
    for how, want in (("drop", [1, 4]), ("fill_mean", [2.5, 1, 2.5, 2.5, 4, 2.5]), ("other", [1, 4])):
        rows = A.handle_missing(df, "value", how, scope).orderBy("date").collect()
        assert [r["value"] for r in rows] == want


def test_summary_and_classes(spark):
    out = A.detect_anomalies(series(spark, EIGHT + (0,)), "value", "date", "mad", 3.0)
    total = A.anomaly_summary(out, "mad", 3.0).first()
    assert (total["total_records"], total["total_anomalies"]) == (9, 2)
    rows = A.classify(out, "value", 3.0).orderBy("value").collect()
    assert [(r["type"], r["severity"], r["deviation_pct"]) for r in rows] == [
        ("drop", "critical", -100.0), ("spike", "critical", 809.1),
    ]
    messages = [r["message"] for r in A.alerts(A.classify(out, "value", 3.0), "revenue", "value", "date").collect()]
    assert messages[0] == "Revenue spiked to $100.00 on 2026-01-08 (+809.1% from median)"


def test_isolation_finds_planted_values(spark):
    rng = np.random.default_rng(1)
    values = list(rng.normal(100, 10, 600)) + [400.0, -300.0]
    out = A.detect_anomalies(series(spark, values), "value", "date", "isolation", 0.1)
    flagged = {r["value"] for r in out.filter("is_anomaly").collect()}
    assert {400.0, -300.0} <= flagged and len(flagged) <= 12
    assert out.count() == 602


def test_isolation_by_group(spark):
    rng = np.random.default_rng(2)
    a = series(spark, list(rng.normal(100, 10, 400)) + [400.0], "a")
    b = series(spark, list(rng.normal(5, 1, 300)) + [100.0], "b")
    out = A.detect_anomalies(a.union(b), "value", "date", "isolation", 0.1, groupby_column="grp")
    flagged = {(r["grp"], r["value"]) for r in out.filter("is_anomaly").collect()}
    assert {("a", 400.0), ("b", 100.0)} <= flagged
    assert sum(g == "a" for g, _ in flagged) <= 5 and out.count() == 702
    # A group scored alone takes the other plan; the samples are the same, so are the trees.
    alone = A.detect_anomalies(a, "value", "date", "isolation", 0.1)
    one = {r["date"]: r["anomaly_score"] for r in alone.collect()}
    for r in out.filter("grp = 'a'").collect():
        assert r["anomaly_score"] == pytest.approx(one[r["date"]], abs=0.05)


def test_tree_steps_cover_the_line():
    edges, depths = isolation.grow_tree(np.arange(256.0), np.random.default_rng(3))
    assert edges[0] == -np.inf and (np.diff(edges) > 0).all() and (depths > 0).all()


def test_forest_takes_the_same_rows_from_candidates_as_from_all(spark):
    df = spark.range(20_000).withColumn("v", F.sin("id")).repartition(4)
    kept = isolation.candidates(df, "v", F.lit(20_000), ["id"], ["id"], 10, 16)
    every = isolation.candidates(df, "v", F.lit(1), ["id"], ["id"], 10, 16)
    few, rows = kept.toPandas(), every.toPandas()
    assert len(rows) == 20_000 and 10 * 16 <= len(few) <= 8 * 10 * 16
    a = isolation.grow_forest(few["value"].to_numpy(), few["mark"].to_numpy(), 10, 16)
    b = isolation.grow_forest(rows["value"].to_numpy(), rows["mark"].to_numpy(), 10, 16)
    assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_forest_copies_no_row(spark):
    df = series(spark, list(range(50)), "a")
    steps = isolation.group_steps(df.withColumn("__size", F.lit(50)), "value", ["grp"], ["date"], 100, 256)
    assert steps.count() <= 50 and "Generate" not in steps._jdf.queryExecution().executedPlan().toString()
    few = A.detect_anomalies(df, "value", "date", "isolation", 0.1, trees=5, sample_size=8)
    assert few.count() == 50 and few.filter("anomaly_score IS NULL").count() == 0


def test_service_window_is_a_third_of_the_rows(spark):
    out = A.detect_anomalies(series(spark, EIGHT + (11,)), "value", "date", "moving_avg", 1.0, service=True)
    assert out.filter("upper_bound is not null").count() == 7
    tiny = A.detect_anomalies(series(spark, [1, 5]), "value", "date", "moving_avg", 1.0, service=True)
    assert tiny.filter("is_anomaly").count() == 0


def test_invalid_calls(spark):
    df = series(spark, EIGHT)
    with pytest.raises(ValueError):
        A.detect_anomalies(df, "value", "date", "dbscan")
    with pytest.raises(ValueError):
        A.detect_anomalies(df, "value", None, "seasonal")
    with pytest.raises(ValueError):
        A.detect_anomalies(df, "nothing")
