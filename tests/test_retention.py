import pytest

from ledgerlens.operators import retention as R

LOG = [
    (1, "2026-01-03 08:00:00", "a"), (1, "2026-02-10 09:00:00", "a"), (1, "2026-03-11 09:00:00", "b"),
    (2, "2026-01-20 08:00:00", "a"), (2, "2026-01-21 07:00:00", "a"), (2, "2026-03-01 08:00:00", "a"),
    (3, "2026-02-01 10:00:00", "a"), (3, "2026-03-02 10:00:00", "a"),
    (4, "2026-02-05 10:00:00", "b"),
    (5, "2026-05-05 10:00:00", "b"),
    (None, "2026-01-01 00:00:00", "a"), (6, None, "a"),
]


@pytest.fixture(scope="module")
def log(spark):
    df = spark.createDataFrame(LOG, "user_id int, ts string, event string")
    return df.selectExpr("user_id", "cast(ts as timestamp) as date", "event")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_cohorts(log):
    got = rows(R.calculate_retention(log, retention_periods=2), "cohort_period")
    assert got == [
        ("2026-01", 2, 100.0, 50.0, 100.0),
        ("2026-02", 2, 100.0, 50.0, None),
        ("2026-05", 1, 100.0, None, None),
    ]


def test_cohort_options(log):
    events = R.calculate_retention(log, event_column="event", events=["a"], retention_periods=1)
    assert rows(events, "cohort_period") == [("2026-01", 2, 100.0, 50.0), ("2026-02", 1, 100.0, 100.0)]
    busy = R.calculate_retention(log, min_activity_threshold=2, retention_periods=1, include_cohort_size=False)
    assert rows(busy, "cohort_period") == [("2026-01", 100.0, None)]


def test_simple(log):
    got = rows(R.calculate_retention(log, method="simple"), "period")
    assert got == [("2026-01", 2, 1, 50.0), ("2026-02", 3, 2, 66.67), ("2026-03", 3, 0, 0.0)]


def test_rolling(log):
    got = rows(R.calculate_retention(log, method="rolling", retention_periods=2), "start_period", "offset")
    # Periods 01 02 03 05: a start needs start + 2 <= 4; the last start has two targets left.
    assert got == [
        ("2026-01", 0, "2026-01", 100.0), ("2026-01", 1, "2026-02", 50.0), ("2026-01", 2, "2026-03", 100.0),
        ("2026-02", 0, "2026-02", 100.0), ("2026-02", 1, "2026-03", 66.67), ("2026-02", 2, "2026-05", 0.0),
        ("2026-03", 0, "2026-03", 100.0), ("2026-03", 1, "2026-05", 0.0),
    ]


def test_days_are_elapsed_days(spark, log):
    out = R.calculate_retention(log, method="n_day", retention_periods=3)
    assert out.columns == ["cohort_date", "cohort_size", "Day_1", "Day_3"]
    # User 2 comes back after 23 hours: that is day 0.
    assert all(r["Day_1"] == 0.0 for r in out.collect())
    later = spark.createDataFrame([(1, "2026-01-01 08:00:00"), (1, "2026-01-02 08:00:00")], "user_id int, date string")
    assert R.calculate_retention(later, method="n_day", retention_periods=1).first()["Day_1"] == 100.0


def test_days_with_enough_rows(spark):
    rows = [(1, "2026-01-01 08:00:00"), (1, "2026-01-02 09:00:00"), (1, "2026-01-03 07:00:00"), (1, "2026-01-04 09:00:00"),
            (2, "2026-01-01 10:00:00"), (2, "2026-01-02 10:00:00")]
    df = spark.createDataFrame(rows, "user_id int, date string")
    for least, day_1, day_3 in ((1, 100.0, 50.0), (2, 50.0, 0.0), (3, 0.0, 0.0)):
        out = R.calculate_retention(df, method="n_day", retention_periods=3, min_activity_threshold=least).first()
        assert (out["cohort_size"], out["Day_1"], out["Day_3"]) == (2, day_1, day_3)


def test_reported_days():
    assert R.reported_days(12) == [1, 3, 7, 12]
    assert R.reported_days(400) == [1, 3, 7, 14, 30, 60, 90]


def test_summaries(log):
    table = R.cohort_retention(R.activity(log, "user_id", "date"), "M", 2)
    assert R.retention_rate(table).first()[0] == pytest.approx((100 + 50 + 100) / 3)
    assert R.best_cohort(table).first()["cohort_period"] == "2026-01"
    report = R.retention_report(table, R.activity(log, "user_id", "date"), "cohort").first()
    assert (report["total_users"], report["total_records"], report["cohort_count"]) == (5, 10, 3)
    assert report["median_retention"] == 100.0 and str(report["start_date"]) == "2026-01-03"


def test_empty_and_invalid(log):
    empty = log.limit(0)
    for method in R.METHODS:
        assert R.calculate_retention(empty, method=method).count() == 0
    assert R.retention_rate(R.calculate_retention(empty)).first()[0] == 0.0
    with pytest.raises(ValueError):
        R.calculate_retention(log, method="magic")
    with pytest.raises(ValueError):
        R.calculate_retention(log, user_column="nobody")
