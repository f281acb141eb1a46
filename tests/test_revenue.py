"""Revenue metrics on ten hand-computed days."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import filters, revenue as R

VALUES = (1500, 750, 350, 2200, 1800, 420, 950, 3100, 580, 1250)
KINDS = ("Electronics", "Furniture", "Clothing")


@pytest.fixture(scope="module")
def days(spark):
    first = dt.datetime(2026, 4, 1)
    rows = [(first + dt.timedelta(days=i), float(v), KINDS[i % 3]) for i, v in enumerate(VALUES)]
    return spark.createDataFrame(rows, "date timestamp, value double, category string")


def one(df):
    return df.first()[0]


@pytest.mark.parametrize("metric,want", [("total", 12900), ("average", 1290), ("median", 1100)])
def test_scalars(days, metric, want):
    assert one(R.calculate_revenue(days, metric_type=metric)) == want


def test_breakdown(days):
    row = R.calculate_revenue(days, metric_type="median", include_breakdown=True).first()
    assert row["metric_value"] == 1100 and row["total_revenue"] == 12900
    assert row["std_deviation"] == 879.51 and row["records_processed"] == 10
    assert row["status"] == "success"


def test_by_category(days):
    rows = R.calculate_revenue(days, category_column="category", metric_type="by_category").collect()
    assert [(r["category"], r["total_revenue"], r["percentage"]) for r in rows] == [
        ("Electronics", 5900, 45.74), ("Furniture", 5650, 43.8), ("Clothing", 1350, 10.47),
    ]


def test_moving_average(days):
    out = R.calculate_revenue(days, date_column="date", metric_type="moving_average", moving_window=3)
    got = [r["ma_3_revenue"] for r in out.orderBy("date").collect()]
    assert got == [1500, 1125, 866.67, 1100, 1450, 1473.33, 1056.67, 1490, 1543.33, 1643.33]


def test_cumulative(days):
    out = R.calculate_revenue(days, date_column="date", metric_type="cumulative")
    got = [r["cumulative_revenue"] for r in out.orderBy("date").collect()]
    assert got == [1500, 2250, 2600, 4800, 6600, 7020, 7970, 11070, 11650, 12900]


def test_weeks_are_labelled_by_their_sunday(days):
    out = R.calculate_revenue(days, date_column="date", metric_type="growth_rate", period="W")
    rows = [tuple(r) for r in out.orderBy("period").collect()]
    assert rows == [(dt.date(2026, 4, 5), 6600, None), (dt.date(2026, 4, 12), 6300, -4.55)]


@pytest.mark.parametrize(
    "period,label",
    [("D", "2026-04-01"), ("W", "2026-04-05"), ("M", "2026-04-30"), ("Q", "2026-06-30"), ("Y", "2026-12-31")],
)
def test_period_labels(days, period, label):
    out = R.calculate_revenue(days, date_column="date", metric_type="by_period", period=period)
    assert str(out.orderBy("period").first()["period"]) == label


def test_gaps_are_filled(days):
    out = R.calculate_revenue(
        days.filter("dayofmonth(date) in (1, 4)"), date_column="date", metric_type="by_period", period="D"
    )
    rows = [tuple(r) for r in out.orderBy("period").collect()]
    assert len(rows) == 4
    assert rows[1][1:] == (0.0, None, 0, None, None)


def test_text_measures_and_filters(spark):
    df = spark.createDataFrame([("100",), ("200.5",), (" 300 ",), ("400",), ("n/a",), ("0",), ("-1",)], "value string")
    assert one(R.calculate_revenue(df, exclude_negative=True)) == 1000.5
    assert one(R.calculate_revenue(df)) == 999.5


def test_nan_and_small_numbers(spark):
    df = spark.createDataFrame([(0.001,), (0.002,), (0.003,), (float("nan"),)], "value double")
    assert one(R.calculate_revenue(df)) == 0.01


def test_empty_and_invalid(spark, days):
    empty = days.limit(0)
    assert one(R.calculate_revenue(empty)) == 0.0
    assert R.calculate_revenue(empty, date_column="date", metric_type="by_period").count() == 0
    assert R.calculate_revenue(empty, include_breakdown=True).first()["status"] == "no_data"
    nulls = spark.createDataFrame([(None,)], "value double")
    with pytest.raises(ValueError):
        R.calculate_revenue(nulls)
    with pytest.raises(ValueError):
        R.calculate_revenue(days, "nothing")
    with pytest.raises(ValueError):
        R.calculate_revenue(days, metric_type="mode")
    with pytest.raises(ValueError):
        R.calculate_revenue(days, metric_type="by_period")


def test_margin(spark):
    df = spark.createDataFrame([(100.0, 60.0), (200.0, 120.0)], "revenue double, cost double")
    assert one(R.profit_margin(df, "revenue", "cost")) == 40.0
    loss = spark.createDataFrame([(100.0, 200.0), (200.0, 400.0)], "revenue double, cost double")
    assert one(R.profit_margin(loss, "revenue", "cost")) == -100.0
    zero = spark.createDataFrame([(0.0, 5.0)], "revenue double, cost double")
    assert one(R.profit_margin(zero, "revenue", "cost")) == 0.0


def test_arpu_and_conversion(spark):
    df = spark.createDataFrame(
        [("a", 100.0), ("a", 200.0), ("b", 50.0), ("c", 150.0), ("c", 100.0)], "user_id string, revenue double"
    )
    assert one(R.arpu(df, "revenue", "user_id")) == 200.0
    assert one(R.arpu(df, "revenue")) == 120.0
    flags = spark.createDataFrame([(True,), (False,), (True,), (False,), (True,)], "converted boolean")
    assert one(R.conversion_rate(flags, "converted")) == 60.0
    assert one(R.conversion_rate(flags.limit(0), "converted")) == 0.0


def test_date_filters(days):
    assert filters.in_dates(days, "date", "2026-04-02", "2026-04-04").count() == 3
    assert filters.in_dates(days, "date", None, "2026-04-04").count() == 4
    assert filters.in_period(days, "date", "7d").count() == 7
    assert filters.in_period(days, "date", "ytd", "2026-04-03").count() == 3
    assert filters.sorted_top(days, "value", limit=2).select("value").collect()[0][0] == 3100
    assert filters.as_records(days.select(F.lit(1).alias("a")).limit(1)).first()[0] == '{"a":1}'
    with pytest.raises(ValueError):
        filters.sorted_top(days, limit=0)


def test_text_dates_of_all_layouts_count(spark):
    texts = ["2026-01-05", "01/07/2026", "2026/01/09", "11-01-2026", "13.01.2026", "2026-01-15 10:00:00", "1/7/2026", "oops", None]
    df = spark.createDataFrame([(t, 5.0) for t in texts], "d string, v double")
    [month] = R.revenue_by_period(df, "v", "d", "M").collect()
    assert (month["count"], month["total_revenue"]) == (7, 35.0)
    weeks = R.revenue_by_period(df, "v", "d", "W").collect()
    assert sum(r["total_revenue"] for r in weeks) == 35.0
    running = R.cumulative_revenue(df, "v", "d", "D").collect()
    assert max(r["cumulative_revenue"] or 0 for r in running) == 35.0
