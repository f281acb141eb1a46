import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import kpis as K, reports as P


@pytest.fixture(scope="module")
def orders(spark):
    rows = [
        ("new", 5, 100.0), ("kept", 5, 50.0), ("kept", 40, 50.0), ("lost", 40, 30.0), ("back", 2, 20.0), ("back", 200, 10.0),
    ]
    last = dt.date(2026, 6, 30)
    return spark.createDataFrame(
        [(c, last - dt.timedelta(days=n), a) for c, n, a in rows] + [("back", last, 0.0)], "customer string, day date, amount double"
    )


def values(df):
    return {r["kpi"]: r["value"] for r in df.collect()}


def test_customer_flags(orders):
    got = values(K.customer_kpis(K.customer_activity(orders, "customer", "amount", "day", 30)))
    assert (got["total_customers"], got["active_customers"], got["new_customers"]) == (4, 3, 1)
    assert (got["churned_customers"], got["reactivated_customers"]) == (1, 1)
    assert (got["customer_retention_rate"], got["churn_rate"]) == (50, 50)
    assert got["customer_lifetime_value"] == 65.0


def test_segments(spark, orders):
    who = spark.createDataFrame([("new", "A"), ("kept", "A"), ("lost", "B"), ("back", "B")], "k string, seg string")
    act = K.customer_activity(orders, "customer", "amount", "day", 30)
    rows = {r["segment"]: r for r in K.customer_segments(act, who, "k", "seg").collect()}
    assert (rows["A"]["customers"], rows["A"]["revenue"], rows["A"]["retention_rate"]) == (2, 200.0, 100.0)
    assert rows["B"]["churn_rate"] == 100.0


def test_comparison_and_daily(orders):
    row = K.compare_periods(orders, {"sales": "amount"}, "day", 30).first()
    assert (row["value"], row["previous"], row["trend"], row["status"]) == (170.0, 80.0, "up", "healthy")
    days = K.daily_profit(orders.withColumn("cost", F.lit(1.0)), "amount", "cost", "day", 10).orderBy("date").collect()
    assert len(days) == 6 and days[1]["transactions"] == 0 and days[0]["profit"] == 148.0


def test_rules_and_formats(spark):
    df = spark.createDataFrame(
        [("financial", "profit_margin", 12.0, None), ("customer", "churn_rate", 10.0, None),
         ("financial", "revenue", 5.0, 3.0), ("financial", "roi", 1.0, None)],
        "category string, kpi string, value double, change double",
    )
    assert {r["title"] for r in K.apply_rules(df).collect()} == {"Profit margin below target", "Positive revenue trend"}
    assert K.in_format(df, "financial").count() == 3
    assert K.in_format(df, form="minimal").count() == 2  # margin and revenue; roi and churn are not essential
    with pytest.raises(ValueError):
        K.in_format(df, "weather")


def test_no_sales(spark):
    empty = spark.createDataFrame([], "amount double")
    assert K.sales_kpis(empty, "amount").first()["kpi"] == "no_data"


def test_funnel_is_ordered(spark):
    rows = [("a", "view", 1), ("a", "click", 2), ("a", "buy", 3), ("b", "click", 1), ("b", "view", 2), ("b", "buy", 3), ("c", "buy", 1)]
    df = spark.createDataFrame(rows, "u string, e string, t int")
    got = [(r["users"], r["total_conversion"]) for r in P.funnel(df, "u", "e", "t", ["view", "click", "buy"]).orderBy("position").collect()]
    assert got == [(2, 100.0), (1, 50.0), (1, 50.0)]
