import pytest

from ledgerlens.operators import products as P


@pytest.fixture(scope="module")
def sales(spark):
    rows = [
        ("2026-01-05", "A", None, 2, 100.0, 50.0, False),
        ("2026-01-09", "A", "x", 2, 100.0, 50.0, True),
        ("2026-02-05", "B", "y", 4, 300.0, 300.0, False),
        ("2026-03-05", "B", "z", 0, 0.0, 0.0, False),
        ("2026-03-06", "C", "x", 4, 100.0, 0.0, False),
        ("2026-03-07", None, "x", 4, 100.0, 0.0, False),
    ]
    df = spark.createDataFrame(
        rows, "d string, product string, category string, quantity int, revenue double, cost double, is_returned boolean"
    )
    return df.selectExpr("cast(d as timestamp) as date", "* except (d)")


def run(sales, **options):
    return P.product_performance(
        sales, "product", revenue_column="revenue", quantity_column="quantity", category_column="category",
        cost_column="cost", return_column="is_returned", order_column="date", **options,
    )


@pytest.mark.parametrize("many", [False, True])
def test_performance(sales, many):
    rows = {r["product"]: r.asDict() for r in run(sales, many_products=many).collect()}
    assert set(rows) == {"A", "B", "C"}
    a, b, c = rows["A"], rows["B"], rows["C"]
    assert (a["category"], b["category"]) == ("x", "y")
    assert a["return_rate"] == 50.0 and a["profit_margin"] == 50.0 and a["roi"] == 100.0
    assert b["roi"] == 0.0 and c["roi"] == 0.0
    assert (a["avg_price"], b["avg_price"], c["avg_price"]) == (50.0, 75.0, 25.0)
    assert sum(r["market_share"] for r in rows.values()) == pytest.approx(100.0)
    assert [rows[p]["revenue_rank"] for p in "ABC"] == [2, 1, 3]
    assert [rows[p]["quantity_rank"] for p in "ABC"] == [1, 1, 1]
    assert [rows[p]["profit_rank"] for p in "ABC"] == [1, 2, 1]
    for r in rows.values():
        assert r["total_revenue"] - r["total_cost"] == pytest.approx(r["total_profit"])


def test_share_and_rank_are_taken_before_top_n(sales):
    rows = run(sales, top_n=2).collect()
    assert [r["product"] for r in rows] == ["B", "A"]
    assert sum(r["market_share"] for r in rows) < 100
    report = P.product_report(run(sales, top_n=2)).first()
    assert report["total_products"] == 2 and report["total_revenue"] == 500.0


def test_metrics_are_checked(sales):
    with pytest.raises(ValueError):
        run(sales, metrics=["velocity"])
    only = run(sales, metrics=["revenue", "market_share"])
    assert "total_cost" not in only.columns and "total_profit" not in only.columns


def test_trends_skip_unobserved_periods(sales):
    rows = P.product_trends(sales, "product", "revenue", "quantity", "date", "M")
    got = {(r["product"], r["period"]): r["revenue_growth"] for r in rows.collect()}
    assert got == {("A", "2026-01"): None, ("B", "2026-02"): None, ("B", "2026-03"): -100.0, ("C", "2026-03"): None}


def test_empty(sales):
    assert run(sales.limit(0)).count() == 0
