import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import cleaning as C, conversion as V, outliers as O


@pytest.fixture(scope="module")
def people(spark):
    rows = [
        (1, "Ann", 25.0, 50.0, "IT"), (2, " Bob ", None, 60.0, "HR"), (3, "Cy", 30.0, None, None),
        (4, None, 35.0, 80.0, "IT"), (5, "Eve", None, 90.0, "HR"), (6, "Fay", 40.0, None, "IT"),
    ]
    return spark.createDataFrame(rows, "id int, name string, age double, salary double, department string")


def column(df, name):
    return [r[name] for r in df.orderBy("id").collect()]


def test_fills(people):
    def fill(strategy, c="age", **kw):
        return column(C.fill_nulls(people, [c], strategy, **kw), c)

    assert fill("fill_mean") == [25, 32.5, 30, 35, 32.5, 40]
    assert fill("fill_median") == [25, 32.5, 30, 35, 32.5, 40]
    assert fill("fill_mode", "department")[2] == "IT"
    assert fill("fill_forward", order_by=["id"]) == [25, 25, 30, 35, 35, 40]
    assert fill("fill_backward", order_by=["id"]) == [25, 30, 30, 35, 40, 40]
    assert fill("fill_interpolate", order_by=["id"]) == [25, 27.5, 30, 35, 37.5, 40]
    assert fill("fill_zero")[1] == 0
    assert fill("fill_constant", fill_value=7.0)[1] == 7
    assert fill("fill_mean", "name") == column(people, "name")
    with pytest.raises(ValueError):
        C.fill_nulls(people, ["age"], "fill_forward")
    with pytest.raises(ValueError):
        C.fill_nulls(people, ["age"], "guess")


def test_mode_takes_the_smallest_of_several(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, None)], "id int, x string")
    assert column(C.fill_nulls(df, ["x"], "fill_mode"), "x") == ["b", "a", "a"]


def test_drop_uses_the_threshold(people):
    out = C.drop_nulls(people.withColumn("age", F.when(F.col("id") < 3, F.col("age"))), 0.5)
    assert "age" not in out.columns and out.count() == 3


def test_pipeline(spark):
    rows = [(1, " a\t", 1.0, None), (1, "a", 1.0, None), (2, "b", None, None), (None, None, None, None)]
    df = spark.createDataFrame(rows, "` Id` int, `The Name!` string, v double, empty string")
    out = C.clean_data(df, order_by=["id"])
    assert out.columns == ["id", "the_name", "v"]
    assert [tuple(r) for r in out.collect()] == [(1, "a", 1.0)]
    report = C.cleaning_report(df, out).first()
    assert (report["rows_before"], report["rows_after"], report["columns_removed"]) == (4, 1, 1)
    assert report["data_quality_score"] == 100.0 and "half" in report["warnings"]
    again = C.clean_data(out, order_by=["id"])
    assert again.collect() == out.collect()


def test_column_strategies(people):
    out = C.handle_nulls(people, "keep", column_strategies={"age": "fill_zero", "nothing": "fill_zero"})
    assert column(out, "age")[1] == 0 and column(out, "salary")[2] is None


def test_modes_of_many_columns_at_once(spark, monkeypatch):
    rows = [("b", 2, 1.0), ("a", 2, None), (None, None, 1.0), ("a", 1, 3.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "s string, n int, f double")
    for at_once in (32, 2):
        monkeypatch.setattr(C, "MODES", at_once)
        out = C.fill_nulls(df, ["s", "n", "f"], "fill_mode").collect()
        assert tuple(out[2]) == ("a", 1, 1.0) and [r["f"] for r in out] == [1.0, 1.0, 1.0, 3.0, 1.0]
    empty = C.fill_nulls(df.withColumn("e", F.lit(None).cast("int")), ["e"], "fill_mode")
    assert [r["e"] for r in empty.collect()] == [None] * 5


def test_names_with_dots(spark):
    df = spark.createDataFrame([(" a ", 1, None), (None, None, None)], "`x.y` string, `n.` int, `e.f` double")
    out = C.process_upload(df)
    assert out.columns == ["xy", "n"] and [tuple(r) for r in out.collect()] == [("a", 1)]
    assert C.drop_empty_rows(spark.createDataFrame([(float("nan"),), (1.0,)], "`a.b` double")).count() == 1


def test_cleaning_that_leaves_nothing_is_an_error(spark):
    df = spark.createDataFrame([(1, None), (None, 2)], "a int, b int")
    with pytest.raises(ValueError):
        C.clean_data(df, null_strategy="drop", null_threshold=0.9)
    assert C.clean_data(df, null_strategy="drop", null_threshold=0.9, validate=False).count() == 0


def test_name_collisions_raise(spark):
    df = spark.createDataFrame([(1, 2)], "`a b` int, `A_b` int")
    with pytest.raises(ValueError):
        C.standardize_names(df)
    with pytest.raises(ValueError):
        C.validate_cleaned(df.limit(0))


def test_conversion(spark):
    df = spark.createDataFrame(
        [("1", "2.5", "yes", "2024-01-31"), ("x", "", "nope", "31.01.2024"), (None, "1e3", "FALSE", "2024-13-01")],
        "i string, f string, b string, d string",
    )
    mapping = {"i": "int", "f": "float", "b": "bool", "d": "datetime"}
    rows = V.convert_types(df, mapping).collect()
    assert [r["i"] for r in rows] == [1, None, None]
    assert [r["f"] for r in rows] == [2.5, None, 1000.0]
    assert [r["b"] for r in rows] == [True, None, False]
    assert [str(r["d"])[:10] for r in rows] == ["2024-01-31", "2024-01-31", "None"]
    report = {r["column_name"]: (r["converted"], r["failed"]) for r in V.conversion_report(df, mapping).collect()}
    assert report == {"i": (1, 1), "f": (2, 1), "b": (2, 1), "d": (2, 1)}
    with pytest.raises(Exception):
        V.convert_types(df, {"i": "int"}, errors="raise").collect()
    with pytest.raises(ValueError):
        V.convert_types(df, {"i": "money"})


def test_detection(spark):
    rows = [(str(i), f"2024-01-{i + 1:02d}", f"w{i}") for i in range(20)]
    df = spark.createDataFrame(rows, "n string, d string, w string")
    assert V.detect_types(df) == {"n": "float", "d": "datetime"}


def test_standardise(spark):
    df = spark.createDataFrame(
        [("01/31/2024", "$1,234.50", "+1 (555) 12-34", " Me@X.com ", "y"), ("soon", "abc", "", "none", "n")],
        "`Order  Date` string, Total string, Phone string, EMail string, Flag string",
    )
    out = V.standardize(
        df, column_mapping={"flag": "Is Open"}, date_columns=["order_date"], date_format="yyyy-MM-dd",
        currency_columns=["total"], phone_columns=["phone"], email_columns=["email"],
        categorical_mappings={"is_open": {"y": "yes"}},
    )
    assert out.columns == ["order_date", "total", "phone", "email", "is_open"]
    assert [tuple(r) for r in out.collect()] == [
        ("2024-01-31", 1234.5, "15551234", "me@x.com", "yes"), (None, None, "", "none", "n"),
    ]
    row = V.expected_columns(out, ["total", "tax"]).first()
    assert (row["missing"], row["match_percentage"]) == ("tax", 50.0)
    with pytest.raises(ValueError):
        V.expected_columns(out, ["tax"], strict=True)


def test_large_mapping_becomes_a_join(spark):
    df = spark.range(400).selectExpr("cast(id as string) as k")
    out = V.map_values(df, "k", {str(i): f"v{i}" for i in range(300)})
    assert out.filter("k like 'v%'").count() == 300 and out.count() == 400


def test_outliers_and_scaling(spark):
    df = spark.createDataFrame([(float(v), 3.0) for v in (10, 12, 11, 13, 12, 11, 10, 100)] + [(None, 3.0)], "v double, c double")
    assert O.remove_outliers(df, ["v"]).count() == 8
    assert O.remove_outliers(df, ["v"], "zscore", 2.0).count() == 8
    report = O.outlier_report(df).collect()
    assert {r["column_name"]: r["outliers"] for r in report} == {"v": 1, "c": 0}
    scaled = O.normalize(df, method="minmax").agg(F.min("v"), F.max("v"), F.max("c")).first()
    assert tuple(scaled) == (0.0, 1.0, 3.0)
    z = O.normalize(df, ["v"], "zscore").agg(F.avg("v"), F.stddev_samp("v")).first()
    assert z[0] == pytest.approx(0, abs=1e-12) and z[1] == pytest.approx(1)
    assert O.normalize(df, ["v"], "robust").agg(F.median("v")).first()[0] == 0.0
    with pytest.raises(ValueError):
        O.normalize(df, method="softmax")
