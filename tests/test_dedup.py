import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import dedup as D
from ledgerlens.plans import groups


@pytest.fixture(scope="module")
def rows(spark):
    data = [
        (1, 1, "a@x", 85), (2, 2, "b@x", 90), (3, 2, "b@x", 95), (4, 3, "c@x", 70),
        (5, 3, "c@y", 75), (6, 4, None, None), (7, 5, "e@x", 60), (8, None, None, 1), (9, None, None, 2),
    ]
    return spark.createDataFrame(data, "n int, user_id int, email string, score int")


def numbers(df):
    return sorted(r["n"] for r in df.collect())


def test_keep(rows):
    def kept(keep):
        return numbers(D.drop_duplicates(rows, ["user_id"], keep, ["n"]))

    assert kept("first") == [1, 2, 4, 6, 7, 8]
    assert kept("last") == [1, 3, 5, 6, 7, 9]
    assert kept(False) == [1, 6, 7]
    once = D.drop_duplicates(rows, ["user_id"], "first", ["n"])
    assert numbers(D.drop_duplicates(once, ["user_id"], "first", ["n"])) == kept("first")
    with pytest.raises(ValueError):
        D.drop_duplicates(rows, ["user_id"], "middle")


def test_unknown_columns_are_ignored(rows):
    assert D.drop_duplicates(rows, ["nothing"]).count() == 9


@pytest.fixture(params=[False, True], ids=["window", "split"])
def split(request, monkeypatch):
    """The plan for groups larger than a task, with every group of two a hot one."""
    if request.param:
        monkeypatch.setattr(D, "fits_one_task", lambda *a: False)
        monkeypatch.setattr(D, "COPIES", 2)
        monkeypatch.setattr(
            D, "attach", lambda df, s, keys, **k: groups.attach(df, s, keys, small=False, hot_rows=1)
        )


@pytest.mark.parametrize("keep,want", [("first", [3, 5, 9]), ("last", [2, 4, 8]), (False, [2, 3, 4, 5, 8, 9])])
def test_mark_and_find(rows, split, keep, want):
    marked = D.mark_duplicates(rows, ["user_id"], keep, ["n"])
    assert numbers(marked.filter("_is_duplicate")) == want and marked.count() == 9
    assert numbers(D.find_duplicates(rows, ["user_id"], keep, ["n"])) == want


@pytest.mark.parametrize("subset", [None, ["a"]])
def test_identical_rows(spark, split, subset):
    df = spark.createDataFrame([(1, "x")] * 7 + [(2, "y"), (None, None), (None, None)], "a int, b string")
    marked = D.mark_duplicates(df, subset)
    assert marked.count() == 10 and marked.filter("_is_duplicate").count() == 7
    assert marked.filter("not _is_duplicate").distinct().count() == 3
    assert D.find_duplicates(df, subset, "last").count() == 7
    assert D.find_duplicates(df, subset, with_group=True).filter("group_rows = 7").count() == 7
    assert D.drop_duplicates(df, subset).count() == 3


def test_groups_and_report(rows):
    got = {r["user_id"]: (r["group_rows"], r["first_n"], r["last_n"]) for r in D.duplicate_groups(rows, ["user_id"], ["n"]).collect()}
    assert got == {2: (2, 2, 3), 3: (2, 4, 5), None: (2, 8, 9)}
    report = D.duplicate_report(rows, ["user_id"]).first()
    assert (report["duplicates_found"], report["duplicate_groups"], report["duplicates_removed"]) == (6, 3, 3)
    assert report["retention_rate"] == pytest.approx(100 * 6 / 9)
    assert D.duplicate_report(rows, ["user_id"], False).first()["duplicates_removed"] == 6


def test_priority(rows):
    best = {r["user_id"]: r["score"] for r in D.drop_by_priority(rows, ["user_id"], "score", "max", ["n"]).collect()}
    assert best == {1: 85, 2: 95, 3: 75, 4: None, 5: 60, None: 2}
    least = {r["user_id"]: r["score"] for r in D.drop_by_priority(rows, ["user_id"], "score", "min", ["n"]).collect()}
    assert least[2] == 90 and least[4] is None
    tied = rows.withColumn("score", F.when(F.col("user_id") == 2, 1).otherwise(F.col("score")))
    assert 2 in numbers(D.drop_by_priority(tied, ["user_id"], "score", "max", ["n"]))


def test_names_with_dots_and_backticks(spark):
    df = spark.createDataFrame([(1, "x", 1.0), (1, "x", 2.0), (2, "y", 3.0)], "`a.b` int, `c``d` string, `v.w` double")
    assert D.drop_duplicates(df, ["a.b"], "first", ["v.w"]).columns == df.columns
    assert sorted(tuple(r) for r in D.drop_duplicates(df, ["a.b"], "last", ["v.w"]).collect()) == [(1, "x", 2.0), (2, "y", 3.0)]
    assert [r["_is_duplicate"] for r in D.mark_duplicates(df, ["a.b"], "first", ["v.w"]).orderBy("`v.w`").collect()] == [False, True, False]
    assert D.find_duplicates(df, ["a.b", "c`d"]).count() == 2
    assert D.duplicate_groups(df, ["a.b"], ["v.w"]).columns == ["a.b", "group_rows", "first_v.w", "last_v.w"]
    assert D.duplicate_report(df, ["a.b"]).first()["duplicates_found"] == 2
    best = D.drop_by_priority(df, ["a.b"], "v.w").orderBy("`a.b`").collect()
    assert [tuple(r) for r in best] == [(1, "x", 2.0), (2, "y", 3.0)]
