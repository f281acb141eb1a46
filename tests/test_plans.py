"""The split plans give what the plain windows give, also with one hot group."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerlens.plans import ordered
from ledgerlens.plans.calendar import dense
from ledgerlens.plans.groups import ROWS, attach, with_totals
from ledgerlens.plans.ordered import fill_ordered, moving, positions, running_sum
from ledgerlens.plans.quantiles import quantiles
from ledgerlens.plans.ranks import dense_ranks


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(7)
    data = []
    for i in range(3000):
        g = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", "c", None])
        v = None if rnd.random() < 0.3 else rnd.randint(0, 400)
        data.append((i, g, v))
    rnd.shuffle(data)
    return spark.createDataFrame(data, "id long, g string, v long").repartition(5)


def pairs(df, *cols):
    return sorted(map(tuple, df.select(*cols).collect()), key=str)


@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_sum(rows, by):
    kw = dict(order_by=["id"], partition_by=by)
    a = running_sum(rows, "v", "s", split=False, **kw)
    b = running_sum(rows, "v", "s", split=True, **kw)
    assert pairs(a, "id", "s") == pairs(b, "id", "s")


def test_slices_grow_with_the_rows(rows, monkeypatch):
    monkeypatch.setattr(ordered, "TASK_ROWS", 100)
    sizes = ordered.sliced(rows, ["g"], ["id"]).groupBy(ordered.SLICE).count().collect()
    assert len(sizes) > 30 and max(r["count"] for r in sizes) <= 100


@pytest.mark.parametrize("by", [[], ["g"]])
def test_positions(rows, by):
    kw = dict(order_by=["id"], partition_by=by)
    a = positions(rows, "p", split=False, **kw)
    b = positions(rows, "p", split=True, **kw)
    assert pairs(a, "id", "p") == pairs(b, "id", "p")


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("before,after", [(6, 0), (3, 3), (4, 3), (0, 5), (0, 0)])
def test_moving(rows, by, before, after):
    cols = {"m": lambda w: F.sum("v").over(w), "n": lambda w: F.count("v").over(w)}
    kw = dict(order_by=["id"], partition_by=by)
    a = moving(rows, cols, before, after, split=False, **kw)
    b = moving(rows, cols, before, after, split=True, block=37, **kw)
    assert pairs(a, "id", "m", "n") == pairs(b, "id", "m", "n")


@pytest.mark.parametrize("how", ["forward", "backward", "interpolate"])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_fills(rows, how, by):
    kw = dict(order_by=["id"], partition_by=by)
    a = fill_ordered(rows, "v", how, split=False, **kw)
    b = fill_ordered(rows, "v", how, split=True, **kw)
    assert pairs(a, "id", "v") == pairs(b, "id", "v")
    pdf = rows.toPandas().sort_values("id")
    pdf["v"] = pdf["v"].astype(float)

    def fill(s):
        return {"forward": s.ffill, "backward": s.bfill, "interpolate": s.interpolate}[how]()

    want = pdf.groupby("g", dropna=False)["v"].transform(fill) if by else fill(pdf["v"])
    got = a.orderBy("id").toPandas()["v"].astype(float)
    assert got.isna().tolist() == want.isna().tolist()
    assert (got.fillna(-1).values - want.fillna(-1).values).max() < 1e-9


@pytest.mark.parametrize("by", [[], ["g"]])
def test_quantiles(rows, by):
    wanted = {"q1": ("v", 0.25), "med": ("v", 0.5), "q9": ("v", 0.9), "im": ("id", 0.5), "lo": ("id", 0.0)}
    a = quantiles(rows, wanted, by, plan="small")
    for plan in ("bracket", "split"):
        b = quantiles(rows, wanted, by, plan=plan)
        assert a.columns == b.columns
        assert pairs(a, "*") == pairs(b, "*")


def test_quantiles_many_values(spark):
    df = spark.range(200_000).select((F.pow(F.rand(3), 5) * 1e6).alias("v"), (F.col("id") % 3).alias("g"))
    df = df.union(spark.range(100_000).select(F.lit(7.0).alias("v"), F.lit(1).cast("long").alias("g")))
    df = df.unionByName(spark.range(3).select(F.col("id").cast("double").alias("v"), F.lit(9).cast("long").alias("g")))
    wanted = {f"p{i}": ("v", p) for i, p in enumerate((0.0, 0.001, 0.25, 0.251, 0.5, 0.75, 0.999, 1.0))}
    for by in ([], ["g"]):
        assert pairs(quantiles(df, wanted, by, plan="small"), "*") == pairs(
            quantiles(df, wanted, by, plan="bracket"), "*"
        )


def test_dense_ranks(rows):
    a = dense_ranks(rows, {"r": "v", "s": "id"}, split=False)
    b = dense_ranks(rows, {"r": "v", "s": "id"}, split=True)
    assert pairs(a, "id", "r", "s") == pairs(b, "id", "r", "s")


def test_attach_hot_group(rows):
    stats = rows.groupBy("g").agg(F.count(F.lit(1)).alias(ROWS), F.sum("v").alias("s"))
    small = attach(rows, stats, ["g"], small=True)
    split = attach(rows, stats, ["g"], small=False, hot_rows=800)
    assert pairs(small, "id", "s", ROWS) == pairs(split, "id", "s", ROWS)
    assert rows.count() == split.count()


def test_totals_are_scalar_subqueries(rows):
    out = with_totals(rows, rows, m=F.max("v"), n=F.count("v"))
    assert out.select("m").distinct().count() == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_dense_calendar(spark):
    df = spark.createDataFrame(
        [("2024-01-31", 1), ("2024-04-30", 2)], "d string, n long"
    ).select(F.date_trunc("month", F.col("d").cast("date")).cast("date").alias("d"), "n")
    got = [tuple(map(str, r)) for r in dense(df, "d", "M", ["n"]).orderBy("d").collect()]
    assert got == [("2024-01-01", "1"), ("2024-02-01", "0"), ("2024-03-01", "0"), ("2024-04-01", "2")]
