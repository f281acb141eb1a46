"""Retention of customers over orders (months, quarters) and of users over events (weeks, days)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import retention as R
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import events, table

N = 12


def buyers(spark, d):
    return R.activity(table(spark, d, "orders"), "o_custkey", "o_orderdate")


def users(spark, d):
    return R.activity(events(spark, d), "user_id", "ts")


BUYERS = "log AS (SELECT o_custkey AS u, o_orderdate AS ts FROM orders)"
USERS = "log AS (SELECT user_id AS u, ts FROM events)"


def cohort_sql(log: str, unit: str, diff: str, label: str, n: int, having: str = "") -> str:
    cells = ", ".join(
        f"MAX(CASE WHEN k = {k} THEN a END) / MAX(CASE WHEN k = 0 THEN a END) * 100.0 AS Period_{k}"
        for k in range(n + 1)
    )
    return f"""
WITH {log}, pairs AS (
  SELECT u, date_trunc('{unit}', ts) AS p FROM log GROUP BY 1, 2 {having}
), c AS (
  SELECT u, p, MIN(p) OVER (PARTITION BY u) AS c FROM pairs
), counts AS (
  SELECT c, {diff} AS k, CAST(COUNT(DISTINCT u) AS DOUBLE) AS a FROM c GROUP BY 1, 2
), matrix AS (
  SELECT {label} AS cohort_period, CAST(MAX(CASE WHEN k = 0 THEN a END) AS BIGINT) AS cohort_size, {cells}
  FROM counts WHERE k <= {n} GROUP BY c
)
"""


MONTHS = cohort_sql(BUYERS, "month", "date_diff('month', c, p)", "strftime(c, '%Y-%m')", N)


@query("retention_cohort_month", MONTHS + "SELECT * FROM matrix")
def retention_cohort_month(spark, d):
    return R.cohort_retention(buyers(spark, d), "M", N)


@query(
    "retention_cohort_quarter",
    cohort_sql(
        BUYERS, "quarter", "date_diff('quarter', c, p)",
        "strftime(c, '%Y') || 'Q' || CAST(quarter(c) AS VARCHAR)", 8,
    ) + "SELECT * EXCLUDE (cohort_size) FROM matrix",
)
def retention_cohort_quarter(spark, d):
    return R.cohort_retention(buyers(spark, d), "Q", 8, include_cohort_size=False)


WEEK_LABEL = "strftime(c, '%Y-%m-%d') || '/' || strftime(c + INTERVAL 6 DAY, '%Y-%m-%d')"


@query(
    "retention_cohort_week_active",
    cohort_sql(USERS, "week", "date_diff('week', c, p)", WEEK_LABEL, 4, "HAVING COUNT(*) >= 12")
    + "SELECT * FROM matrix",
)
def retention_cohort_week_active(spark, d):
    """A user counts in a week with at least twelve events."""
    return R.cohort_retention(users(spark, d), "W", 4, min_activity=12)


@query(
    "retention_cohort_purchases",
    cohort_sql(
        "log AS (SELECT user_id AS u, ts FROM events WHERE event_type = 'purchase')",
        "week", "date_diff('week', c, p)", WEEK_LABEL, 4,
    ) + "SELECT * FROM matrix",
)
def retention_cohort_purchases(spark, d):
    log = R.activity(events(spark, d), "user_id", "ts", "event_type", ["purchase"])
    return R.cohort_retention(log, "W", 4)


def simple_sql(log: str, unit: str, label: str) -> str:
    return f"""
WITH {log}, pairs AS (SELECT DISTINCT u, date_trunc('{unit}', ts) AS p FROM log),
idx AS (SELECT p, row_number() OVER (ORDER BY p) AS i FROM (SELECT DISTINCT p FROM pairs)),
n AS (SELECT u, p, i FROM pairs JOIN idx USING (p))
SELECT {label} AS period, COUNT(*) AS users, COUNT(b.u) AS retained_users,
       CAST(COUNT(b.u) AS DOUBLE) / COUNT(*) * 100.0 AS retention_rate
FROM n a LEFT JOIN n b ON a.u = b.u AND b.i = a.i + 1
WHERE a.i < (SELECT MAX(i) FROM idx) GROUP BY a.p
"""


@query("retention_simple_month", simple_sql(BUYERS, "month", "strftime(a.p, '%Y-%m')"))
def retention_simple_month(spark, d):
    return R.simple_retention(buyers(spark, d), "M")


@query("retention_simple_day", simple_sql(USERS, "day", "strftime(a.p, '%Y-%m-%d')"))
def retention_simple_day(spark, d):
    return R.simple_retention(users(spark, d), "D")


@query(
    "retention_rolling",
    f"""
WITH {BUYERS}, pairs AS (SELECT DISTINCT u, date_trunc('month', ts) AS p FROM log),
idx AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT p FROM pairs)),
n AS (SELECT u, p, i FROM pairs JOIN idx USING (p)),
size AS (SELECT i, p, COUNT(*) AS users FROM n GROUP BY 1, 2),
grid AS (
  SELECT s.i, s.p, s.users, t.i - s.i AS k, t.p AS q FROM size s JOIN idx t ON t.i BETWEEN s.i AND s.i + 6
  WHERE s.i + 6 <= (SELECT COUNT(*) FROM idx)
),
kept AS (SELECT a.i, b.i - a.i AS k, COUNT(*) AS kept FROM n a JOIN n b ON a.u = b.u
         AND b.i BETWEEN a.i AND a.i + 6 GROUP BY 1, 2)
SELECT strftime(p, '%Y-%m') AS start_period, CAST(g.k AS INTEGER) AS offset, strftime(q, '%Y-%m') AS target_period,
       COALESCE(kept, 0) / CAST(users AS DOUBLE) * 100.0 AS retention_rate
FROM grid g LEFT JOIN kept ON kept.i = g.i AND kept.k = g.k
""",
)
def retention_rolling(spark, d):
    return R.rolling_retention(buyers(spark, d), "M", 6)


def nday_sql(days: list[int], cohort: str) -> str:
    cells = ", ".join(
        f"CAST(COUNT(DISTINCT CASE WHEN k = {k} THEN u END) AS DOUBLE) / COUNT(DISTINCT u) * 100.0 AS Day_{k}"
        for k in days
    )
    return f"""
WITH {USERS}, f AS (SELECT u, ts, MIN(ts) OVER (PARTITION BY u) AS f FROM log),
k AS (SELECT u, f, CAST(floor((epoch_us(ts) - epoch_us(f)) / 86400000000.0) AS BIGINT) AS k FROM f)
SELECT {cohort} AS cohort_date, COUNT(DISTINCT u) AS cohort_size, {cells} FROM k GROUP BY 1
"""


@query("retention_nday", nday_sql([1, 3, 7, 14, 28], "CAST(f AS DATE)"))
def retention_nday(spark, d):
    return R.nday_retention(users(spark, d), 28)


@query("retention_nday_exact", nday_sql([1, 3, 7, 10], "f"))
def retention_nday_exact(spark, d):
    return R.nday_retention(users(spark, d), 10, exact=True)


def _busy_cells(days: list[int], least: int) -> str:
    return ", ".join(f"CAST(COUNT(DISTINCT CASE WHEN k = {k} AND n >= {least} THEN u END) AS DOUBLE) / COUNT(DISTINCT u) * 100.0 AS Day_{k}" for k in days)


@query(
    "retention_nday_busy",
    f"""
WITH {USERS}, f AS (SELECT u, ts, MIN(ts) OVER (PARTITION BY u) AS f FROM log),
k AS (SELECT u, f, CAST(floor((epoch_us(ts) - epoch_us(f)) / 86400000000.0) AS BIGINT) AS k, COUNT(*) AS n FROM f GROUP BY ALL)
SELECT CAST(f AS DATE) AS cohort_date, COUNT(DISTINCT u) AS cohort_size, {_busy_cells([1, 3, 7, 14, 28], 2)} FROM k GROUP BY 1""",
)
def retention_nday_busy(spark, d):
    """Users with two events or more in the k-th 24 hours, through the dispatcher of all methods."""
    rows = users(spark, d).select(F.col("user").alias("user_id"), F.col("ts").alias("date"))
    return R.calculate_retention(rows, method="n_day", retention_periods=28, min_activity_threshold=2, round_decimals=None)


LONG = ", long AS (UNPIVOT matrix ON COLUMNS('Period_') INTO NAME k VALUE rate)"


@query(
    "retention_rate",
    MONTHS + LONG + " SELECT ROUND(AVG(m), 6) AS retention_rate FROM (SELECT AVG(rate) AS m FROM long GROUP BY k)",
)
def retention_rate(spark, d):
    rate = R.retention_rate(R.cohort_retention(buyers(spark, d), "M", N))
    return rate.select(F.round("retention_rate", 6).alias("retention_rate"))


@query(
    "retention_report",
    MONTHS + LONG + """
SELECT 'cohort' AS method, (SELECT COUNT(DISTINCT u) FROM log) AS total_users,
       (SELECT COUNT(*) FROM log) AS total_records, (SELECT CAST(MIN(ts) AS DATE) FROM log) AS start_date,
       (SELECT CAST(MAX(ts) AS DATE) FROM log) AS end_date, (SELECT COUNT(*) FROM matrix) AS cohort_count,
       ROUND(AVG(rate), 4) AS average_retention, ROUND(median(rate), 4) AS median_retention,
       ROUND(MIN(rate), 4) AS min_retention, ROUND(MAX(rate), 4) AS max_retention,
       ROUND(stddev_pop(rate), 4) AS std_retention FROM long""",
)
def retention_report(spark, d):
    log = buyers(spark, d)
    report = R.retention_report(R.cohort_retention(log, "M", N), log, "cohort")
    return report.withColumns(
        {c: F.round(c, 4) for c in report.columns if c.endswith("_retention")}
    )


@query(
    "retention_best_cohort",
    MONTHS + LONG + """
SELECT cohort_period, ROUND(AVG(rate), 6) AS mean_retention FROM long WHERE k <> 'Period_0'
GROUP BY cohort_period ORDER BY AVG(rate) DESC, cohort_period LIMIT 1""",
)
def retention_best_cohort(spark, d):
    best = R.best_cohort(R.cohort_retention(buyers(spark, d), "M", N))
    return best.withColumn("mean_retention", F.round("mean_retention", 6))


@query(
    "retention_heatmap",
    MONTHS + LONG + " SELECT cohort_period, k AS offset, rate FROM long",
)
def retention_heatmap(spark, d):
    return R.retention_long(R.cohort_retention(buyers(spark, d), "M", N), "cohort_period")
