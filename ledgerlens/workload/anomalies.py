"""Anomalies of the daily order value, of order values by priority, and of event values."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.operators import anomalies as A
from ledgerlens.plans.calendar import MAX_PERIODS
from ledgerlens.workload.registry import query
from ledgerlens.workload.views import DAILY, GAPPY, daily, gappy_events, table

DAYS = MAX_PERIODS // 2  # a daily series is bounded by the calendar

SERIES = "WITH" + DAILY + ", s AS (SELECT date, CAST(value AS DOUBLE) AS value FROM daily)"
SCORED = """
SELECT date, value, COALESCE(f, false) AS is_anomaly, ROUND(score, 4) AS anomaly_score,
       ROUND(hi, 4) AS upper_bound, ROUND(lo, 4) AS lower_bound FROM r
"""


def detect(spark, d, method, threshold, **options):
    series = daily(spark, d).withColumn("value", F.col("value").cast("double"))
    return A.detect_anomalies(
        series, "value", "date", method, threshold, max_group_rows=DAYS, **options
    )


ZSCORE = SERIES + """
, r AS (
  SELECT date, value, abs((value - m) / sd) AS score, abs((value - m) / sd) > {t} AS f,
         m + {t} * sd AS hi, m - {t} * sd AS lo
  FROM s, (SELECT AVG(value) AS m, {std}(value) AS sd FROM s)
)"""


@query("anomaly_zscore", ZSCORE.format(t=2.0, std="stddev_pop") + SCORED)
def anomaly_zscore(spark, d):
    return detect(spark, d, "zscore", 2.0)


@query("anomaly_service_zscore", ZSCORE.format(t=2.0, std="stddev_samp") + SCORED)
def anomaly_service_zscore(spark, d):
    return detect(spark, d, "zscore", 2.0, service=True)


IQR = SERIES + """
, q AS (SELECT quantile_cont(value, 0.25) AS q1, median(value) AS q2, quantile_cont(value, 0.75) AS q3 FROM s),
b AS (SELECT q1, q2, q3, q1 - {t} * (q3 - q1) AS lo, q3 + {t} * (q3 - q1) AS hi FROM q),
r AS (SELECT date, value, lo, hi, value < lo OR value > hi AS f, {score} AS score FROM s, b)"""


@query("anomaly_iqr", IQR.format(t=1.5, score="least(abs(value - lo), abs(value - hi))") + SCORED)
def anomaly_iqr(spark, d):
    return detect(spark, d, "iqr", 1.5)


@query("anomaly_service_iqr", IQR.format(t=1.5, score="abs((value - q2) / (q3 - q1))") + SCORED)
def anomaly_service_iqr(spark, d):
    return detect(spark, d, "iqr", 1.5, service=True)


MAD = SERIES + """
, m AS (SELECT median(value) AS med, mad(value) AS mad FROM s),
r AS (
  SELECT date, value, abs(0.6745 * (value - med) / mad) AS score,
         abs(0.6745 * (value - med) / mad) > 3.0 AS f,
         med + 3.0 * mad / 0.6745 AS hi, med - 3.0 * mad / 0.6745 AS lo
  FROM s, m
)"""


@query("anomaly_mad", MAD + SCORED)
def anomaly_mad(spark, d):
    return detect(spark, d, "mad", 3.0)


@query("anomaly_service_mad", MAD + SCORED)
def anomaly_service_mad(spark, d):
    return detect(spark, d, "mad", 3.0, service=True)


MOVING = SERIES + """
, w AS (
  SELECT date, value, COUNT(*) OVER w AS n, AVG(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM s
  WINDOW w AS (ORDER BY date ROWS BETWEEN {b} PRECEDING AND {a} FOLLOWING)
), r AS (
  SELECT date, value, CASE WHEN n = {n} THEN abs((value - m) / sd) END AS score,
         CASE WHEN n = {n} THEN m + {t} * sd END AS hi, CASE WHEN n = {n} THEN m - {t} * sd END AS lo,
         value > hi OR value < lo AS f
  FROM w
)"""


@query("anomaly_moving_avg", MOVING.format(b=3, a=3, n=7, t=2.0) + SCORED)
def anomaly_moving_avg(spark, d):
    return detect(spark, d, "moving_avg", 2.0)


@query("anomaly_service_moving_avg", MOVING.format(b=3, a=3, n=7, t=2.0) + SCORED)
def anomaly_service_moving_avg(spark, d):
    return detect(spark, d, "moving_avg", 2.0, service=True)


@query("anomaly_moving_avg_even", MOVING.format(b=5, a=4, n=10, t=2.0) + SCORED)
def anomaly_moving_avg_even(spark, d):
    return detect(spark, d, "moving_avg", 2.0, window_size=10)


SEASONAL = """
, w AS (
  SELECT {g} date, value, row_number() OVER (PARTITION BY {p} ORDER BY date) - 1 AS pos,
         COUNT(*) OVER w AS n, SUM(value) OVER w AS s, first_value(value) OVER w AS a, last_value(value) OVER w AS z
  FROM s WINDOW w AS (PARTITION BY {p} ORDER BY date ROWS BETWEEN {h} PRECEDING AND {h} FOLLOWING)
), t AS (
  SELECT *, CASE WHEN n = 2 * {h} + 1 THEN (s - {ends}) / {m} END AS trend, pos % {m} AS phase FROM w
), ph AS (SELECT {g} phase, AVG(value - trend) AS pm FROM t GROUP BY {g} phase),
c AS (SELECT {g} phase, pm - AVG(pm) OVER (PARTITION BY {p}) AS season FROM ph),
e AS (SELECT t.*, season, value - trend - season AS resid FROM t JOIN c USING ({g} phase)),
z AS (SELECT *, AVG(resid) OVER (PARTITION BY {p}) AS rm, stddev_pop(resid) OVER (PARTITION BY {p}) AS rs FROM e),
r AS (
  SELECT {g} date, value, abs((resid - rm) / rs) AS score, abs((resid - rm) / rs) > {t} AS f,
         trend + season + rm + {t} * rs AS hi, trend + season + rm - {t} * rs AS lo
  FROM z
)"""


@query(
    "anomaly_seasonal",
    SERIES + SEASONAL.format(g="", p="1", h=3, m=7, ends="0", t=3.0) + SCORED,
)
def anomaly_seasonal(spark, d):
    return detect(spark, d, "seasonal", 3.0)


@query(
    "anomaly_seasonal_even",
    SERIES + SEASONAL.format(g="", p="1", h=15, m=30, ends="(a + z) / 2", t=3.0) + SCORED,
)
def anomaly_seasonal_even(spark, d):
    return detect(spark, d, "seasonal", 3.0, seasonal_period=30)


def priority_days(spark, d):
    return (
        table(spark, d, "orders")
        .groupBy(F.col("o_orderpriority").alias("grp"), F.col("o_orderdate").cast("date").alias("date"))
        .agg(F.sum(F.col("o_totalprice").cast("decimal(14,2)")).cast("double").alias("value"))
    )


PRIORITY = """
WITH s AS (
  SELECT o_orderpriority AS grp, CAST(o_orderdate AS DATE) AS date,
         CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2
)"""


@query(
    "anomaly_grouped_seasonal",
    PRIORITY + SEASONAL.format(g="grp,", p="grp", h=3, m=7, ends="0", t=3.0)
    + SCORED.replace("SELECT date", "SELECT grp, date"),
)
def anomaly_grouped_seasonal(spark, d):
    return A.detect_anomalies(
        priority_days(spark, d), "value", "date", "seasonal", 3.0, groupby_column="grp", max_group_rows=DAYS
    )


ORDERS = """
WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS grp, o_orderdate AS date, o_totalprice AS value FROM orders)
"""
KEYED = SCORED.replace("SELECT date", "SELECT id, grp, date")


def priced_orders(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("grp"),
        F.col("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("value"),
    )


@query(
    "anomaly_grouped_zscore",
    ORDERS + """
, r AS (
  SELECT id, grp, date, value, abs((value - m) / sd) AS score, abs((value - m) / sd) > 1.7 AS f,
         m + 1.7 * sd AS hi, m - 1.7 * sd AS lo
  FROM s JOIN (SELECT grp, AVG(value) AS m, stddev_pop(value) AS sd FROM s GROUP BY grp) USING (grp)
)""" + KEYED,
)
def anomaly_grouped_zscore(spark, d):
    return A.detect_anomalies(
        priced_orders(spark, d), "value", "date", "zscore", 1.7, groupby_column="grp",
        handle_missing_values="drop", order_by=["id"],
    )


@query(
    "anomaly_grouped_iqr",
    ORDERS + """
, b AS (
  SELECT grp, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY grp
), r AS (
  SELECT id, grp, date, value, q1 - 0.45 * (q3 - q1) AS lo, q3 + 0.45 * (q3 - q1) AS hi,
         value < lo OR value > hi AS f, least(abs(value - lo), abs(value - hi)) AS score
  FROM s JOIN b USING (grp)
)""" + KEYED.replace(", 4)", ", 6)"),
)
def anomaly_grouped_iqr(spark, d):
    return A.detect_anomalies(
        priced_orders(spark, d), "value", "date", "iqr", 0.45, groupby_column="grp",
        handle_missing_values="drop", order_by=["id"], round_decimals=6,
    )


@query(
    "anomaly_grouped_mad",
    ORDERS + """
, r AS (
  SELECT id, grp, date, value, abs(0.6745 * (value - med) / mad) AS score,
         abs(0.6745 * (value - med) / mad) > 1.3 AS f,
         med + 1.3 * mad / 0.6745 AS hi, med - 1.3 * mad / 0.6745 AS lo
  FROM s JOIN (SELECT grp, median(value) AS med, mad(value) AS mad FROM s GROUP BY grp) USING (grp)
)""" + KEYED,
)
def anomaly_grouped_mad(spark, d):
    return A.detect_anomalies(
        priced_orders(spark, d), "value", "date", "mad", 1.3, groupby_column="grp",
        handle_missing_values="drop", order_by=["id"],
    )


@query(
    "anomaly_grouped_moving_avg",
    ORDERS + """
, w AS (
  SELECT id, grp, date, value, COUNT(*) OVER w AS n, AVG(value) OVER w AS m, stddev_samp(value) OVER w AS sd FROM s
  WINDOW w AS (PARTITION BY grp ORDER BY date, id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
), r AS (
  SELECT id, grp, date, value, CASE WHEN n = 7 THEN abs((value - m) / sd) END AS score,
         CASE WHEN n = 7 THEN m + 2.0 * sd END AS hi, CASE WHEN n = 7 THEN m - 2.0 * sd END AS lo,
         value > hi OR value < lo AS f
  FROM w
)""" + KEYED,
)
def anomaly_grouped_moving_avg(spark, d):
    return A.detect_anomalies(
        priced_orders(spark, d), "value", "date", "moving_avg", 2.0, groupby_column="grp",
        handle_missing_values="drop", order_by=["id"],
    )


MISSING = """
WITH""" + GAPPY + """
, n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS pos FROM gappy),
k AS (
  SELECT *, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS pp,
         last_value(value IGNORE NULLS) OVER b AS pv,
         first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER f AS np,
         first_value(value IGNORE NULLS) OVER f AS nv
  FROM n WINDOW b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
                f AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), s AS (
  SELECT event_id, user_id, ts,
         CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
              ELSE (nv - pv) / (np - pp) * (pos - pp) + pv END AS v FROM k
), g AS (SELECT user_id, AVG(v) AS m, stddev_pop(v) AS sd FROM s WHERE v IS NOT NULL GROUP BY 1)
SELECT event_id, user_id, ROUND(abs((v - m) / sd), 4) AS anomaly_score, abs((v - m) / sd) > 2.0 AS is_anomaly
FROM s JOIN g USING (user_id) WHERE v IS NOT NULL
"""


@query("anomaly_missing_interpolated", MISSING)
def anomaly_missing_interpolated(spark, d):
    """Missing values are interpolated in time order within each user."""
    flagged = A.detect_anomalies(
        gappy_events(spark, d), "value", "ts", "zscore", 2.0, groupby_column="user_id"
    )
    return flagged.select("event_id", "user_id", "anomaly_score", "is_anomaly")


def _filled(how: str, fill: str) -> None:
    sql = "WITH" + GAPPY + f"""
, s AS (SELECT event_id, COALESCE(value, (SELECT {fill}(value) FROM gappy)) AS v FROM gappy),
g AS (SELECT AVG(v) AS m, stddev_pop(v) AS sd FROM s)
SELECT event_id, ROUND(abs((v - m) / sd), 4) AS anomaly_score, abs((v - m) / sd) > 3.0 AS is_anomaly FROM s, g"""

    @query(f"anomaly_missing_{how}", sql)
    def run(spark, d):
        flagged = A.detect_anomalies(
            gappy_events(spark, d), "value", "ts", "zscore", 3.0, handle_missing_values=how
        )
        return flagged.select("event_id", "anomaly_score", "is_anomaly")


_filled("fill_mean", "AVG")
_filled("fill_median", "MEDIAN")


@query(
    "anomaly_summary",
    ZSCORE.format(t=2.0, std="stddev_pop") + ", o AS (" + SCORED + """)
SELECT 'zscore' AS method, CAST(2.0 AS DOUBLE) AS threshold, COUNT(*) AS total_records,
       COUNT(*) FILTER (WHERE is_anomaly) AS total_anomalies,
       CAST(COUNT(*) FILTER (WHERE is_anomaly) AS DOUBLE) / COUNT(*) * 100.0 AS anomaly_rate,
       MIN(anomaly_score) AS score_min, MAX(anomaly_score) AS score_max,
       ROUND(AVG(anomaly_score), 4) AS score_mean, ROUND(median(anomaly_score), 4) AS score_median
FROM o""",
)
def anomaly_summary(spark, d):
    return A.anomaly_summary(detect(spark, d, "zscore", 2.0), "zscore", 2.0)


CLASSIFIED = ZSCORE.format(t=2.0, std="stddev_samp") + ", o AS (" + SCORED + """),
k AS (
  SELECT o.*, CASE WHEN value > mid THEN 'spike' ELSE 'drop' END AS type,
         CASE WHEN anomaly_score > 2.0 * 1.5 THEN 'critical' ELSE 'warning' END AS severity,
         ROUND((value - mid) / mid * 100.0, 1) AS deviation_pct
  FROM o, (SELECT median(value) AS mid FROM o) WHERE is_anomaly
)
"""


def classified(spark, d):
    return A.classify(detect(spark, d, "zscore", 2.0, service=True), "value", 2.0)


@query("anomaly_classified", CLASSIFIED + "SELECT * FROM k")
def anomaly_classified(spark, d):
    return classified(spark, d)


@query("anomaly_top", CLASSIFIED + "SELECT * FROM k ORDER BY anomaly_score DESC, date LIMIT 10")
def anomaly_top(spark, d):
    return A.top_anomalies(classified(spark, d), 10, ["date"])


@query(
    "anomaly_alerts",
    CLASSIFIED + """
, top AS (SELECT * FROM k WHERE severity = 'critical' ORDER BY anomaly_score DESC, date LIMIT 3)
SELECT 'critical' AS type,
       CASE WHEN type = 'spike' THEN 'Unusual Revenue Spike Detected' ELSE 'Significant Revenue Drop Detected' END AS title,
       'Revenue ' || CASE WHEN type = 'spike' THEN 'spiked' ELSE 'dropped' END || ' to $' || format('{:,.2f}', value)
         || ' on ' || strftime(date, '%Y-%m-%d') || ' (' || CASE WHEN deviation_pct >= 0 THEN '+' ELSE '' END
         || format('{:.1f}', deviation_pct) || '% from median)' AS message,
       CASE WHEN type = 'spike' THEN 'Investigate cause and verify data accuracy'
            ELSE 'Check for system issues or market changes' END AS action,
       strftime(date, '%Y-%m-%d') AS date
FROM top""",
)
def anomaly_alerts(spark, d):
    return A.alerts(classified(spark, d), "revenue", "value", "date")


@query("anomaly_isolation")
def anomaly_isolation(spark, d):
    return detect(spark, d, "isolation", 0.5)


@query("anomaly_grouped_isolation")
def anomaly_grouped_isolation(spark, d):
    """One forest per order priority over all orders."""
    return A.detect_anomalies(
        priced_orders(spark, d), "value", "date", "isolation", 0.2, groupby_column="grp",
        handle_missing_values="drop", order_by=["id"],
    )
