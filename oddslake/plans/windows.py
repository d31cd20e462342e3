"""Scans of the days around moments, and intervals folded into islands."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from oddslake.operators.islands import days_around, merged_intervals, on_days
from oddslake.sources.tables import table


def scan_windows(spark, sf_dir):
    """Lines shipped from the day before to two days after one of the dearest urgent orders."""
    dear = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' and o_totalprice > 380000")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"))
    return on_days(lines, "day", days_around(dear, "o_orderdate", timedelta(days=1), timedelta(days=2)))


SCAN_WINDOWS = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) + CAST(k AS INTEGER) AS day FROM orders, range(-1, 3) AS r(k) WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 380000)
SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE CAST(l_shipdate AS DATE) IN (SELECT day FROM d)"""


def merged_windows(spark, sf_dir):
    """Each user's spells: events with the half day around them, folded where they touch."""
    events = table(spark, sf_dir, "events").select("user_id", (F.col("ts") - F.expr("interval 12 hours")).alias("since"), (F.col("ts") + F.expr("interval 12 hours")).alias("until"))
    return merged_intervals(events, ["user_id"], "since", "until")


MERGED_WINDOWS = """
WITH w AS (SELECT user_id, ts - INTERVAL 12 HOUR AS since, ts + INTERVAL 12 HOUR AS until FROM events),
f AS (SELECT *, CASE WHEN since <= max(until) OVER (PARTITION BY user_id ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM w),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY since, until ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT user_id, min(since) AS since, max(until) AS until, count(*) AS n FROM i GROUP BY user_id, island"""


QUERIES = {"scan_windows": (scan_windows, SCAN_WINDOWS), "merged_windows": (merged_windows, MERGED_WINDOWS)}
