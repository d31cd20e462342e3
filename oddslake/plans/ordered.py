"""Registered queries of ordered computations: latest rows, as-of, changes, runs, intervals, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddslake.functions import money
from oddslake.operators import latest
from oddslake.sources.tables import NOW, now, quotes, table

#: Probability of each kind of event in the opportunity query.
PROBABILITIES = {"signup": "0.62", "error": "0.40", "click": "0.55", "view": "0.50", "purchase": "0.60"}

_PROBABILITY_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PROBABILITIES.items()) + " END"
_ODDS_SQL = "CAST(1 + CAST(value AS DECIMAL(16,6)) / 100 AS DECIMAL(16,6))"


def opportunities_min(spark, sf_dir):
    seen = quotes(spark, sf_dir).where(F.col("ts") <= now())
    last = F.struct("ts", "event_id")
    per_user = seen.groupBy("user_id").agg(
        F.max_by(F.struct("ts", "event_type", "odds"), last).alias("last"),
        F.min_by("odds", last).alias("first_odds"),
        F.count("*").alias("n_history"),
    )
    fresh = per_user.where(F.col("last.ts") >= now() - F.expr("interval 900 minutes"))
    probability = F.element_at(F.create_map(*[F.lit(x) for pair in PROBABILITIES.items() for x in pair]), F.col("last.event_type")).cast(money.PROBABILITY)
    return fresh.select("user_id", F.col("last.event_type").alias("event_type"), F.col("last.ts").alias("last_ts"), F.col("last.odds").cast("double").alias("odds"), F.col("first_odds").cast("double").alias("first_odds"), "n_history", F.round(money.expected_value(probability, F.col("last.odds")), 6).cast("double").alias("ev"))


OPPORTUNITIES_MIN = f"""
WITH s AS (SELECT *, {_ODDS_SQL} AS odds, {_PROBABILITY_SQL} AS p FROM events WHERE ts <= TIMESTAMP '{NOW}'),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn,
        first_value(odds) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_odds, count(*) OVER (PARTITION BY user_id) AS n_history FROM s)
SELECT user_id, event_type, ts AS last_ts, CAST(odds AS DOUBLE) AS odds, CAST(first_odds AS DOUBLE) AS first_odds, n_history,
       CASE WHEN odds > 1 THEN CAST(round((CAST(p AS DECIMAL(12,10)) * odds - 1) * 100, 6) AS DOUBLE) END AS ev
FROM r WHERE rn = 1 AND ts >= TIMESTAMP '{NOW}' - INTERVAL 900 MINUTE"""


def latest_per_key(spark, sf_dir):
    return latest.top_n(table(spark, sf_dir, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id", "ts", "value")


LATEST_PER_KEY = """
SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1"""


def latest_n_per_key(spark, sf_dir):
    return latest.top_n(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 8, rank="rn").select("user_id", "event_id", F.col("rn").cast("long").alias("rn"))


LATEST_N_PER_KEY = """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events
QUALIFY rn <= 8"""


def distinct_on_asc_tie(spark, sf_dir):
    return latest.top_n(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")


DISTINCT_ON_ASC_TIE = """
SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey"""


def _asof(choose):
    def run(spark, sf_dir):
        at = F.lit("1998-06-30").cast("timestamp_ntz")
        return choose(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", at, F.col("o_orderstatus") == "O", [F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderdate")

    return run


ASOF_LATEST_THEN_VALID = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders WHERE o_orderdate <= DATE '1998-06-30')
SELECT o_custkey, o_orderkey, o_orderdate FROM r WHERE rn = 1 AND o_orderstatus = 'O'"""
ASOF_VALID_THEN_LATEST = """
SELECT o_custkey, o_orderkey, o_orderdate FROM orders WHERE o_orderdate <= DATE '1998-06-30' AND o_orderstatus = 'O'
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1"""


def first_matching(spark, sf_dir):
    choices = {"last_purchase": F.col("event_type") == "purchase", "last_large": F.col("value") > 15, "last_any": F.lit(True)}
    return latest.first_matching(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], choices, F.col("event_id"))


FIRST_MATCHING = """
SELECT user_id, arg_max(event_id, ts) FILTER (event_type = 'purchase') AS last_purchase,
       arg_max(event_id, ts) FILTER (value > 15) AS last_large, arg_max(event_id, ts) AS last_any
FROM events GROUP BY user_id"""


def change_detection(spark, sf_dir):
    return latest.changes(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "event_type").select("user_id", "event_id", "ts", "event_type")


CHANGE_DETECTION = """
WITH l AS (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, event_id, ts, event_type FROM l WHERE rn = 1 OR event_type IS DISTINCT FROM before"""


def variation(spark, sf_dir):
    rows = latest.variations(table(spark, sf_dir, "events").withColumn("v", F.col("value").cast("decimal(12,4)")), ["user_id"], [F.asc("ts"), F.asc("event_id")], "v")
    return rows.select("event_id", F.col("step").cast("double").alias("step"), F.col("since_first").cast("double").alias("since_first"), F.signum(F.col("step").cast("double")).alias("direction"))


VARIATION = """
WITH v AS (SELECT *, CAST(value AS DECIMAL(12,4)) AS v FROM events)
SELECT event_id, CAST(v - lag(v) OVER w AS DOUBLE) AS step, CAST(v - first_value(v) OVER w AS DOUBLE) AS since_first, CAST(sign(v - lag(v) OVER w) AS DOUBLE) AS direction
FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)"""


def period_anchor(spark, sf_dir):
    return latest.within_last(table(spark, sf_dir, "events"), ["user_id"], "ts", "24 hours").select("user_id", "event_id", "ts")


PERIOD_ANCHOR = """
SELECT user_id, event_id, ts FROM events QUALIFY ts >= max(ts) OVER (PARTITION BY user_id) - INTERVAL 24 HOUR"""


def step_intervals(spark, sf_dir):
    return latest.steps(table(spark, sf_dir, "events"), ["user_id"], [F.asc("ts"), F.asc("event_id")], "ts").select("event_id", F.col("ts").alias("since"), "until", "value")


STEP_INTERVALS = """
SELECT event_id, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS until, value FROM events"""


def trailing_run_anchor(spark, sf_dir):
    return latest.trailing_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_type", F.col("ts").alias("since"), "run_length")


TRAILING_RUN_ANCHOR = """
WITH l AS (SELECT *, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS last_type FROM events),
b AS (SELECT *, sum(CASE WHEN event_type <> last_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS breaks FROM l)
SELECT user_id, any_value(event_type) AS event_type, min(ts) AS since, count(*) AS run_length FROM b WHERE breaks = 0 GROUP BY user_id"""


def merge_intervals(spark, sf_dir):
    week = F.expr("interval 7 days")
    spans = table(spark, sf_dir, "orders").select("o_custkey", (F.col("o_orderdate") - week).alias("since"), (F.col("o_orderdate") + week).alias("until"))
    return latest.merged_intervals(spans, ["o_custkey"], "since", "until", gap="1 day")


MERGE_INTERVALS = """
WITH s AS (SELECT o_custkey, o_orderdate - INTERVAL 7 DAY AS since, o_orderdate + INTERVAL 7 DAY AS until FROM orders),
r AS (SELECT *, max(until) OVER (PARTITION BY o_custkey ORDER BY since, until ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR since > reach + INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY since, until ROWS UNBOUNDED PRECEDING) AS island FROM r)
SELECT o_custkey, min(since) AS since, max(until) AS until, count(*) AS n FROM i GROUP BY o_custkey, island"""


def running_profit(spark, sf_dir):
    settled = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").alias("settled_at"),
        F.when(F.col("o_orderstatus") == "F", F.round(F.col("o_totalprice").cast("decimal(18,2)") / 1000, 0).cast("long")).when(F.col("o_orderstatus") == "O", F.lit(-1000)).otherwise(F.lit(0)).cast("long").alias("profit_cents"),
    )
    return latest.running_total(settled, F.col("settled_at").cast("date"), [F.asc("settled_at"), F.asc("o_orderkey")], "profit_cents", "cumulative_cents").select("o_orderkey", "settled_at", "profit_cents", F.col("cumulative_cents").cast("long").alias("cumulative_cents"))


RUNNING_PROFIT = """
WITH s AS (SELECT o_orderkey, o_orderdate AS settled_at,
  CAST(CASE o_orderstatus WHEN 'F' THEN round(CAST(o_totalprice AS DECIMAL(18,2)) / 1000, 0) WHEN 'O' THEN -1000 ELSE 0 END AS BIGINT) AS profit_cents FROM orders)
SELECT *, CAST(sum(profit_cents) OVER (ORDER BY settled_at, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative_cents FROM s"""


def strictly_rising(spark, sf_dir):
    return latest.strictly_rising(table(spark, sf_dir, "orders"), ["o_custkey"], [F.asc("o_orderdate"), F.asc("o_orderkey")], "o_orderdate")


STRICTLY_RISING = """
WITH l AS (SELECT *, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM orders)
SELECT o_custkey, bool_and(before IS NULL OR o_orderdate > before) AS is_rising FROM l GROUP BY o_custkey"""


def first_anchors(spark, sf_dir):
    return latest.anchors(table(spark, sf_dir, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey")


FIRST_ANCHORS = "SELECT o_custkey, o_orderdate, min(o_orderkey) AS anchor FROM orders GROUP BY ALL"


def ranked_margin(spark, sf_dir):
    scored = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_retailprice") / 2000).alias("score"))
    return latest.ranked_with_margin(scored, ["p_brand"], "p_partkey", "score", 0.5, 0.001).withColumn("chosen", F.coalesce("chosen", F.lit(-1)))


RANKED_MARGIN = """
WITH r AS (SELECT p_brand, p_partkey, p_retailprice / 2000 AS score, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part),
g AS (SELECT p_brand, max(p_partkey) FILTER (rn = 1) AS best, max(score) FILTER (rn = 1) AS best_score, coalesce(max(score) FILTER (rn = 2), 0.0::DOUBLE) AS second_score FROM r WHERE rn <= 2 GROUP BY p_brand)
SELECT p_brand, best_score, second_score, CASE WHEN best_score >= 0.5 AND best_score - second_score >= 0.001 THEN best ELSE -1 END AS chosen FROM g"""


def carry_forward(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("paid"), F.when(F.col("event_type") == "view", F.col("value")).alias("seen"))
    return latest.carried(rows, ["user_id"], [F.asc("ts"), F.asc("event_id")], ["paid", "seen"]).select("event_id", "paid", "seen")


CARRY_FORWARD = """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER w AS paid,
       last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w AS seen
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"""


def keyset_page(spark, sf_dir):
    return latest.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), "o_orderkey", 1000, 100)


KEYSET_PAGE = "SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 101"


def neighbour_day(spark, sf_dir):
    found = latest.neighbours(table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")), "day")
    return found.select(*[F.col(c).cast("string").alias(c) for c in found.columns])


NEIGHBOUR_DAY = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(day AS VARCHAR) AS day, CAST(lag(day) OVER (ORDER BY day) AS VARCHAR) AS before, CAST(lead(day) OVER (ORDER BY day) AS VARCHAR) AS after FROM d"""


QUERIES = {
    "opportunities_min": (opportunities_min, OPPORTUNITIES_MIN),
    "latest_per_key": (latest_per_key, LATEST_PER_KEY),
    "latest_n_per_key": (latest_n_per_key, LATEST_N_PER_KEY),
    "distinct_on_asc_tie": (distinct_on_asc_tie, DISTINCT_ON_ASC_TIE),
    "asof_latest_then_valid": (_asof(latest.latest_then_valid), ASOF_LATEST_THEN_VALID),
    "asof_valid_then_latest": (_asof(latest.valid_then_latest), ASOF_VALID_THEN_LATEST),
    "first_matching": (first_matching, FIRST_MATCHING),
    "change_detection": (change_detection, CHANGE_DETECTION),
    "variation": (variation, VARIATION),
    "period_anchor": (period_anchor, PERIOD_ANCHOR),
    "step_intervals": (step_intervals, STEP_INTERVALS),
    "trailing_run_anchor": (trailing_run_anchor, TRAILING_RUN_ANCHOR),
    "merge_intervals": (merge_intervals, MERGE_INTERVALS),
    "running_profit": (running_profit, RUNNING_PROFIT),
    "strictly_rising": (strictly_rising, STRICTLY_RISING),
    "first_anchors": (first_anchors, FIRST_ANCHORS),
    "ranked_margin": (ranked_margin, RANKED_MARGIN),
    "carry_forward": (carry_forward, CARRY_FORWARD),
    "keyset_page": (keyset_page, KEYSET_PAGE),
    "neighbour_day": (neighbour_day, NEIGHBOUR_DAY),
}
