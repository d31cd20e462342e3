"""Registered queries of aggregations, rankings and day pages."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from oddslake.functions import moments
from oddslake.operators import groups, latest, matching
from oddslake.sources.tables import NOW, now, table


def status_counts(spark, sf_dir):
    status = F.col("o_orderstatus")
    return groups.bucket_counts(table(spark, sf_dir, "orders"), {"open": status == "O", "finished": status == "F", "changed": status == "P", "urgent": F.col("o_orderpriority") == "1-URGENT", "high": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")}).withColumnRenamed("all", "n_all")


STATUS_COUNTS = """
SELECT count(*) AS n_all, count(*) FILTER (o_orderstatus = 'O') AS open, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'P') AS changed,
       count(*) FILTER (o_orderpriority = '1-URGENT') AS urgent, count(*) FILTER (o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high FROM orders"""


def zero_filled_groups(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9900").withColumnRenamed("c_nationkey", "n_nationkey")
    return groups.zero_filled(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), rich, ["n_nationkey"])


ZERO_FILLED_GROUPS = """
SELECT n_nationkey, n_name, count(c_custkey) AS n FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_acctbal > 9900 GROUP BY ALL"""


def unanimity(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(groups.unanimous("l_returnflag").alias("outcome"))


UNANIMITY = """
SELECT l_orderkey, CASE WHEN count(DISTINCT l_returnflag) = 1 THEN max(l_returnflag) ELSE 'pending' END AS outcome FROM lineitem GROUP BY l_orderkey"""


def nested_history(spark, sf_dir):
    listed = groups.history(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value"), ["user_id"], "ts", "event_id", "value")
    return listed.select("user_id", F.posexplode("history").alias("place", "h")).select("user_id", F.col("place").cast("long").alias("place"), F.col("h.event_id").alias("event_id"), F.col("h.value").alias("value"))


NESTED_HISTORY = """
SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, event_id, value FROM events"""


def argmax_tiebreak(spark, sf_dir):
    return groups.best(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey").select("p_brand", F.col("best_value").alias("size"), "best")


ARGMAX_TIEBREAK = """
SELECT p_brand, p_size AS size, p_partkey AS best FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_partkey) = 1"""


def day_bucket_paris(spark, sf_dir):
    day = moments.local_day(F.col("ts")).cast("string")
    return table(spark, sf_dir, "events").groupBy(day.alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


DAY_BUCKET_PARIS = """
SELECT CAST(CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris' AS DATE) AS VARCHAR) AS day, count(*) AS n, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1"""


def day_window_paris(spark, sf_dir):
    at, today = F.col("ts").cast("timestamp"), F.lit("2024-01-20").cast("date")
    rows = table(spark, sf_dir, "events").where(moments.within_days(at, today, 7))
    return rows.agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


DAY_WINDOW_PARIS = """
SELECT count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events
WHERE CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'Europe/Paris' AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-27'"""


def topk_status_rank(spark, sf_dir):
    rank = F.element_at(F.create_map(*[F.lit(x) for x in ("O", 0, "P", 1, "F", 2)]), F.col("o_orderstatus"))
    return table(spark, sf_dir, "orders").withColumn("status_rank", rank).orderBy("status_rank", "o_orderdate", "o_orderkey").limit(100).select("o_orderkey", "o_orderstatus", "o_orderdate")


TOPK_STATUS_RANK = """
SELECT o_orderkey, o_orderstatus, o_orderdate FROM orders ORDER BY CASE o_orderstatus WHEN 'O' THEN 0 WHEN 'P' THEN 1 ELSE 2 END, o_orderdate, o_orderkey LIMIT 100"""


def top_groups(spark, sf_dir):
    counted = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return counted.join(table(spark, sf_dir, "nation"), "n_nationkey").orderBy(F.desc("n"), "n_name").limit(5).select("n_name", "n")


TOP_GROUPS = "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, n_name LIMIT 5"


def day_page(spark, sf_dir):
    orders, customer, nation = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    day = orders.where((F.col("o_orderdate") >= F.lit("1998-06-01").cast("timestamp_ntz")) & (F.col("o_orderdate") < F.lit("1998-06-08").cast("timestamp_ntz")))
    items = day.join(customer, day["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"])
    grouped = items.groupBy("n_name").agg(F.min("o_orderdate").alias("first_at"), F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"))
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("first_at", "n_name"))  # a row a nation
    return grouped.withColumn("place", place.cast("long"))


DAY_PAGE = """
WITH g AS (SELECT n_name, min(o_orderdate) AS first_at, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= '1998-06-01' AND o_orderdate < '1998-06-08' GROUP BY n_name)
SELECT *, row_number() OVER (ORDER BY first_at, n_name) AS place FROM g"""


def pages_of_rows(spark, sf_dir):
    own = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    ranked = table(spark, sf_dir, "part").withColumn("rn", F.row_number().over(own))
    return ranked.where(F.col("rn").between(7, 12)).select("p_brand", "p_partkey", F.col("rn").cast("long").alias("rn"))


PAGES_OF_ROWS = """
SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM part QUALIFY rn BETWEEN 7 AND 12"""


def json_object_agg(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    mapped = groups.as_map(counted, ["user_id"], "event_type", "n")
    return mapped.select("user_id", F.to_json("data").alias("data"))


JSON_OBJECT_AGG = """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS data FROM c GROUP BY user_id"""


def coverage_gate(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return groups.coverage(orders.where("o_orderdate < timestamp_ntz'1998-01-01'"), orders.where("o_orderdate >= timestamp_ntz'1998-01-01'"), "o_custkey")


COVERAGE_GATE = """
WITH c AS (SELECT count(DISTINCT o_custkey) FILTER (o_orderdate < '1998-01-01') AS n_before, count(DISTINCT o_custkey) FILTER (o_orderdate >= '1998-01-01') AS n_after FROM orders)
SELECT *, n_after / n_before AS ratio, n_after / n_before >= 0.8 AS is_enough FROM c"""


def rate_budget(spark, sf_dir):
    counted = table(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w")).agg(F.count("*").alias("n"))
    return counted.where("n > 3").select(F.col("w.start").alias("since"), "n", (F.col("n") - 3).alias("over"))


RATE_BUDGET = """
SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS since, count(*) AS n, count(*) - 3 AS over FROM events GROUP BY 1 HAVING count(*) > 3"""


def freshness(spark, sf_dir):
    last = table(spark, sf_dir, "events").where(F.col("ts") <= now()).groupBy("user_id", "event_type").agg(F.max("ts").alias("last"))
    fresh = F.col("last") >= now() - F.expr("interval 900 seconds")
    online = F.col("last") > now() - F.expr("interval 1 day")
    return last.select("user_id", "event_type", fresh.alias("is_fresh"), online.alias("is_online"))


FRESHNESS = f"""
SELECT user_id, event_type, max(ts) >= TIMESTAMP '{NOW}' - INTERVAL 900 SECOND AS is_fresh, max(ts) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AS is_online
FROM events WHERE ts <= TIMESTAMP '{NOW}' GROUP BY ALL"""


def run_outcomes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("n_kept"), F.count_if(F.col("l_returnflag") == "R").alias("n_failed"))
    joined = table(spark, sf_dir, "orders").select("o_orderkey").join(lines, "o_orderkey", "left")
    kept, failed = F.coalesce("n_kept", F.lit(0)), F.coalesce("n_failed", F.lit(0))
    return joined.select("o_orderkey", F.when((kept > 0) | (failed == 0), F.when(failed > 0, "partial").otherwise("succeeded")).otherwise("failed").alias("outcome"))


RUN_OUTCOMES = """
WITH l AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS k, count(*) FILTER (l_returnflag = 'R') AS f FROM lineitem GROUP BY 1)
SELECT o_orderkey, CASE WHEN coalesce(k, 0) > 0 OR coalesce(f, 0) = 0 THEN CASE WHEN coalesce(f, 0) > 0 THEN 'partial' ELSE 'succeeded' END ELSE 'failed' END AS outcome
FROM orders LEFT JOIN l ON l_orderkey = o_orderkey"""


def retention(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.where(F.col("ts") >= now() - F.expr("interval 14 days")).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


RETENTION = f"SELECT event_type, count(*) AS n, min(ts) AS oldest FROM events WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY GROUP BY event_type"


def due_gates(spark, sf_dir):
    due = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("due"), F.max(F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))).alias("blocked_until"))
    return due.select("o_custkey", F.greatest("due", "blocked_until", F.lit("1996-01-01").cast("timestamp_ntz")).alias("next_at"))


DUE_GATES = """
SELECT o_custkey, greatest(min(o_orderdate), max(o_orderdate) FILTER (o_orderstatus = 'P'), TIMESTAMP '1996-01-01') AS next_at FROM orders GROUP BY o_custkey"""


def daily_matches(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp_ntz'1998-06-01' and l_shipdate < timestamp_ntz'1998-06-08'")
    paired = lines.withColumn("pair", matching.pair_key("l_suppkey", "l_linenumber"))
    grouped = paired.groupBy("l_shipdate", "pair").agg(F.sort_array(F.collect_list("l_orderkey")).alias("items"))
    return grouped.select("l_shipdate", F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), F.size("items").alias("n"), F.col("items")[0].alias("first_item"))


DAILY_MATCHES = """
SELECT l_shipdate, least(l_suppkey, l_linenumber) AS low, greatest(l_suppkey, l_linenumber) AS high, CAST(count(*) AS INTEGER) AS n, min(l_orderkey) AS first_item
FROM lineitem WHERE l_shipdate >= '1998-06-01' AND l_shipdate < '1998-06-08' GROUP BY 1, 2, 3"""


def users_page(spark, sf_dir):
    term = "000000001"
    found = table(spark, sf_dir, "customer").where(F.contains(F.lower("c_name"), F.lit(term.lower())))
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n_open"))
    return found.join(orders, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("n_open", F.lit(0)).cast("long").alias("n_open")).orderBy("c_custkey").limit(20)


USERS_PAGE = """
SELECT c_custkey, c_name, count(o_orderkey) AS n_open FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'O'
WHERE contains(lower(c_name), '000000001') GROUP BY ALL ORDER BY c_custkey LIMIT 20"""


def recent_runs(spark, sf_dir):
    rows = latest.top_n(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 8)
    return rows.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("oldest"), F.sum("o_orderkey").alias("keys"))


RECENT_RUNS = """
WITH r AS (SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) <= 8)
SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderdate) AS oldest, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM r GROUP BY ALL"""


QUERIES = {
    "status_counts": (status_counts, STATUS_COUNTS),
    "zero_filled_groups": (zero_filled_groups, ZERO_FILLED_GROUPS),
    "unanimity": (unanimity, UNANIMITY),
    "nested_history": (nested_history, NESTED_HISTORY),
    "argmax_tiebreak": (argmax_tiebreak, ARGMAX_TIEBREAK),
    "day_bucket_paris": (day_bucket_paris, DAY_BUCKET_PARIS),
    "day_window_paris": (day_window_paris, DAY_WINDOW_PARIS),
    "topk_status_rank": (topk_status_rank, TOPK_STATUS_RANK),
    "top_groups": (top_groups, TOP_GROUPS),
    "day_page": (day_page, DAY_PAGE),
    "pages_of_rows": (pages_of_rows, PAGES_OF_ROWS),
    "json_object_agg": (json_object_agg, JSON_OBJECT_AGG),
    "coverage_gate": (coverage_gate, COVERAGE_GATE),
    "rate_budget": (rate_budget, RATE_BUDGET),
    "freshness": (freshness, FRESHNESS),
    "run_outcomes": (run_outcomes, RUN_OUTCOMES),
    "retention": (retention, RETENTION),
    "due_gates": (due_gates, DUE_GATES),
    "daily_matches": (daily_matches, DAILY_MATCHES),
    "users_page": (users_page, USERS_PAGE),
    "recent_runs": (recent_runs, RECENT_RUNS),
}
