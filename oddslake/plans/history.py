"""Registered queries of the composite plans: simulation, series, quotes, opportunities, upserts, expectations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from oddslake.functions import moments
from oddslake.operators import contracts
from oddslake.plans import odds, series, simulation
from oddslake.sources import ingest
from oddslake.sources.tables import shared_dir, table
from oddslake.streaming import live

_PRICE = "CAST(1 + CAST(o_totalprice AS DECIMAL(18,2)) * 0.0001 AS DECIMAL(16,6))"


def _records(spark, sf_dir):
    """Orders as settled picks: odds from the price, a result from the status."""
    orders = table(spark, sf_dir, "orders")
    result = F.when(F.col("o_orderstatus") == "F", "won").when(F.col("o_orderstatus") == "O", "lost").otherwise("void")
    return orders.select(
        F.col("o_orderkey").alias("id"), F.expr(_PRICE).alias("odds"), F.lit("0.3").cast("decimal(12,10)").alias("probability"), result.alias("result"),
        F.col("o_orderdate").alias("settled_at"), F.date_sub(F.col("o_orderdate"), 1).cast("timestamp_ntz").alias("observed_at"), F.col("o_orderpriority").alias("league_id"), F.lit("winner").alias("market"), F.col("o_custkey").cast("string").alias("pick_id"),
    )


def _simulated(spark, sf_dir):
    rows = simulation.chosen(_records(spark, sf_dir), F.lit("2000-01-01").cast("timestamp_ntz"), min_value=5.5, league="2-HIGH")
    return simulation.simulate(rows, 10.0)


def simulate_summary(spark, sf_dir):
    return simulation.summary(_simulated(spark, sf_dir), 10.0)


_SIMULATED = f"""
WITH r AS (SELECT o_orderkey AS id, o_orderdate AS settled_at, o_orderstatus AS s, {_PRICE} AS odds FROM orders WHERE o_orderdate <= TIMESTAMP '2000-01-01' AND o_orderpriority = '2-HIGH'),
k AS (SELECT *, CASE s WHEN 'F' THEN CAST(floor(odds * 1000 + 0.5) AS BIGINT) - 1000 WHEN 'O' THEN -1000 ELSE 0 END AS profit FROM r WHERE (0.3 * odds - 1) * 100 > 5.5)"""
SIMULATE_SUMMARY = f"""{_SIMULATED}
SELECT CAST(coalesce(sum(profit), 0) AS BIGINT) AS profit_cents, count(*) FILTER (s <> 'P') AS count, count(*) FILTER (s = 'F') AS wins, count(*) FILTER (s = 'P') AS voids,
       1000 * count(*) FILTER (s <> 'P') AS invested_cents,
       CASE WHEN count(*) FILTER (s <> 'P') > 0 THEN coalesce(sum(profit), 0) * 100.0::DOUBLE / (1000 * count(*) FILTER (s <> 'P')) ELSE 0.0 END AS roi_pct FROM k"""


def simulate_curve(spark, sf_dir):
    points = simulation.curve(_simulated(spark, sf_dir)).withColumnRenamed("at", "moment")
    bounds = points.agg(F.least(F.lit(0), F.min("cumulative_cents")).alias("low"), F.greatest(F.lit(0), F.max("cumulative_cents")).alias("high"))
    pad = (F.col("high") - F.col("low")) * 0.12
    return points.crossJoin(F.broadcast(bounds.select((F.col("low") - pad).cast("double").alias("floor"), (F.col("high") + pad).cast("double").alias("ceiling"))))  # one row


SIMULATE_CURVE = f"""{_SIMULATED},
c AS (SELECT id, settled_at, CAST(sum(profit) OVER (ORDER BY settled_at, id) AS BIGINT) AS total FROM k),
p AS (SELECT settled_at AS moment, arg_max(total, id) AS cumulative_cents FROM c GROUP BY 1 UNION ALL SELECT min(settled_at) - INTERVAL 1 DAY, 0 FROM k HAVING count(*) > 0),
b AS (SELECT least(0, min(cumulative_cents)) AS low, greatest(0, max(cumulative_cents)) AS high FROM p)
SELECT moment, cumulative_cents, CAST(low - (high - low) * 0.12 AS DOUBLE) AS floor, CAST(high + (high - low) * 0.12 AS DOUBLE) AS ceiling FROM p, b"""


def broken_records(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    rows = orders.select(
        F.col("o_custkey").alias("match_id"), F.col("o_orderpriority").alias("market"), F.col("o_orderkey").alias("pick_id"), F.col("o_orderkey").alias("home_id"), F.col("o_custkey").alias("away_id"),
        F.col("o_orderdate").alias("observed_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("starts_at"), F.lit("1998-01-02").cast("timestamp_ntz").alias("settled_at"),
    )
    return simulation.broken_records(rows).select("pick_id", "match_id", "market")


BROKEN_RECORDS = """
SELECT o_orderkey AS pick_id, o_custkey AS match_id, o_orderpriority AS market FROM (SELECT *, count(*) OVER (PARTITION BY o_custkey, o_orderpriority) AS n FROM orders)
WHERE n > 1 OR o_orderdate >= TIMESTAMP '1998-01-01'"""


def series_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    winner = F.when(F.col("l_returnflag") == "N", "home").otherwise("away")
    maps = lines.select("l_orderkey", F.lit("home").alias("home"), F.lit("away").alias("away"), F.col("l_linenumber").alias("number"), F.lit("finished").alias("status"), winner.alias("winner"))
    return series.series_by_format(maps, ["l_orderkey"]).select("l_orderkey", "format", F.col("score.home").alias("home_wins"), F.col("score.away").alias("away_wins"))


SERIES_SUMMARY = """
WITH m AS (SELECT l_orderkey, l_linenumber AS n, l_returnflag = 'N' AS home FROM lineitem),
g AS (SELECT l_orderkey, count(*) AS c, count(DISTINCT n) AS d, min(n) AS lo, max(n) AS hi, CAST(count(*) FILTER (home) AS INTEGER) AS h, CAST(count(*) FILTER (NOT home) AS INTEGER) AS a, arg_max(home, n) AS last_home FROM m GROUP BY 1),
f AS (SELECT * FROM (VALUES ('BO1', 1), ('BO3', 2), ('BO5', 3)) AS t(format, target)),
x AS (SELECT *, lo = 1 AND c = d AND hi = c AND c <= 5 AND CASE WHEN last_home THEN h = target AND a < target ELSE a = target AND h < target END AS ok FROM g, f)
SELECT l_orderkey, format, CASE WHEN ok THEN h END AS home_wins, CASE WHEN ok THEN a END AS away_wins FROM x"""


def quality_checks(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    tables = {
        "quotes": lines.select(F.when(F.col("l_returnflag") != "R", F.col("l_quantity") / 10).alias("odds"), (F.col("l_linestatus") == "F").alias("disabled")),
        "estimates": lines.select((F.col("l_discount") * 12).alias("probability"), F.col("l_shipdate").alias("estimated_at"), F.lit("1999-01-01").cast("timestamp_ntz").alias("valid_until")),
        "matches": orders.select((F.col("o_custkey") % 7).alias("home_id"), (F.col("o_orderkey") % 7).alias("away_id"), F.concat(F.lit("BO"), F.substring("o_orderpriority", 1, 1)).alias("format")),
        "snapshots": orders.select(F.col("o_orderdate").alias("started_at"), F.lit("1998-01-01").cast("timestamp_ntz").alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "live").when(F.col("o_orderstatus") == "O", "prematch").otherwise("other").alias("phase")),
        "events": orders.select(F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("stopped_at"), F.when(F.col("o_totalprice") > 100_000, "late").alias("stop_reason")),
        "results": lines.select(F.when(F.col("l_returnflag") == "A", "match_winner").otherwise("map_winner").alias("kind"), F.when(F.col("l_linestatus") == "F", F.col("l_linenumber")).alias("map_number")),
    }
    out = None
    for name, rows in tables.items():
        found = contracts.violations(rows, contracts.RULES[name]).select(F.lit(name).alias("subject"), "rule", "n")
        out = found if out is None else out.unionByName(found)
    twice = contracts.repeated_keys(lines, ["l_orderkey", "l_linenumber"]).agg(F.lit("lines").alias("subject"), F.lit("one-row-a-key").alias("rule"), F.count("*").alias("n"))
    lost = contracts.strays(orders.withColumnRenamed("o_custkey", "c_custkey"), table(spark, sf_dir, "customer"), ["c_custkey"]).agg(F.lit("orders").alias("subject"), F.lit("known-customer").alias("rule"), F.count("*").alias("n"))
    return out.unionByName(twice).unionByName(lost)


QUALITY_CHECKS = """
SELECT 'quotes' AS subject, 'odds-range' AS rule, count(*) FILTER (l_returnflag <> 'R' AND NOT (l_quantity / 10 > 1)) AS n FROM lineitem
UNION ALL SELECT 'quotes', 'suspended-without-odds', count(*) FILTER ((l_linestatus = 'F') <> (l_returnflag = 'R')) FROM lineitem
UNION ALL SELECT 'estimates', 'probability-range', count(*) FILTER (NOT (l_discount * 12 > 0 AND l_discount * 12 < 1)) FROM lineitem
UNION ALL SELECT 'estimates', 'valid-after-estimate', count(*) FILTER (l_shipdate >= TIMESTAMP '1999-01-01') FROM lineitem
UNION ALL SELECT 'matches', 'sides-differ', count(*) FILTER (o_custkey % 7 = o_orderkey % 7) FROM orders
UNION ALL SELECT 'matches', 'format', count(*) FILTER (o_orderpriority[1] NOT IN ('1', '3', '5')) FROM orders
UNION ALL SELECT 'snapshots', 'time-order', count(*) FILTER (o_orderdate > TIMESTAMP '1998-01-01') FROM orders
UNION ALL SELECT 'snapshots', 'phase', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
UNION ALL SELECT 'events', 'stop-reason', count(*) FILTER ((o_orderstatus = 'F') <> (o_totalprice > 100000)) FROM orders
UNION ALL SELECT 'results', 'map-number', count(*) FILTER (CASE WHEN l_returnflag = 'A' THEN l_linestatus = 'F' ELSE l_linestatus <> 'F' OR l_linenumber NOT BETWEEN 1 AND 5 END) FROM lineitem
UNION ALL SELECT 'lines', 'one-row-a-key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orders', 'known-customer', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"""


def current_quotes(spark, sf_dir):
    snapshots = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("event_id"), F.col("o_orderkey").alias("snapshot_id"), F.when(F.col("o_orderstatus") == "F", "live").otherwise("prematch").alias("phase"), F.col("o_orderdate").alias("finished_at"))
    quotes = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("snapshot_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("selection_id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("odds"), (F.col("l_linestatus") == "F").alias("disabled"))
    return odds.current_quotes(snapshots, quotes).select("event_id", "snapshot_id", "phase", "selection_id", "observed_at", "odds", "quote_open")


CURRENT_QUOTES = """
WITH s AS (SELECT o_custkey AS event_id, o_orderkey AS snapshot_id, CASE WHEN o_orderstatus = 'F' THEN 'live' ELSE 'prematch' END AS phase FROM orders
           QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1),
q AS (SELECT s.*, l_orderkey * 10 + l_linenumber AS selection_id, l_shipdate AS observed_at, CASE WHEN l_returnflag <> 'R' THEN l_extendedprice END AS odds, l_linestatus = 'F' AS disabled FROM lineitem JOIN s ON l_orderkey = snapshot_id)
SELECT event_id, snapshot_id, phase, selection_id, observed_at, odds, NOT disabled AND odds IS NOT NULL AS quote_open FROM q
QUALIFY row_number() OVER (PARTITION BY selection_id ORDER BY observed_at DESC, odds ASC NULLS LAST, disabled) = 1"""


def opportunities_open(spark, sf_dir):
    """Customers as markets of one match each; lines as estimates, orders as readings."""
    now = F.lit("1998-06-30").cast("timestamp_ntz")
    customers, orders, lines = (table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem"))
    markets = customers.select(F.col("c_custkey").alias("market_id"), F.col("c_nationkey").alias("match_id"), (F.col("c_acctbal") > 0).alias("active"))
    matches = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("match_id"), F.date_add(F.lit("1998-06-20").cast("date"), F.col("n_nationkey")).cast("timestamp_ntz").alias("starts_at"))
    best = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("market_id"), F.col("l_shipdate").alias("estimated_at")).agg(F.max("l_quantity").alias("q"))
    estimates = best.select("market_id", "estimated_at", F.date_add(F.col("estimated_at"), (F.col("q") * 4).cast("int")).cast("timestamp_ntz").alias("valid_until"), (F.col("q") / 100).cast("decimal(12,10)").alias("probability"))
    readings = orders.select(F.col("o_custkey").alias("market_id"), F.col("o_orderdate").alias("recorded_at"), F.expr(_PRICE).alias("odds"))
    out = odds.opportunities(markets, matches, estimates, readings, now, "120 days")
    return out.select("market_id", "match_id", F.col("probability").cast("double").alias("probability"), F.col("odds").cast("double").alias("odds"), F.col("first_odds").cast("double").alias("first_odds"), "n_readings", F.round("value", 4).cast("double").alias("value"))


OPPORTUNITIES_OPEN = f"""
WITH e AS (SELECT o_custkey AS market_id, l_shipdate AS moment, max(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate <= TIMESTAMP '1998-06-30' GROUP BY 1, 2),
n AS (SELECT market_id, CAST(q / 100 AS DECIMAL(12,10)) AS p FROM (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY market_id ORDER BY moment DESC) = 1) WHERE moment + to_days(CAST(q * 4 AS INTEGER)) > TIMESTAMP '1998-06-30'),
r AS (SELECT o_custkey AS market_id, max(o_orderdate) AS last_at, arg_max(o, (o_orderdate, o)) AS odds, arg_min(o, (o_orderdate, o)) AS first_odds, count(*) AS n_readings FROM (SELECT *, {_PRICE} AS o FROM orders) WHERE o_orderdate <= TIMESTAMP '1998-06-30' GROUP BY 1)
SELECT market_id, c_nationkey AS match_id, CAST(p AS DOUBLE) AS probability, CAST(odds AS DOUBLE) AS odds, CAST(first_odds AS DOUBLE) AS first_odds, n_readings,
       CASE WHEN p > 0 AND p < 1 AND odds > 1 THEN CAST(round((p * odds - 1) * 100, 4) AS DOUBLE) END AS value
FROM customer JOIN n ON n.market_id = c_custkey JOIN r USING (market_id)
WHERE c_acctbal > 0 AND DATE '1998-06-20' + c_nationkey > TIMESTAMP '1998-06-30' AND last_at >= TIMESTAMP '1998-06-30' - INTERVAL 120 DAY"""


def history_windows(spark, sf_dir):
    readings = table(spark, sf_dir, "events").select(F.col("user_id").alias("market_id"), F.col("ts").alias("recorded_at"), F.col("value").cast("decimal(12,4)").alias("odds"), "event_id")
    return odds.history_windows(readings, 168).select("event_id", F.col("change").cast("double").alias("change"))


HISTORY_WINDOWS = """
WITH c AS (SELECT event_id, ts, CAST(value AS DECIMAL(12,4)) - lag(CAST(value AS DECIMAL(12,4))) OVER w AS change, max(ts) OVER (PARTITION BY user_id) AS last FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
SELECT event_id, CAST(change AS DOUBLE) AS change FROM c WHERE ts >= last - INTERVAL 168 HOUR"""


def best_and_average(spark, sf_dir):
    items = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("market_id"), F.col("p_retailprice").cast("decimal(18,2)").alias("value"), F.col("p_size").alias("probability"), F.col("p_brand").alias("league_id"), F.col("p_type").alias("pick_id"), F.col("p_name").alias("home_name"), F.col("p_name").alias("away_name"), F.col("p_partkey").alias("starts_at"))
    kept = odds.filtered_values(items, least=1000.0, term="A", sort="value")
    return odds.best_and_average(kept).select("n", F.round(F.col("average").cast("double"), 4).alias("average"), "best")


BEST_AND_AVERAGE = """
WITH k AS (SELECT p_partkey, CAST(p_retailprice AS DECIMAL(18,2)) AS v FROM part WHERE CAST(p_retailprice AS DECIMAL(18,2)) >= 1000 AND contains(lower(p_name), 'a'))
SELECT count(*) AS n, round(coalesce(CAST(sum(v) AS DOUBLE) / count(*), 0), 4) AS average, (SELECT p_partkey FROM k ORDER BY v DESC, p_partkey LIMIT 1) AS best FROM k"""


def _two_halves(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("seen_at"), F.col("o_orderdate").alias("first_seen"), "o_orderpriority")
    early = F.col("seen_at") < F.lit("1998-01-01").cast("timestamp_ntz")
    return rows, early


def upsert_latest(spark, sf_dir):
    rows, early = _two_halves(spark, sf_dir)
    one = rows.where(~early).groupBy("o_custkey").agg(F.max(F.struct("seen_at", "o_orderkey", "first_seen", "o_orderpriority")).alias("r")).select("o_custkey", "r.*").select(*rows.columns)
    return ingest.upserted(one, rows.where(early), ["o_custkey"], "seen_at", "first_seen").select("o_custkey", "o_orderkey", "seen_at", "first_seen")


UPSERT_LATEST = """
WITH l AS (SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
u AS (SELECT * FROM l UNION ALL SELECT * FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS seen_at, min(o_orderdate) AS first_seen FROM u GROUP BY 1"""


def insert_absent(spark, sf_dir):
    rows, early = _two_halves(spark, sf_dir)
    first = lambda df: df.groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey"))
    return ingest.insert_absent(first(rows.where(early)), first(rows.where(~early)), ["o_custkey"])


INSERT_ABSENT = """
WITH e AS (SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT * FROM e UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey NOT IN (SELECT o_custkey FROM e) GROUP BY 1"""


def merged_identity(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") != "view", F.col("event_type")).otherwise(" ").alias("kind"), F.when(F.col("value") > 10, F.col("event_id")).alias("large"))
    return ingest.merged_identity(rows, ["user_id"], "ts", ["kind", "large"])


MERGED_IDENTITY = """
SELECT user_id, arg_max(event_type, ts) FILTER (event_type <> 'view') AS kind, arg_max(event_id, ts) FILTER (value > 10) AS large, max(ts) AS ts FROM events GROUP BY user_id"""


def inventory_counts(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.select("l_orderkey", F.create_map(F.lit("flag"), F.col("l_returnflag"), F.lit("status"), F.col("l_linestatus")).alias("payload"))
    return ingest.inventory(rows, "l_orderkey")


INVENTORY_COUNTS = """
SELECT count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_ids, CAST(sum(strlen('{"flag":"' || l_returnflag || '","status":"' || l_linestatus || '"}')) AS BIGINT) AS n_bytes FROM lineitem"""


def time_texts(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    iso = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("o_orderkey") % 4
    text = F.when(kind == 0, F.concat(iso, F.lit("Z"))).when(kind == 1, F.concat(iso, F.lit("+02:00"))).when(kind == 2, iso).otherwise(F.lit("soon"))
    day = F.when(kind == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(kind == 1, F.concat(F.date_format("o_orderdate", "yyyy-MM"), F.lit("-31"))).when(kind == 2, F.date_format("o_orderdate", "yyyy-M-d")).otherwise("")
    header = F.when(kind == 0, F.col("o_custkey").cast("string")).when(kind == 1, F.concat(F.lit("Thu, "), F.date_format("o_orderdate", "dd MMM yyyy HH:mm:ss"), F.lit(" GMT"))).otherwise("later")
    today, at = F.lit("1998-01-01").cast("date"), F.lit("1998-01-01").cast("timestamp")
    seconds = lambda c: F.unix_timestamp(c)
    return orders.select(
        "o_orderkey",
        seconds(moments.instant(text)).alias("strict"),
        seconds(moments.instant(text, "Etc/GMT-1")).alias("zoned"),
        moments.strict_date(day).alias("day"),
        moments.clamp_day(F.to_date("o_orderdate"), today, 7).alias("clamped"),
        moments.retry_after(header, at).alias("wait"),
        F.substring(text, 1, 10).alias("prefix"),
        (F.date_trunc("minute", F.col("o_orderdate")) + F.expr("interval 1 minute")).cast("timestamp_ntz").alias("next_minute"),
        moments.next_boundary(F.col("o_orderdate"), 20).cast("timestamp_ntz").alias("boundary"),
    )


TIME_TEXTS = """
WITH o AS (SELECT *, o_orderkey % 4 AS k, CAST(epoch(o_orderdate) AS BIGINT) AS s FROM orders)
SELECT o_orderkey, CASE k WHEN 0 THEN s WHEN 1 THEN s - 7200 END AS strict, CASE k WHEN 0 THEN s WHEN 1 THEN s - 7200 WHEN 2 THEN s - 3600 END AS zoned,
       CASE WHEN k = 0 THEN CAST(o_orderdate AS DATE) WHEN k = 1 THEN TRY_CAST(strftime(o_orderdate, '%Y-%m') || '-31' AS DATE) WHEN k = 2 AND length(strftime(o_orderdate, '%Y-%-m-%-d')) = 10 THEN CAST(o_orderdate AS DATE) END AS day,
       greatest(DATE '1997-12-25', least(DATE '1998-01-08', CAST(o_orderdate AS DATE))) AS clamped,
       CAST(CASE k WHEN 0 THEN o_custkey WHEN 1 THEN greatest(0, s - epoch(TIMESTAMP '1998-01-01')) END AS INTEGER) AS wait,
       CASE WHEN k < 3 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'soon' END AS prefix,
       date_trunc('minute', o_orderdate) + INTERVAL 1 MINUTE AS next_minute, time_bucket(INTERVAL 20 MINUTE, o_orderdate) + INTERVAL 20 MINUTE AS boundary
FROM o"""


def stream_latest(spark, sf_dir):
    """Each user's newest event, kept by micro-batches over the event files that are there now."""
    folder = f"{shared_dir(spark)}/stream-latest-{uuid.uuid4().hex}"
    schema = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type").schema
    stream = live.event_stream(spark, f"{sf_dir}/events.parquet*", schema)
    batches, versions = live.upsert_batches(f"{folder}/table", ["user_id"], "ts"), []

    def keep(batch, batch_id):
        batches(batch, batch_id)
        versions.append(batch_id + 1)

    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/table/v{versions[-1]}") if versions else spark.createDataFrame([], schema)


STREAM_LATEST = "SELECT event_id, ts, user_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"


QUERIES = {
    "stream_latest": (stream_latest, STREAM_LATEST),
    "simulate_summary": (simulate_summary, SIMULATE_SUMMARY),
    "simulate_curve": (simulate_curve, SIMULATE_CURVE),
    "broken_records": (broken_records, BROKEN_RECORDS),
    "series_summary": (series_summary, SERIES_SUMMARY),
    "quality_checks": (quality_checks, QUALITY_CHECKS),
    "current_quotes": (current_quotes, CURRENT_QUOTES),
    "opportunities_open": (opportunities_open, OPPORTUNITIES_OPEN),
    "history_windows": (history_windows, HISTORY_WINDOWS),
    "best_and_average": (best_and_average, BEST_AND_AVERAGE),
    "upsert_latest": (upsert_latest, UPSERT_LATEST),
    "insert_absent": (insert_absent, INSERT_ABSENT),
    "merged_identity": (merged_identity, MERGED_IDENTITY),
    "inventory_counts": (inventory_counts, INVENTORY_COUNTS),
    "time_texts": (time_texts, TIME_TEXTS),
}
