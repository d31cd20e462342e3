"""Registered query of match odds by phase, over orders as matches and their lines as snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.plans import odds
from oddslake.sources.tables import table

#: The reference time of the query, and how old an open price may be.
AT, MAX_AGE = "1997-06-01 00:00:00", "200 days"


def _tables(spark, sf_dir) -> dict[str, DataFrame]:
    """Orders as matches of a customer and a guest; every tenth has two events, every ninth two markets on its first map.

    A line is a snapshot that quotes both sides of each market, or the home side only for
    every third line; what is returned counts as live.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("match_id"), F.col("o_custkey").alias("home_id"), (-F.col("o_custkey") - 1).alias("away_id"), F.when(F.col("o_orderstatus") == "F", "finished").when(F.col("o_orderstatus") == "P", "live").otherwise("scheduled").alias("status"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("event_id"), F.col("l_linenumber").alias("line")).agg(F.max("l_shipdate").alias("finished_at"), F.min("l_discount").alias("discount"), F.max("l_quantity").alias("quantity"), F.max("l_returnflag").alias("flag"))
    lines = lines.select((F.col("event_id") * 100 + F.col("line")).alias("snapshot_id"), "event_id", "line", F.when(F.col("flag") == "R", "live").otherwise("prematch").alias("phase"), "finished_at", "discount", "quantity")
    event_status = F.when(F.col("match_id") % 7 == 0, "closed").otherwise(F.col("status"))
    events = F.when(F.col("match_id") % 10 == 0, F.array(F.col("match_id"), -F.col("match_id") - 1)).otherwise(F.array("match_id"))
    market = lambda k, kind, number: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), F.lit(number).cast("int").alias("map_number"))
    winner, first, again = market(0, "match_winner", None), market(1, "map_winner", 1), market(2, "map_winner", 1)
    markets = F.when(F.col("match_id") % 9 == 0, F.array(winner, first, again)).when(F.col("match_id") % 3 == 0, F.array(winner, first)).otherwise(F.array(winner))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("home_id").alias("team_id")), F.struct(F.lit(1).alias("side"), F.col("away_id").alias("team_id")))
    flat = orders.select("match_id", F.explode(markets).alias("m"), sides.alias("sides")).select("match_id", "m", F.explode("sides").alias("s"))
    selection = (F.col("match_id") * 3 + F.col("m.k")) * 2 + F.col("s.side")
    selections = flat.select(selection.alias("selection_id"), (F.col("match_id") * 3 + F.col("m.k")).alias("market_id"), F.col("match_id").alias("event_id"), "m.kind", "m.map_number", "s.team_id", "s.side", F.when(F.col("match_id") % 2 == 0, "won").otherwise("pending").alias("result"))
    quoted = lines.join(selections.select("event_id", "selection_id", "side").hint("merge"), "event_id").where("side = 0 or line % 3 <> 0")
    price = (1 + F.col("discount").cast("decimal(6,2)") * 10 + F.col("side")).cast("decimal(16,6)")
    quotes = quoted.select("snapshot_id", "selection_id", F.col("finished_at").alias("observed_at"), F.when(F.col("discount") > 0.01, price).alias("odds"), (F.col("quantity") > 45).alias("disabled"))
    estimates = orders.where("match_id % 4 <> 0").select("match_id", F.explode(F.array(F.lit("winner"), F.lit("map1"))).alias("core_kind"), F.col("home_id").alias("team_id"), F.lit("0.5").cast("decimal(12,10)").alias("probability"))
    return {"matches": orders, "links": orders.select("match_id", F.explode(events).alias("event_id"), event_status.alias("event_status")), "selections": selections.drop("side"), "snapshots": lines.select("snapshot_id", "event_id", "phase", "finished_at"), "quotes": quotes, "estimates": estimates}


def match_odds_phases(spark, sf_dir):
    """Each match's two prices by kind, map and phase as of ``AT``, with what may be shown beside them."""
    rows = odds.match_odds(**_tables(spark, sf_dir), now=F.lit(AT).cast("timestamp_ntz"), max_age=MAX_AGE)
    side = lambda k, name: [F.get("selections", F.lit(k))[c].alias(f"{name}_{c}") for c in ("odds", "suspended", "probability")]
    return rows.select("match_id", "kind", "map_number", "phase", "historical", "observed_at", *side(0, "home"), *side(1, "away"), F.get("selections", F.lit(0))["result"].alias("result"))


MATCH_ODDS_PHASES = f"""
WITH o AS (SELECT o_orderkey AS k, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'P' THEN 'live' ELSE 'scheduled' END AS status FROM orders WHERE o_orderkey % 10 <> 0),
l AS (SELECT l_orderkey AS k, l_linenumber AS line, max(l_shipdate) AS at_time, min(l_discount) AS d, max(l_quantity) > 45 AS off, CASE WHEN max(l_returnflag) = 'R' THEN 'live' ELSE 'prematch' END AS phase FROM lineitem GROUP BY ALL),
n AS (SELECT * FROM l WHERE at_time <= TIMESTAMP '{AT}' QUALIFY row_number() OVER (PARTITION BY k, phase ORDER BY at_time DESC, line DESC) = 1),
m AS (SELECT o.*, n.*  EXCLUDE (k), status <> CASE phase WHEN 'live' THEN 'live' ELSE 'scheduled' END OR o.k % 7 = 0 AS historical, off OR d <= 0.01 AS suspended FROM o JOIN n ON n.k = o.k WHERE line % 3 <> 0 AND NOT (phase = 'live' AND status = 'scheduled')),
f AS (SELECT 'match_winner' AS kind, NULL::INTEGER AS map_number, 1 AS every UNION ALL SELECT 'map_winner', 1, 3)
SELECT k AS match_id, kind, map_number, phase, historical, at_time AS observed_at, CASE WHEN NOT suspended THEN 1 + d * 10 END AS home_odds, suspended AS home_suspended,
  CASE WHEN NOT suspended AND NOT historical AND phase = 'prematch' AND k % 4 <> 0 AND at_time >= TIMESTAMP '{AT}' - INTERVAL {MAX_AGE} THEN 0.5 END AS home_probability,
  CASE WHEN NOT suspended THEN 2 + d * 10 END AS away_odds, suspended AS away_suspended, NULL::DOUBLE AS away_probability, CASE WHEN k % 2 = 0 THEN 'won' ELSE 'pending' END AS result
FROM m JOIN f ON k % every = 0 AND (every = 1 OR k % 9 <> 0)"""

QUERIES = {"match_odds_phases": (match_odds_phases, MATCH_ODDS_PHASES)}
