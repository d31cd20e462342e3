"""Links that are decided again when an alias is revoked or added, without deciding all others again; rules over versions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.functions import text
from oddslake.operators import versions
from oddslake.plans import resolve
from oddslake.sources import pages
from oddslake.sources.tables import table

#: What an alias is: its identity is the digest of these.
ALIAS_FIELDS = ("kind", "provider", "game", "competition_key", "name", "target_provider", "target_id", "valid_from", "valid_until")
SCOPE = ["provider", "game", "competition_key"]


def with_alias_ids(aliases: DataFrame) -> DataFrame:
    """``aliases`` with alias_id, the digest of all that an alias says."""
    return aliases.withColumn("alias_id", text.fingerprint({c: F.col(c) for c in ALIAS_FIELDS}))


def touched_fixtures(fixtures: DataFrame, changed: DataFrame) -> DataFrame:
    """The fixtures whose decision may rest on one of the ``changed`` aliases: of its scope, with a participant, or the competition, of its name.

    An alias takes part in a decision by no other way, in time or out of it.
    """
    names = changed.select(*SCOPE, "kind", text.plain_name(F.col("name")).alias("key")).distinct()
    said = F.concat(F.transform("participants", lambda p: F.struct(F.lit("team").alias("kind"), text.plain_name(p["name"]).alias("key"))), F.array(F.struct(F.lit("competition").alias("kind"), text.plain_name(F.col("competition")).alias("key"))))
    ids = fixtures.select("fixture_id", *SCOPE, F.explode(said).alias("said")).select("fixture_id", *SCOPE, "said.kind", "said.key")
    return fixtures.join(ids.join(names, [*SCOPE, "kind", "key"], "left_semi").select("fixture_id").distinct(), "fixture_id", "left_semi")


def decided_again(decisions: DataFrame, fixtures: DataFrame, candidates: DataFrame, aliases: DataFrame, changed: DataFrame) -> DataFrame:
    """``decisions`` (as of ``resolve``) after ``changed`` aliases were revoked or added: equal to resolving all fixtures anew.

    ``aliases`` are those that hold now. Only fixtures that a changed alias touches are
    resolved; the other decisions are taken over.
    """
    touched = touched_fixtures(fixtures, changed)
    fresh = resolve.resolve(touched, candidates, aliases)
    return decisions.join(touched.select("fixture_id"), "fixture_id", "left_anti").unionByName(fresh)


def revoked(decisions: DataFrame, fixtures: DataFrame, candidates: DataFrame, aliases: DataFrame, alias_ids: list[str]) -> tuple[DataFrame, DataFrame]:
    """The aliases without ``alias_ids``, and the decisions that then hold. An id that no alias has is an error."""
    listed = with_alias_ids(aliases)
    gone = listed.where(F.col("alias_id").isin(alias_ids))
    missing = set(alias_ids) - {r["alias_id"] for r in gone.select("alias_id").distinct().collect()}  # as many as were given
    if missing:
        raise ValueError(f"unknown aliases: {sorted(missing)}")
    left = listed.where(~F.col("alias_id").isin(alias_ids)).drop("alias_id")
    return left, decided_again(decisions, fixtures, candidates, left, gone)


def version_rules(spark, sf_dir):
    """A customer's orders before 1996 as one version of a table, those from 1995 on as the next: what was lost, what was changed, what stopped and went on."""
    orders = table(spark, sf_dir, "orders")
    last = lambda rows: rows.groupBy("o_custkey").agg(F.max_by(F.struct("o_orderstatus", F.when(F.col("o_orderpriority") < "3", F.col("o_orderdate")).alias("stopped_at"), F.col("o_orderpriority").alias("stop_reason")), F.struct("o_orderdate", "o_orderkey")).alias("r")).select("o_custkey", "r.*")
    before, after = last(orders.where("o_orderdate < '1996-01-01'")), last(orders.where("o_orderdate >= '1995-01-01'"))
    broken = versions.broken_append_only(before, after, ["o_custkey"])
    return broken.unionByName(versions.resumed(before, after, ["o_custkey"]).withColumn("rule", F.lit("resumed")))


VERSION_RULES = """
WITH l AS (SELECT *, CASE WHEN o_orderpriority < '3' THEN o_orderdate END AS stopped_at FROM orders),
b AS (SELECT * FROM l WHERE o_orderdate < TIMESTAMP '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
a AS (SELECT * FROM l WHERE o_orderdate >= TIMESTAMP '1995-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT o_custkey, 'missing' AS rule FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a)
UNION ALL SELECT o_custkey, 'changed' FROM b JOIN a USING (o_custkey) WHERE (b.o_orderstatus, b.stopped_at, b.o_orderpriority) IS DISTINCT FROM (a.o_orderstatus, a.stopped_at, a.o_orderpriority)
UNION ALL SELECT o_custkey, 'resumed' FROM b JOIN a USING (o_custkey) WHERE b.stopped_at IS NOT NULL AND (b.stopped_at, b.o_orderpriority) IS DISTINCT FROM (a.stopped_at, a.o_orderpriority)"""


def guarded_quotes(spark, sf_dir):
    """Orders as snapshots of their customer's event, lines as quotes taken in the ninety days after; suppliers' nations as the selections' events."""
    orders, lines, suppliers = (table(spark, sf_dir, n) for n in ("orders", "lineitem", "supplier"))
    event = F.col("o_custkey") % 25
    snapshots = orders.select(F.col("o_orderkey").alias("snapshot_id"), event.alias("event_id"), F.col("o_orderdate").alias("started_at"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("finished_at"), F.when(F.col("o_orderstatus") == "F", "live").otherwise("prematch").alias("phase"), F.lit("1998-01-01").cast("timestamp_ntz").alias("scheduled_at"), F.col("o_orderdate").alias("recorded_at"))
    quotes = lines.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("quote_id"), F.col("l_orderkey").alias("snapshot_id"), F.col("l_suppkey").alias("selection_id"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).alias("odds"), (F.col("l_linestatus") == "F").alias("disabled"))
    events = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("event_id"), F.when(F.col("n_regionkey") == 0, "live").when(F.col("n_regionkey") < 4, "scheduled").alias("status"), F.when(F.col("n_regionkey") == 2, F.lit("1998-01-01").cast("timestamp_ntz")).alias("stopped_at"))
    strays = versions.stray_quotes(quotes, snapshots, suppliers.select(F.col("s_suppkey").alias("selection_id"), F.col("s_nationkey").alias("event_id")))
    counted = lambda rows, what: rows.groupBy("rule").agg(F.count("*").alias("n")).select(F.lit(what).alias("subject"), "rule", "n")
    active = versions.several_active(orders, ["o_custkey"], F.col("o_orderstatus") == "F").agg(F.lit("runs").alias("subject"), F.lit("several-active").alias("rule"), F.count("*").alias("n"))
    return counted(strays, "quotes").unionByName(counted(versions.disallowed_snapshots(snapshots, events), "snapshots")).unionByName(active)


GUARDED_QUOTES = """
WITH q AS (
  SELECT CASE WHEN s_nationkey IS DISTINCT FROM o_custkey % 25 THEN 'other-event' WHEN l_shipdate < o_orderdate OR l_shipdate > o_orderdate + INTERVAL 90 DAY THEN 'out-of-time'
              WHEN (l_linestatus = 'F') <> (l_returnflag = 'R') THEN 'odds-of-a-suspended-quote' END AS rule
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey LEFT JOIN supplier ON s_suppkey = l_suppkey),
s AS (
  SELECT CASE WHEN n_regionkey IN (2, 4) THEN 'not-collectible' WHEN o_orderstatus <> 'F' AND NOT (n_regionkey <> 0 AND o_orderdate < TIMESTAMP '1998-01-01') THEN 'not-prematch'
              WHEN o_orderstatus = 'F' AND n_regionkey <> 0 THEN 'not-live' END AS rule
  FROM orders JOIN nation ON n_nationkey = o_custkey % 25)
SELECT 'quotes' AS subject, rule, count(*) AS n FROM q WHERE rule IS NOT NULL GROUP BY rule
UNION ALL SELECT 'snapshots', rule, count(*) FROM s WHERE rule IS NOT NULL GROUP BY rule
UNION ALL SELECT 'runs', 'several-active', count(*) FROM (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1 HAVING count(*) > 1)"""


def _fixtures_of_orders(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Open orders as fixtures of two sides, closed ones as candidates that may be named the other way round; no aliases."""
    orders = table(spark, sf_dir, "orders").select("*", (F.col("o_custkey") % 50).alias("c"), F.concat(F.lit("Cup "), F.substring("o_orderpriority", 3, 9)).alias("cup"), F.col("o_orderdate").cast("timestamp").alias("at"))
    person = lambda k, name: F.struct(F.lit(k).alias("position"), F.concat(F.lit(name), "c").alias("name"), F.lit(None).cast("string").alias("source_id"))
    empty = F.array().cast("array<timestamp>").alias("verified_starts")
    nothing = F.array().cast("array<struct<position:int,name:string,team_id:string,target_id:string>>").alias("kept")
    open_ = orders.where("o_orderstatus = 'O'")
    fixtures = open_.select(F.concat(F.lit("f"), "o_orderkey").alias("fixture_id"), F.lit("book").alias("provider"), F.lit(resolve.GAME).alias("game"), F.col("cup").alias("competition_key"), F.concat("cup", F.lit(" 2024")).alias("competition"), F.col("at").alias("starts_at"), empty, F.array(person(0, "Équipe Home "), person(1, "away esports ")).alias("participants"), F.lit(None).cast("string").alias("previous_match_id"), nothing)
    texts = F.array().cast("array<string>")
    team = lambda name: F.struct(F.concat(F.lit(name), "c").alias("id"), F.array(F.concat(F.lit(name), "c")).alias("names"), texts.alias("codes"), F.create_map().cast("map<string,array<string>>").alias("source_ids"))
    sides = (team("Away "), team("equipe home "))
    candidates = orders.where("o_orderstatus <> 'O'").select(F.concat(F.lit("m"), "o_orderkey").alias("candidate_id"), F.lit(resolve.GAME).alias("game"), F.col("at").alias("starts_at"), F.col("cup").alias("competition"), sides[0].alias("home"), sides[1].alias("away"), F.array(F.struct(F.lit("other").alias("provider"), F.lit("1").alias("id"))).alias("competition_ids"))
    aliases = spark.createDataFrame([], "kind string, provider string, game string, competition_key string, name string, target_provider string, target_id string, valid_from timestamp, valid_until timestamp")
    return fixtures, candidates, aliases


def match_links(spark, sf_dir):
    """The decision on every open order."""
    return resolve.resolve(*_fixtures_of_orders(spark, sf_dir)).select("fixture_id", "status", "reason", "match_id")


MATCH_LINKS = """
WITH o AS (SELECT o_orderkey AS k, o_custkey % 50 AS c, o_orderpriority AS p, o_orderdate AS at, o_orderstatus AS s FROM orders),
j AS (SELECT f.k, count(m.k) AS n, min('m' || m.k) AS match_id FROM o f LEFT JOIN o m ON m.s <> 'O' AND m.c = f.c AND m.p = f.p AND abs(epoch(m.at) - epoch(f.at)) <= 1800 WHERE f.s = 'O' GROUP BY f.k)
SELECT 'f' || k AS fixture_id, CASE n WHEN 0 THEN 'pending' WHEN 1 THEN 'linked' ELSE 'ambiguous' END AS status,
       CASE n WHEN 0 THEN 'no-demonstrated-candidate' WHEN 1 THEN 'teams-competition-current-schedule' ELSE 'multiple-plausible-identities' END AS reason, CASE WHEN n = 1 THEN match_id END AS match_id FROM j"""


def market_identities(spark, sf_dir):
    """Parts as markets of a map, of a source's id, or of a duel of two names."""
    parts = table(spark, sf_dir, "part")
    kind = F.col("p_size") % 3
    label = F.when(kind == 2, F.concat("p_name", F.lit(" DUEL"))).otherwise(F.concat(F.lit("Map "), "p_size", F.lit(" -  "), "p_type"))
    found = text.market_identity(label, F.when(kind == 1, F.col("p_brand")), F.when(kind == 2, "tab-players"), F.array("p_type", "p_brand"))
    return parts.select("p_partkey", found.alias("m")).select("p_partkey", "m.identity", "m.basis", "m.period", "m.family")


MARKET_IDENTITIES = r"""
WITH p AS (SELECT *, p_size % 3 AS k, lower(CASE WHEN p_size % 3 = 2 THEN p_name || ' duel' ELSE 'map ' || p_size || ' - ' || p_type END) AS label, list_sort([lower(p_type), lower(p_brand)]) AS pair FROM part)
SELECT p_partkey, sha256(CASE k WHEN 0 THEN '["stake-dom-v1","' || label || '"]' WHEN 1 THEN '["source-id","' || p_brand || '"]' ELSE '["stake-dom-v2-player-pair","' || label || '",["' || pair[1] || '","' || pair[2] || '"]]' END) AS identity,
       CASE k WHEN 0 THEN 'stake-dom-v1' WHEN 1 THEN 'source-id' ELSE 'stake-dom-v2-player-pair' END AS basis, CASE WHEN k < 2 THEN p_size END AS period, regexp_replace(label, '^map [0-9]+ - ', '') AS family FROM p"""


def page_links(spark, sf_dir):
    """Titles, links and languages of raw pages."""
    return pages.titles_and_links(table(spark, sf_dir, "pages"))


PAGE_LINKS = """
SELECT page_id, coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '') AS title, len(regexp_extract_all(html, '<a href="[^"]*"')) AS n_links, coalesce(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang FROM pages"""


QUERIES = {"match_links": (match_links, MATCH_LINKS), "market_identities": (market_identities, MARKET_IDENTITIES), "page_links": (page_links, PAGE_LINKS), "version_rules": (version_rules, VERSION_RULES), "guarded_quotes": (guarded_quotes, GUARDED_QUOTES)}
