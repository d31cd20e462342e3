"""Discovery graph: teams and leagues from typed items, the edges between them, and the league that each team is listed under."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.operators.latest import top_n
from oddslake.sources.tables import table

#: Kinds of edges between a team and a league (fixed values).
HOME, TOURNAMENT, MATCH = "home", "tournament", "match"
#: What a league assignment rests on (fixed values).
BY_HOME, BY_PARTICIPATION = "home", "participation"

#: Items as they are found on pages: what is missing is null.
ITEM = (
    "url string, kind string, id string, name string, slug string, code string, region string, sport string, league_id string, home_league_id string, season_id string, "
    "starts_at string, ends_at string, teams array<struct<id:string,name:string,code:string,slug:string>>"
)


def _known(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.col(c).isin("", "0")


def leagues(items: DataFrame) -> DataFrame:
    """(league_id, name, slug, region): each league once, with the values of the page that names it last by URL."""
    found = items.where((F.col("kind") == "League") & _known("id"))
    return top_n(found, ["id"], [F.desc("url"), F.desc_nulls_last("name"), F.desc_nulls_last("slug"), F.desc_nulls_last("region")]).select(F.col("id").alias("league_id"), "name", "slug", "region")


def _participants(items: DataFrame) -> DataFrame:
    """(url, kind, evidence, league_id, season_id, starts_at, ends_at, team): the teams that tournaments and matches name.

    A match names a participant as its own id, a colon and the team's.
    """
    named = items.where(F.col("kind").isin("Tournament", "EventMatch")).select("url", F.when(F.col("kind") == "EventMatch", MATCH).otherwise(TOURNAMENT).alias("kind"), F.col("id").alias("evidence"), "league_id", "season_id", "starts_at", "ends_at", F.explode("teams").alias("team"))
    own = F.concat(F.col("evidence"), F.lit(":"))
    team_id = F.when(F.col("kind") == TOURNAMENT, F.col("team.id")).when(F.startswith(F.col("team.id"), own), F.substr(F.col("team.id"), F.length(own) + 1))
    return named.withColumn("team_id", team_id).where(_known("team_id"))


def nameless_participants(items: DataFrame) -> DataFrame:
    """(url, evidence, team_id) of identified match participants without a name: a page that is not sound."""
    return _participants(items).where((F.col("kind") == MATCH) & (F.coalesce("team.name", F.lit("")) == "")).select("url", "evidence", "team_id")


def teams(items: DataFrame) -> DataFrame:
    """(team_id, name, code, slug, home_league_id): each value from the team's own items, the last by URL that has it, else from matches, the first that has it."""
    own = items.where((F.col("kind") == "Team") & _known("id") & (F.coalesce("name", F.lit("")) != "")).select(F.col("id").alias("team_id"), F.lit(0).alias("rank"), "url", F.lit("").alias("evidence"), "name", "code", "slug", "home_league_id")
    seen = _participants(items).where(f"kind = '{MATCH}'").select("team_id", F.lit(1).alias("rank"), "url", "evidence", "team.name", "team.code", "team.slug", F.lit(None).cast("string").alias("home_league_id"))
    every = own.unionByName(seen)
    # one aggregate for each value: the greatest own page, or the smallest match, that has it
    last_own = lambda c: F.max_by(c, F.when((F.col("rank") == 0) & F.col(c).isNotNull(), F.struct("url", c)))
    first_seen = lambda c: F.min_by(c, F.when((F.col("rank") == 1) & F.col(c).isNotNull(), F.struct("url", "evidence", c)))
    return every.groupBy("team_id").agg(*[F.coalesce(last_own(c), first_seen(c)).alias(c) for c in ("name", "code", "slug", "home_league_id")])


def affiliations(items: DataFrame) -> DataFrame:
    """(team_id, league_id, kind, evidence, season_id, starts_at, ends_at, urls): typed edges to known leagues, one for each evidence."""
    home = items.where((F.col("kind") == "Team") & _known("id") & (F.coalesce("name", F.lit("")) != "")).select("url", F.lit(HOME).alias("kind"), F.col("id").alias("evidence"), F.col("home_league_id").alias("league_id"), *[F.lit(None).cast("string").alias(c) for c in ("season_id", "starts_at", "ends_at")], F.col("id").alias("team_id"))
    edges = home.unionByName(_participants(items).drop("team")).join(leagues(items).select("league_id"), "league_id", "left_semi")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("url", c)))
    return edges.groupBy("team_id", "league_id", "kind", "evidence").agg(*[first(c).alias(c) for c in ("season_id", "starts_at", "ends_at")], F.array_sort(F.collect_set("url")).alias("urls"))


def assigned_leagues(items: DataFrame, cross_region: Column) -> DataFrame:
    """(team_id, league_id, basis) of every team: its home league where that is known, else the league that it was last seen in.

    Of participations, those in leagues for which ``cross_region`` (of a league's columns)
    does not hold come first, then the latest start, then the greatest evidence, then the
    smallest league; a start that is not known is the earliest. Teams with neither have no
    league. This never makes a league a team's home.
    """
    known = leagues(items).withColumn("cross", F.coalesce(cross_region, F.lit(False))).select("league_id", "cross")
    every = teams(items)
    home = every.join(known.select(F.col("league_id").alias("home_league_id")), "home_league_id").select("team_id", F.col("home_league_id").alias("league_id"), F.lit(BY_HOME).alias("basis"))
    rest = affiliations(items).join(home.select("team_id"), "team_id", "left_anti").join(known, "league_id")
    best = F.struct((~F.col("cross")).alias("own"), F.coalesce("starts_at", F.lit("")).alias("starts_at"), F.coalesce("evidence", F.lit("")).alias("evidence"))
    ranked = rest.groupBy("team_id", "league_id").agg(F.max(best).alias("best"))  # few rows a team reach the sort
    seen = top_n(ranked, ["team_id"], [F.desc("best"), F.asc("league_id")]).select("team_id", "league_id", F.lit(BY_PARTICIPATION).alias("basis"))
    return every.select("team_id").join(home.unionByName(seen), "team_id", "left")


def _items(spark, sf_dir) -> DataFrame:
    """Nations as leagues, some customers as teams with a home, and orders as matches of their customer and that of a supplier's nation."""
    nations, customers, orders = (table(spark, sf_dir, n) for n in ("nation", "customer", "orders"))
    none = lambda *names: [F.lit(None).cast("string").alias(c) for c in names]
    nobody = F.lit(None).cast("array<struct<id:string,name:string,code:string,slug:string>>").alias("teams")
    league = nations.select(F.lit("n").alias("url"), F.lit("League").alias("kind"), F.concat(F.lit("L"), "n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lower("n_name").alias("slug"), F.col("n_regionkey").cast("string").alias("region"), *none("code", "sport", "league_id", "home_league_id", "season_id", "starts_at", "ends_at"), nobody)
    team = customers.where("c_acctbal > 3000").select(F.lit("c").alias("url"), F.lit("Team").alias("kind"), F.concat(F.lit("T"), "c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 6000, F.concat(F.lit("L"), "c_nationkey")).otherwise("L99").alias("home_league_id"), *none("slug", "code", "region", "sport", "league_id", "season_id", "starts_at", "ends_at"), nobody)
    side = F.struct(F.concat(F.lit("o"), "o_orderkey", F.lit(":T"), "o_custkey").alias("id"), F.concat(F.lit("Side "), "o_custkey").alias("name"), F.lit(None).cast("string").alias("code"), F.lit(None).cast("string").alias("slug"))
    match = orders.select(F.substring("o_orderpriority", 1, 1).alias("url"), F.lit("EventMatch").alias("kind"), F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("L"), F.col("o_orderkey") % 25).alias("league_id"), F.date_format("o_orderdate", "yyyy-MM").alias("starts_at"), *none("name", "slug", "code", "region", "sport", "home_league_id", "season_id", "ends_at"), F.array(side).alias("teams"))
    return league.unionByName(team).unionByName(match)


def discovery_graph(spark, sf_dir):
    """Each customer's league: the home nation where it is named, else that of the latest order, leagues of region 2 last."""
    items = _items(spark, sf_dir)
    return assigned_leagues(items, F.col("region") == "2").join(teams(items), "team_id").select("team_id", "name", "league_id", "basis")


DISCOVERY_GRAPH = """
WITH m AS (SELECT 'T' || o_custkey AS team_id, 'L' || o_orderkey % 25 AS league_id, strftime(o_orderdate, '%Y-%m') AS starts_at, 'o' || o_orderkey AS evidence, n_regionkey <> 2 AS own FROM orders JOIN nation ON n_nationkey = o_orderkey % 25),
p AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY team_id ORDER BY own DESC, starts_at DESC, evidence DESC) = 1),
t AS (SELECT 'T' || c_custkey AS team_id, c_name AS name, CASE WHEN c_acctbal > 6000 THEN 'L' || c_nationkey END AS home FROM customer WHERE c_acctbal > 3000),
e AS (SELECT team_id FROM t UNION SELECT team_id FROM m)
SELECT e.team_id, coalesce(t.name, 'Side ' || e.team_id[2:]) AS name, coalesce(home, league_id) AS league_id, CASE WHEN home IS NOT NULL THEN 'home' WHEN league_id IS NOT NULL THEN 'participation' END AS basis
FROM e LEFT JOIN t ON t.team_id = e.team_id LEFT JOIN p ON p.team_id = e.team_id"""


def discovery_edges(spark, sf_dir):
    """How many edges of each kind a league has, and to how many teams."""
    edges = affiliations(_items(spark, sf_dir))
    return edges.groupBy("league_id", "kind").agg(F.count("*").alias("n"), F.countDistinct("team_id").alias("n_teams"))


DISCOVERY_EDGES = """
SELECT 'L' || o_orderkey % 25 AS league_id, 'match' AS kind, count(*) AS n, count(DISTINCT o_custkey) AS n_teams FROM orders GROUP BY 1
UNION ALL SELECT 'L' || c_nationkey, 'home', count(*), count(*) FROM customer WHERE c_acctbal > 6000 GROUP BY 1"""


QUERIES = {"discovery_graph": (discovery_graph, DISCOVERY_GRAPH), "discovery_edges": (discovery_edges, DISCOVERY_EDGES)}
