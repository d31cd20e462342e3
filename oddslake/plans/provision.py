"""Teams and competitions of a provider found again or set up, in the order in which a batch names them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import text
from oddslake.operators.latest import top_n
from oddslake.plans.identity import team_scores
from oddslake.sources.tables import kept, table

#: How a provider's id came to its team (fixed values).
BY_ID, BY_LEAGUE, BY_NAME, CREATED = "source-id", "league-name", "name", "created"


def _by_order(value: str, first: bool = True) -> Column:
    return (F.min_by if first else F.max_by)(value, F.struct("place", "name", "league_id", "image"))


def _ids(appearances: DataFrame) -> DataFrame:
    """(source_id, place, name, league_id, image, images, names): each id once, as it first appears, with all that it is called."""
    known = appearances.where(F.coalesce("source_id", F.lit("")) != "")
    return known.groupBy("source_id").agg(F.min("place").alias("place"), *[_by_order(c).alias(c) for c in ("name", "league_id")], F.collect_set("name").alias("names"), F.collect_set(F.when(F.col("image") != "", F.col("image"))).alias("images"), F.min_by("image", F.when(F.col("image") != "", F.struct("place", "image"))).alias("image"))


def _choices(edges: DataFrame, taken: DataFrame | None) -> DataFrame:
    """(source_id, place, team_id, basis): what each id chooses of its candidates that no earlier id has taken.

    The only one of its own league, else the only one of all. Names that mean a team score
    0.94 or 1, so two of them never lie 0.08 apart, and one of several is never chosen.
    """
    free = edges
    if taken is not None:
        first = taken.groupBy("team_id").agg(F.min("place").alias("since"))
        free = edges.join(first, "team_id", "left").where("since is null or since >= place")
    own = F.when(F.col("same_league"), F.col("team_id"))
    found = free.groupBy("source_id", "place").agg(F.count("*").alias("n"), F.count(own).alias("n_own"), F.min("team_id").alias("any_team"), F.min(own).alias("own_team"))
    team = F.when(F.col("n_own") == 1, F.col("own_team")).when(F.col("n") == 1, F.col("any_team"))
    return found.select("source_id", "place", team.alias("team_id"), F.when(F.col("n_own") == 1, BY_LEAGUE).otherwise(BY_NAME).alias("basis")).where("team_id is not null")


def team_assignments(appearances: DataFrame, teams: DataFrame) -> DataFrame:
    """(source_id, place, team_id, basis): the team of each of a provider's ids, as if the batch were worked off in order.

    ``appearances``: place (unique, gives the order), source_id, name, league_id, image;
    ``teams``: team_id, league_id, name, code, slug, aliases, source_ids (arrays). An id that
    a team has is that team. Else the id, where it first appears, takes a team that has none
    of the provider's ids yet and that its name means (see ``_choices``); the team is then no
    longer open to others. Else a team is created for it.

    What an id may choose depends on what earlier ids took, and on nothing else. So all ids
    choose at once, and choose again among what the earlier ones of the last round left,
    until no choice changes: by induction over the order that is what one after the other
    gives. Rounds are as many as choices that change one another in a row, mostly two or
    three, and only ids with a candidate take part; each is one grouping and one written table.
    """
    ids = kept(_ids(appearances))
    owned = teams.select("team_id", F.explode("source_ids").alias("source_id")).groupBy("source_id").agg(F.min("team_id").alias("team_id"))
    linked = ids.join(owned, "source_id").select("source_id", "place", "team_id", F.lit(BY_ID).alias("basis"))
    new = ids.join(owned, "source_id", "left_anti")
    available = teams.where(F.coalesce(F.size("source_ids"), F.lit(0)) <= 0)
    candidates = team_scores(new, available).join(available.select("team_id", F.col("league_id").alias("team_league")), "team_id")
    edges = kept(new.select("source_id", "place", "name", "league_id").join(candidates, "name").select("source_id", "place", "team_id", F.coalesce(F.col("league_id") == F.col("team_league"), F.lit(False)).alias("same_league")))

    chosen = kept(_choices(edges, None))
    while True:
        again = kept(_choices(edges, chosen))
        pair = lambda df: df.select("source_id", "team_id", "basis")
        if pair(again).exceptAll(pair(chosen)).isEmpty() and pair(chosen).exceptAll(pair(again)).isEmpty():
            break
        chosen = again
    own_key = text.slug("team", F.col("source_id"))
    rest = new.join(chosen, "source_id", "left_anti").select("source_id", "place", own_key.alias("team_id"), F.lit(CREATED).alias("basis"))
    return linked.unionByName(chosen).unionByName(rest)


def _sorted_names(names: Column) -> Column:
    """Names in order of their lower-case form."""
    pairs = F.array_sort(F.transform(F.array_distinct(names), lambda n: F.struct(F.lower(n).alias("k"), n.alias("n"))))
    return F.transform(pairs, lambda p: p["n"])


def provisioned(appearances: DataFrame, teams: DataFrame) -> DataFrame:
    """Teams that a batch changes or creates, as they are after it: the columns of ``teams``, images, image, and created.

    ``teams`` also has images (array) and image. Names, ids and images that the batch saw join
    the stored arrays: names sorted without regard to case, ids and images as texts; blank names go.
    A team without an image takes the first one seen. A created team has the name and league of
    its first appearance. Ids whose keys are alike share the team of the first of them, and leave
    a stored team of that key as it is. The same batch over the result changes and creates nothing.
    """
    found = kept(team_assignments(appearances, teams))
    made = top_n(found.where(F.col("basis") == CREATED).join(teams.select("team_id"), "team_id", "left_anti"), ["team_id"], [F.asc("place")])
    ours = found.where(F.col("basis") != CREATED).unionByName(made).drop("place").join(_ids(appearances), "source_id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.struct("place", c)))
    seen = ours.groupBy("team_id").agg(F.flatten(F.collect_list("names")).alias("new_names"), F.collect_list("source_id").alias("new_ids"), F.flatten(F.collect_list("images")).alias("new_images"), F.min("basis").alias("basis"), first("image").alias("new_image"), first("name").alias("first_name"), first("league_id").alias("first_league"))
    rows = seen.join(teams, "team_id", "left")
    stored = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>"))
    named = F.filter(stored("aliases"), lambda n: F.trim(n) != "")
    after = {
        "aliases": _sorted_names(F.concat(named, "new_names")), "source_ids": F.array_sort(F.array_union(stored("source_ids"), F.col("new_ids"))), "images": F.array_sort(F.array_union(stored("images"), F.col("new_images"))),
        "image": F.coalesce(F.when(F.col("image") != "", F.col("image")), "new_image"),
    }
    is_new = F.col("basis") == CREATED
    key = F.regexp_replace("team_id", "^team:", "")
    whole = rows.select("team_id", F.when(is_new, F.col("first_league")).otherwise(F.col("league_id")).alias("league_id"), F.when(is_new, F.col("first_name")).otherwise(F.col("name")).alias("name"), F.when(is_new, "").otherwise(F.col("code")).alias("code"), F.when(is_new, key).otherwise(F.col("slug")).alias("slug"), *[v.alias(k) for k, v in after.items()], is_new.alias("created"), *[F.col(k).alias(f"_{k}") for k in after])
    changed = ~(F.col("_image").eqNullSafe(F.col("image")))
    for k in ("aliases", "source_ids", "images"):
        changed = changed | ~F.col(f"_{k}").eqNullSafe(F.col(k))
    return whole.where(F.col("created") | changed).drop(*[f"_{k}" for k in after])


def competition_brands(names: DataFrame, leagues: DataFrame) -> DataFrame:
    """(name, image, league_id, reason): the league of the catalogue that a competition's name and logo stand for.

    ``names``: name, image; ``leagues``: league_id, name, slug, image, source_image, provider (whether
    a provider's batch made it). The only catalogue league with the same logo; else the league
    whose name or slug is the competition's base name, one of the catalogue before others, one with an
    image before others, then the smallest id; else one of the competition's full name, the smallest
    id. Competitions of none have no row. All are joins by logo or name key.
    """
    asked = names.select("name", "image").distinct().withColumns({"base": text.competition_base(F.col("name")), "full": text.plain_name(F.col("name"))})
    logos = leagues.where(~F.col("provider") & (F.coalesce("source_image", F.lit("")) != "")).groupBy(F.col("source_image").alias("image")).agg(F.count("*").alias("n"), F.min("league_id").alias("league_id")).where("n = 1")
    by_logo = asked.join(logos, "image").select("name", "image", "league_id", F.lit(0).alias("rank"), F.lit("logo").alias("reason"))
    keyed = leagues.select("league_id", F.struct("provider", (F.coalesce("image", F.lit("")) == "").alias("bare"), "league_id").alias("rank"), text.plain_name(F.col("name")).alias("own"), text.plain_name(F.col("slug")).alias("short"))
    best = lambda df: df.where("key <> ''").groupBy("key").agg(F.min_by("league_id", "rank").alias("league_id"))
    bases = best(keyed.select("league_id", "rank", F.explode(F.array("own", "short")).alias("key")))
    fulls = keyed.where("own <> ''").groupBy(F.col("own").alias("key")).agg(F.min("league_id").alias("league_id"))
    by_name = [asked.join(t.withColumnRenamed("key", c), c).select("name", "image", "league_id", F.lit(k).alias("rank"), F.lit(reason).alias("reason")) for k, (t, c, reason) in enumerate([(bases, "base", "base-name"), (fulls, "full", "full-name")], 1)]
    return top_n(by_logo.unionByName(by_name[0]).unionByName(by_name[1]), ["name", "image"], [F.asc("rank")]).drop("rank")


def provisioned_teams(spark, sf_dir):
    """Customers as ids of teams that orders name, three of a name, over parts as stored teams, two of a name, of which some have an id."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    place = F.struct(F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("k"))
    called = F.concat(F.when(F.col("o_orderkey") % 3 == 0, "Team ").otherwise(""), F.lit("N"), F.floor(F.col("o_custkey") / 3))
    image = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("i"), F.col("o_orderkey") % 5))
    seen = orders.select(place.alias("place"), F.concat(F.lit("c"), "o_custkey").alias("source_id"), called.alias("name"), (F.col("o_orderkey") % 4).cast("string").alias("league_id"), image.alias("image"))
    known = F.when(F.col("p_partkey") % 6 == 0, F.array(F.concat(F.lit("c"), "p_partkey"))).otherwise(F.array().cast("array<string>"))
    stored = parts.select(F.concat(F.lit("p"), "p_partkey").alias("team_id"), (F.col("p_partkey") % 3).cast("string").alias("league_id"), F.concat(F.lit("N"), F.floor(F.col("p_partkey") / 2)).alias("name"), F.lit("").alias("code"), F.lit("").alias("slug"), F.array(F.lit("zeta"), F.lit(" ")).alias("aliases"), known.alias("source_ids"), F.array().cast("array<string>").alias("images"), F.lit(None).cast("string").alias("image"))
    out = provisioned(seen, stored)
    return out.select("team_id", "league_id", "name", "created", "image", *[F.array_join(c, "|").alias(c) for c in ("aliases", "source_ids", "images")])


# one id after the other within a name, as ids of one name alone share candidates
PROVISIONED_TEAMS = """
WITH RECURSIVE o AS (SELECT 'c' || o_custkey AS id, o_custkey // 3 AS n, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS place, CASE WHEN o_orderkey % 3 = 0 THEN 'Team ' ELSE '' END || 'N' || o_custkey // 3 AS name, (o_orderkey % 4)::VARCHAR AS league, CASE WHEN o_orderkey % 4 = 0 THEN 'i' || o_orderkey % 5 END AS image FROM orders),
i AS (SELECT id, n, min(place) AS place, arg_min(name, place) AS name, arg_min(league, place) AS league, list(DISTINCT name) AS names, list(DISTINCT image) FILTER (image IS NOT NULL) AS images, arg_min(image, place) FILTER (image IS NOT NULL) AS image FROM o GROUP BY id, n),
p AS (SELECT p_partkey AS k, p_partkey // 2 AS n, (p_partkey % 3)::VARCHAR AS league, CASE WHEN p_partkey % 6 = 0 THEN 'c' || p_partkey END AS own FROM part),
w AS (SELECT i.*, row_number() OVER (PARTITION BY n ORDER BY place) AS step FROM i WHERE id NOT IN (SELECT own FROM p WHERE own IS NOT NULL)),
s AS (SELECT n, 0::BIGINT AS step, NULL::VARCHAR AS id, NULL::BIGINT AS team, coalesce((SELECT list({'k': k, 'l': league}) FROM p WHERE p.n = d.n AND own IS NULL), []) AS free FROM (SELECT DISTINCT n FROM w) d
  UNION ALL SELECT n, step, id, team, list_filter(free, lambda x: team IS NULL OR x.k <> team) FROM (
    SELECT s.n, w.step, w.id, s.free, CASE WHEN len(list_filter(free, lambda x: x.l = w.league)) = 1 THEN list_filter(free, lambda x: x.l = w.league)[1].k WHEN len(free) = 1 THEN free[1].k END AS team FROM s JOIN w ON w.n = s.n AND w.step = s.step + 1)),
a AS (SELECT id, CASE WHEN team IS NULL THEN 'team:' || id ELSE 'p' || team END AS team_id, team IS NULL AS created FROM s WHERE id IS NOT NULL UNION ALL SELECT own, 'p' || k, false FROM p WHERE own IN (SELECT id FROM i))
SELECT team_id, CASE WHEN created THEN i.league ELSE p.league END AS league_id, CASE WHEN created THEN i.name ELSE 'N' || p.n END AS name, created, i.image AS image,
  array_to_string(list_sort(CASE WHEN created THEN i.names ELSE list_distinct(list_concat(i.names, ['zeta'])) END, 'ASC', 'NULLS FIRST'), '|') AS aliases, i.id AS source_ids, coalesce(array_to_string(list_sort(i.images), '|'), '') AS images
FROM a JOIN i USING (id) LEFT JOIN p ON team_id = 'p' || p.k"""

QUERIES = {"provisioned_teams": (provisioned_teams, PROVISIONED_TEAMS)}
