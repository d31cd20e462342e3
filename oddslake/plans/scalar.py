"""Registered queries of text, time, number, array and JSON functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddslake.functions import moments, money, text
from oddslake.sources import pages
from oddslake.sources.tables import table


def normalize_name(spark, sf_dir):
    named = F.concat(F.lit("Team "), F.col("p_name"), F.lit(" & "), F.col("p_brand"), F.lit("  GAMING"))
    rows = table(spark, sf_dir, "part").select("p_partkey", text.plain_name(named).alias("name_key"))
    return rows.select("p_partkey", "name_key", text.team_key(F.col("name_key")).alias("team_key"), F.array_join(text.tokens(F.col("name_key")), ",").alias("tokens"), text.acronym(F.col("name_key")).alias("acronym"))


NORMALIZE_NAME = r"""
WITH n AS (SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(lower('Team ' || p_name || ' & ' || p_brand || '  GAMING'), '&', ' and '), '[^a-z0-9]', ' ', 'g'), '\s+', ' ', 'g')) AS name_key FROM part),
w AS (SELECT *, string_split(name_key, ' ') AS words FROM n)
SELECT p_partkey, name_key, array_to_string(list_filter(words, lambda w: w NOT IN ('team', 'esports', 'gaming', 'club')), ' ') AS team_key,
       array_to_string(list_sort(list_distinct(words)), ',') AS tokens, array_to_string(list_transform(words, lambda w: w[1]), '') AS acronym FROM w"""


def search_contains(spark, sf_dir):
    joined = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.where(text.contains_folded(F.concat_ws(" ", "c_name", "n_name", "c_mktsegment"), "Nation_1 Build")).select("c_custkey")


SEARCH_CONTAINS = """
SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE contains(lower(concat_ws(' ', c_name, n_name, c_mktsegment)), 'nation_1 build')"""


def ilike_pattern(spark, sf_dir):
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("%RED%") | F.col("p_brand").ilike("brand#1_")).select("p_partkey")


ILIKE_PATTERN = "SELECT p_partkey FROM part WHERE p_name ILIKE '%RED%' OR p_brand ILIKE 'brand#1_'"


def market_regex(spark, sf_dir):
    k = F.col("p_partkey")
    label = F.when(k % 3 == 0, F.lit("  Vainqueur  du match - two options")).when(k % 3 == 1, F.concat(F.lit("Map "), (k % 7).cast("string"), F.lit(" gagnant"))).otherwise(F.concat(F.lit("Vainqueur de la carte "), (k % 6).cast("string")))
    scope, period = F.when(k % 3 == 0, "match").otherwise("period"), F.when(k % 3 != 0, F.pmod(k, F.lit(6)).cast("int"))
    market = text.winner_market(label, scope, period)
    return table(spark, sf_dir, "part").select("p_partkey", market["kind"].alias("kind"), F.coalesce(market["map_number"], F.lit(0)).alias("map_number"))


MARKET_REGEX = """
WITH m AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN p_partkey % 7 ELSE p_partkey % 6 END AS n, p_partkey % 6 AS period FROM part)
SELECT k AS p_partkey, CASE WHEN k % 3 = 0 THEN 'match_winner' WHEN n BETWEEN 1 AND 5 AND n = period THEN 'map_winner' END AS kind,
       CAST(CASE WHEN k % 3 <> 0 AND n BETWEEN 1 AND 5 AND n = period THEN n ELSE 0 END AS INTEGER) AS map_number FROM m"""


def competition_identity(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.lit(" "), F.when(k % 2 == 0, F.lit("2026 ")).otherwise(F.lit("")), F.when(k % 3 == 0, F.lit("Summer ")).otherwise(F.lit("Split 2 ")), F.when(k % 5 == 0, F.lit("Playoffs")).otherwise(F.lit("")))
    found = table(spark, sf_dir, "part").select("p_partkey", text.competition(name).alias("c"), text.competition(F.concat(F.col("p_name"), F.lit(" 2026 Summer"))).alias("d"))
    return found.select("p_partkey", F.col("c.brand").alias("brand"), F.array_join("c.years", ",").alias("years"), F.array_join("c.edition", ",").alias("edition"), F.coalesce("c.phase", F.lit("")).alias("phase"), text.competitions_agree(F.col("c"), F.col("d")).alias("agrees"))


COMPETITION_IDENTITY = """
SELECT p_partkey, p_name AS brand, CASE WHEN p_partkey % 2 = 0 THEN '2026' ELSE '' END AS years, CASE WHEN p_partkey % 3 = 0 THEN 'summer' ELSE 'split 2' END AS edition,
       CASE WHEN p_partkey % 5 = 0 THEN 'playoffs' ELSE '' END AS phase, p_partkey % 3 = 0 AS agrees FROM part"""


def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return table(spark, sf_dir, "events").where(k >= 50).select("event_id", k.alias("k"))


JSON_EXTRACT = "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50"


def url_parts(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", text.host(url).alias("host"), text.bare_path(url).alias("path"), text.masked(F.concat(F.lit("at "), url, F.lit(" id 0123456789abcdef01"))).alias("masked"))


URL_PARTS = r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#:]+)', 1) AS host, regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1) AS path, 'at <url> id <id>' AS masked FROM pages"""


def page_titles(spark, sf_dir):
    return pages.titles_and_links(table(spark, sf_dir, "pages"))


PAGE_TITLES = r"""
SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS INTEGER) AS n_links, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang FROM pages"""


def sha_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


SHA_FINGERPRINT = "SELECT sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"


def dedup_first_seen(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    first = docs.groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min(F.struct("doc_id", "lang", "n_chars")).alias("first"))
    return first.select("first.doc_id", "sha256", "first.lang", "first.n_chars")


DEDUP_FIRST_SEEN = "SELECT doc_id, sha256(text) AS sha256, lang, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1"


def canonical_json(spark, sf_dir):
    digest = text.fingerprint({"b": F.col("r_name"), "a": F.col("r_regionkey"), "c": F.lit(None).cast("string")})
    return table(spark, sf_dir, "region").select("r_regionkey", digest.alias("sha256"))


CANONICAL_JSON = """SELECT r_regionkey, sha256('{"a":' || r_regionkey || ',"b":"' || r_name || '","c":null}') AS sha256 FROM region"""


def bans_unpivot(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_partkey").alias("ban1"), F.min("l_partkey").alias("ban2"), F.max("l_suppkey").alias("ban3"))
    return lines.unpivot("l_orderkey", ["ban1", "ban2", "ban3"], "slot", "pick").where("pick > 50")


BANS_UNPIVOT = """
WITH b AS (SELECT l_orderkey, max(l_partkey) AS ban1, min(l_partkey) AS ban2, max(l_suppkey) AS ban3 FROM lineitem GROUP BY 1)
SELECT l_orderkey, slot, pick FROM (UNPIVOT b ON ban1, ban2, ban3 INTO NAME slot VALUE pick) WHERE pick > 50"""


def expected_values(spark, sf_dir):
    odds = (F.lit(1) + F.col("p_size") / F.lit(20)).cast(money.ODDS)
    probability = (F.pmod("p_partkey", F.lit(97)) / F.lit(97)).cast(money.PROBABILITY)
    ev = money.expected_value(probability, odds)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(ev, 8).cast("double").alias("ev"), F.round(money.fair_odds(probability), 4).cast("double").alias("fair"))


EXPECTED_VALUES = """
WITH x AS (SELECT p_partkey, CAST(1 + p_size / 20 AS DECIMAL(16,6)) AS odds, CAST((p_partkey % 97) / 97 AS DECIMAL(12,10)) AS p FROM part)
SELECT p_partkey, CASE WHEN p > 0 AND p < 1 AND odds > 1 THEN CAST(round((CAST(p AS DECIMAL(20,10)) * odds - 1) * 100, 8) AS DOUBLE) END AS ev,
       CASE WHEN p > 0 AND p < 1 THEN round(1 / CAST(p AS DOUBLE), 4) END AS fair FROM x"""


def strict_vs_inclusive_threshold(spark, sf_dir):
    ev = (F.col("p_size").cast("decimal(10,2)") * F.lit("0.5").cast("decimal(3,1)")).cast("decimal(12,2)")
    rows = table(spark, sf_dir, "part").withColumn("ev", ev)
    return rows.agg(F.count_if(F.col("ev") > F.lit(5).cast("decimal(12,2)")).alias("n_strict"), F.count_if(F.col("ev") >= F.lit(5).cast("decimal(12,2)")).alias("n_inclusive"))


STRICT_VS_INCLUSIVE_THRESHOLD = "SELECT count(*) FILTER (p_size * 0.5 > 5) AS n_strict, count(*) FILTER (p_size * 0.5 >= 5) AS n_inclusive FROM part"


def odds_rounding(spark, sf_dir):
    x = (F.lit(1) + F.col("p_partkey").cast("decimal(20,8)") * F.lit("0.00000050").cast("decimal(10,8)")).cast("decimal(20,8)")
    return table(spark, sf_dir, "part").select("p_partkey", money.quantized_odds(x).cast("double").alias("odds"))


ODDS_ROUNDING = "SELECT p_partkey, CAST(round_even(CAST(1 + CAST(p_partkey AS DECIMAL(20,8)) * 0.00000050 AS DECIMAL(20,8)), 6) AS DOUBLE) AS odds FROM part"


def duration_texts(spark, sf_dir):
    s = (F.col("o_orderkey") * 37).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", moments.clock(s).alias("clock"), moments.countdown(s).alias("left"), moments.age(s).alias("age"))


DURATION_TEXTS = """
WITH x AS (SELECT o_orderkey, o_orderkey * 37 AS s FROM orders)
SELECT o_orderkey, format('{}:{:02d}', s // 60, s % 60) AS clock,
  CASE WHEN s >= 86400 THEN format('{} d {} h', s // 86400, s % 86400 // 3600) WHEN s >= 3600 THEN format('{} h {} min', s // 3600, s % 3600 // 60) WHEN s >= 60 THEN format('{} min {} s', s // 60, s % 60) ELSE format('{} s', s) END AS left,
  CASE WHEN s < 3600 THEN format('{} min', s // 60) WHEN s < 86400 THEN format('{} h', s // 3600) ELSE format('{} d', s // 86400) END AS age FROM x"""


def backoff_intervals(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_linenumber").distinct().select("l_linenumber", moments.backoff(n, 30.0, 600.0).alias("wait"), moments.spread(n * 40, F.lit(600), F.lit(120)).alias("spread"))


BACKOFF_INTERVALS = """
SELECT DISTINCT l_linenumber, least(600.0::DOUBLE, 30.0::DOUBLE * pow(2, l_linenumber - 1)) AS wait, CAST(greatest(30, floor(l_linenumber * 40 * 600 / (120 * 0.7::DOUBLE)) + 1) AS INTEGER) AS spread FROM lineitem"""


def number_parsing(spark, sf_dir):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.col("p_size").cast("string"), F.lit(".0"))).when(F.col("p_partkey") % 4 == 1, F.lit("N/A")).when(F.col("p_partkey") % 4 == 2, F.concat(F.col("p_size").cast("string"), F.lit(",5"))).otherwise(F.lit("-3"))
    return table(spark, sf_dir, "part").select("p_partkey", money.whole_number(text.missing_to_null(raw)).cast("double").alias("whole"), text.decimal_text(raw).cast("double").alias("number"))


NUMBER_PARSING = """
SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN CAST(p_size AS DOUBLE) END AS whole,
       CASE p_partkey % 4 WHEN 0 THEN CAST(p_size AS DOUBLE) WHEN 2 THEN p_size + 0.5 WHEN 3 THEN -3 END AS number FROM part"""


def array_rules(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("n"), F.collect_list("l_quantity").alias("q"))
    from oddslake.operators.groups import complete_sum

    return lines.select("l_orderkey", (F.size(F.array_distinct("n")) == F.size("n")).alias("is_unique"), complete_sum("q", 5).alias("five_sum"), F.size(F.filter("n", lambda x: x > 3)).alias("n_late"))


ARRAY_RULES = """
SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AS is_unique, CASE WHEN count(*) = 5 THEN sum(l_quantity) END AS five_sum, CAST(count(*) FILTER (l_linenumber > 3) AS INTEGER) AS n_late FROM lineitem GROUP BY l_orderkey"""


def uuid_from_name(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", text.uuid5("6ba7b811-9dad-11d1-80b4-00c04fd430c8", F.concat(F.lit("stake:"), F.col("n_name"))).alias("uuid"))


QUERIES = {
    "normalize_name": (normalize_name, NORMALIZE_NAME),
    "search_contains": (search_contains, SEARCH_CONTAINS),
    "ilike_pattern": (ilike_pattern, ILIKE_PATTERN),
    "market_regex": (market_regex, MARKET_REGEX),
    "competition_identity": (competition_identity, COMPETITION_IDENTITY),
    "json_extract": (json_extract, JSON_EXTRACT),
    "url_parts": (url_parts, URL_PARTS),
    "page_titles": (page_titles, PAGE_TITLES),
    "sha_fingerprint": (sha_fingerprint, SHA_FINGERPRINT),
    "dedup_first_seen": (dedup_first_seen, DEDUP_FIRST_SEEN),
    "canonical_json": (canonical_json, CANONICAL_JSON),
    "bans_unpivot": (bans_unpivot, BANS_UNPIVOT),
    "expected_values": (expected_values, EXPECTED_VALUES),
    "strict_vs_inclusive_threshold": (strict_vs_inclusive_threshold, STRICT_VS_INCLUSIVE_THRESHOLD),
    "odds_rounding": (odds_rounding, ODDS_ROUNDING),
    "duration_texts": (duration_texts, DURATION_TEXTS),
    "backoff_intervals": (backoff_intervals, BACKOFF_INTERVALS),
    "number_parsing": (number_parsing, NUMBER_PARSING),
    "array_rules": (array_rules, ARRAY_RULES),
    "uuid_from_name": (uuid_from_name, None),
}
