"""Registered queries of joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from oddslake.operators import groups, matching
from oddslake.sources.tables import table


def interval_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    left = orders.select("o_custkey", F.col("o_orderkey").alias("a"), F.col("o_orderdate").alias("at"))
    right = orders.select("o_custkey", F.col("o_orderkey").alias("b"), F.col("o_orderdate").alias("bt"))
    pairs = matching.interval_join(left, right, "at", "bt", 30 * 86400, 30 * 86400, ["o_custkey"])
    return pairs.where("a < b").select("o_custkey", "a", "b")


INTERVAL_JOIN = """
SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y
  ON x.o_custkey = y.o_custkey AND x.o_orderkey < y.o_orderkey AND y.o_orderdate BETWEEN x.o_orderdate - INTERVAL 30 DAY AND x.o_orderdate + INTERVAL 30 DAY"""


def time_join(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.where("event_type = 'signup'").select(F.col("event_id").alias("a"), F.col("ts").alias("at"))
    right = events.where("event_type = 'purchase'").select(F.col("event_id").alias("b"), F.col("ts").alias("bt"))
    return matching.interval_join(left, right, "at", "bt", 120, 300).select("a", "b")


TIME_JOIN = """
SELECT x.event_id AS a, y.event_id AS b FROM events x JOIN events y
  ON x.event_type = 'signup' AND y.event_type = 'purchase' AND y.ts BETWEEN x.ts - INTERVAL 120 SECOND AND x.ts + INTERVAL 300 SECOND"""


def asymmetric_unique(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_partkey", "l_shipdate")
    pairs = matching.interval_join(orders, lines, "o_orderdate", "l_shipdate", 86400, 30 * 86400, ["k"])
    return matching.only_candidate(pairs, ["k"]).select(F.col("k").alias("o_orderkey"), "l_partkey", "l_shipdate")


ASYMMETRIC_UNIQUE = """
SELECT o_orderkey, any_value(l_partkey) AS l_partkey, any_value(l_shipdate) AS l_shipdate FROM orders JOIN lineitem
  ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate - INTERVAL 1 DAY AND o_orderdate + INTERVAL 30 DAY
GROUP BY o_orderkey HAVING count(*) = 1"""


def pair_key_join(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", F.pmod("l_partkey", F.lit(100)).alias("other")).distinct()
    keyed = lines.withColumn("pair", matching.pair_key("l_suppkey", "other"))
    out = keyed.groupBy("pair").agg(F.count("*").alias("n"), F.count_if(F.col("l_suppkey") == F.col("pair.low")).alias("n_straight"))
    return out.select(F.col("pair.low").alias("low"), F.col("pair.high").alias("high"), "n", "n_straight")


PAIR_KEY_JOIN = """
WITH p AS (SELECT DISTINCT l_suppkey, l_partkey % 100 AS other FROM lineitem)
SELECT least(l_suppkey, other) AS low, greatest(l_suppkey, other) AS high, count(*) AS n, count(*) FILTER (l_suppkey <= other) AS n_straight FROM p GROUP BY 1, 2"""


def three_table_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("n_customers"), F.sum(F.col("c_acctbal").cast("decimal(18,2)")).cast("double").alias("balance"))


THREE_TABLE_JOIN = """
SELECT r_name, n_name, count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""


def semi_ever_open(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'")
    customer = table(spark, sf_dir, "customer")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey", "c_name")


SEMI_EVER_OPEN = "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'O')"


def anti_orphans(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return customer.join(orders, customer["c_custkey"] == orders["o_custkey"], "left_anti").select("c_custkey", "c_name")


ANTI_ORPHANS = "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"


def left_last_activity(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return matching.with_last(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), orders, ["c_custkey"], "o_orderdate", "last_order")


LEFT_LAST_ACTIVITY = """
SELECT c_custkey, c_mktsegment, last_order FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last_order FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey"""


def conditional_left_join(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    nations = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    joined = t("supplier").join(nations, (F.col("s_nationkey") == F.col("n_nationkey")) & (F.col("r_name") == "ASIA"), "left")
    return joined.select("s_suppkey", "n_name", "r_name")


CONDITIONAL_LEFT_JOIN = """
SELECT s_suppkey, n_name, r_name FROM supplier LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey) ON s_nationkey = n_nationkey AND r_name = 'ASIA'"""


def unique_or_null(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return matching.valid_pairs(lines, ["l_orderkey"], "l_returnflag").select("l_orderkey", F.col("members")[0].alias("low"), F.col("members")[1].alias("high"))


UNIQUE_OR_NULL = """
SELECT l_orderkey, min(l_returnflag) AS low, max(l_returnflag) AS high FROM lineitem GROUP BY l_orderkey HAVING count(*) = 2 AND count(DISTINCT l_returnflag) = 2"""


def duplicate_groups(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("l_partkey").alias("first_part")).where("n > 1")


DUPLICATE_GROUPS = "SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_partkey) AS first_part FROM lineitem GROUP BY ALL HAVING count(*) > 1"


def update_from(spark, sf_dir):
    news = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max(F.col("o_totalprice")).alias("c_acctbal"))
    return matching.updated(table(spark, sf_dir, "customer"), news, ["c_custkey"]).select("c_custkey", "c_name", "c_acctbal")


UPDATE_FROM = """
SELECT c_custkey, c_name, coalesce(p, c_acctbal) AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, max(o_totalprice) AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey"""


def _signed(lines):
    """(l_orderkey, signature, n): one signature over all of an order's lines, however many."""
    line = F.concat_ws(":", "l_linenumber", "l_returnflag", "l_linestatus")
    return lines.groupBy("l_orderkey").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "|"), 256).alias("signature"), F.count("*").alias("n"))


def _repeated_signatures(signed):
    return signed.groupBy("signature").agg(F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order")).where("n_orders > 1")


def signature_join(spark, sf_dir):
    """Every order with a signature that others share, and the only other one if there is just one."""
    signed = _signed(table(spark, sf_dir, "lineitem")).drop("n")
    ends = [F.count("*").alias("n_orders"), F.min("l_orderkey").alias("first_order"), F.max("l_orderkey").alias("last_order")]
    rows = signed.join(signed.groupBy("signature").agg(*ends).where("n_orders > 1"), "signature")
    other = F.when(F.col("n_orders") == 2, F.when(F.col("l_orderkey") == F.col("first_order"), F.col("last_order")).otherwise(F.col("first_order")))
    return rows.select("l_orderkey", "signature", "n_orders", other.alias("only_match"))


SIGNATURE_JOIN = """
WITH s AS (SELECT l_orderkey, sha256(string_agg(s, '|' ORDER BY s)) AS signature FROM (SELECT l_orderkey, concat_ws(':', l_linenumber, l_returnflag, l_linestatus) AS s FROM lineitem) GROUP BY l_orderkey),
g AS (SELECT signature, count(*) AS n_orders, min(l_orderkey) AS lo, max(l_orderkey) AS hi FROM s GROUP BY 1 HAVING count(*) > 1)
SELECT l_orderkey, signature, n_orders, CASE WHEN n_orders = 2 THEN lo + hi - l_orderkey END AS only_match FROM s JOIN g USING (signature)"""


def signature_match(spark, sf_dir):
    return _repeated_signatures(_signed(table(spark, sf_dir, "lineitem")))


SIGNATURE_MATCH = """
WITH s AS (SELECT l_orderkey, sha256(string_agg(s, '|' ORDER BY s)) AS signature FROM (SELECT l_orderkey, concat_ws(':', l_linenumber, l_returnflag, l_linestatus) AS s FROM lineitem) GROUP BY l_orderkey)
SELECT signature, count(*) AS n_orders, min(l_orderkey) AS first_order FROM s GROUP BY signature HAVING count(*) > 1"""


def set_ops(spark, sf_dir):
    """Union, difference and intersection of two key sets, from one grouping of tagged keys."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.lit(1).alias("a"), F.lit(0).alias("b"))
    buyers = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.lit(0).alias("a"), F.lit(1).alias("b"))
    keys = customers.union(buyers).groupBy("k").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    kinds = {"union": F.lit(True), "difference": (F.col("a") == 1) & (F.col("b") == 0), "intersection": (F.col("a") == 1) & (F.col("b") == 1)}
    sums = keys.agg(*[x for kind, p in kinds.items() for x in (F.count_if(p).alias(f"{kind}_n"), F.coalesce(F.sum(F.when(p, F.col("k"))), F.lit(0)).alias(f"{kind}_total"))])
    rows = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"{kind}_n").alias("n"), F.col(f"{kind}_total").alias("total")) for kind in kinds])
    return sums.select(F.inline(rows))


SET_OPS = """
WITH c AS (SELECT c_custkey AS k FROM customer), b AS (SELECT o_custkey AS k FROM orders)
SELECT 'union' AS kind, count(*) AS n, CAST(coalesce(sum(k), 0) AS BIGINT) AS total FROM (SELECT k FROM c UNION SELECT k FROM b)
UNION ALL SELECT 'difference', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM c EXCEPT SELECT k FROM b)
UNION ALL SELECT 'intersection', count(*), CAST(coalesce(sum(k), 0) AS BIGINT) FROM (SELECT k FROM c INTERSECT SELECT k FROM b)"""


def catalog_merge(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("live "), F.col("c_mktsegment")).alias("name")).distinct()
    nations = table(spark, sf_dir, "nation").where("n_name < 'J'").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    quarantined = table(spark, sf_dir, "region").select((F.col("r_regionkey") * 5).alias("id"))
    return matching.by_precedence([nations, customers], ["id"]).join(quarantined, "id", "left_anti").select("id", "name")


CATALOG_MERGE = """
WITH a AS (SELECT n_nationkey AS id, n_name AS name, 0 AS p FROM nation WHERE n_name < 'J' UNION ALL SELECT DISTINCT c_nationkey, 'live ' || c_mktsegment, 1 FROM customer)
SELECT id, name FROM a WHERE id NOT IN (SELECT r_regionkey * 5 FROM region) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, name) = 1"""


def catalog_merge_supplied(spark, sf_dir):
    """As catalog_merge, with the nations whose suppliers have a mean balance above a level as the first source."""
    t = lambda n: table(spark, sf_dir, n)
    customers = t("customer").select(F.col("c_nationkey").alias("id"), F.concat(F.lit("live "), F.col("c_mktsegment")).alias("name")).distinct()
    rich = t("supplier").groupBy("s_nationkey").agg(F.sum(F.col("s_acctbal").cast("decimal(18,2)")).alias("balance"), F.count("*").alias("n")).where("balance > 4500 * n")
    nations = t("nation").join(rich, F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    quarantined = t("region").select((F.col("r_regionkey") * 5).alias("id"))
    return matching.by_precedence([nations, customers], ["id"]).join(quarantined, "id", "left_anti").select("id", "name")


CATALOG_MERGE_SUPPLIED = """
WITH a AS (SELECT n_nationkey AS id, n_name AS name, 0 AS p FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING sum(CAST(s_acctbal AS DECIMAL(18,2))) > 4500 * count(*)) UNION ALL SELECT DISTINCT c_nationkey, 'live ' || c_mktsegment, 1 FROM customer)
SELECT id, name FROM a WHERE id NOT IN (SELECT r_regionkey * 5 FROM region) QUALIFY row_number() OVER (PARTITION BY id ORDER BY p, name) = 1"""


def logo_reuse(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lower("p_name").alias("key"), "p_partkey", "p_size")
    donors = parts.where("p_size <= 25").groupBy("key").agg(F.count("*").alias("n"), F.max("p_partkey").alias("donor")).where("n = 1").drop("n")
    return parts.where("p_size > 25").join(donors, "key", "left").select("p_partkey", F.coalesce("donor", F.lit(-1)).alias("donor"))


LOGO_REUSE = """
WITH d AS (SELECT lower(p_name) AS key, max(p_partkey) AS donor FROM part WHERE p_size <= 25 GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, coalesce(donor, -1) AS donor FROM part LEFT JOIN d ON key = lower(p_name) WHERE p_size > 25"""


def alias_validity(spark, sf_dir):
    starts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sort_array(F.collect_set("o_orderdate")).alias("starts"))
    aliases = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("1998-01-01").cast("timestamp_ntz").alias("valid_from"), F.when(F.col("s_acctbal") > 5000, F.lit("1998-03-01").cast("timestamp_ntz")).alias("valid_until"))
    return matching.alias_targets(starts, aliases, ["k"], "starts").select("k", "valid_until")


ALIAS_VALIDITY = """
WITH a AS (SELECT s_suppkey AS k, CASE WHEN s_acctbal > 5000 THEN TIMESTAMP '1998-03-01' END AS valid_until FROM supplier)
SELECT k, valid_until FROM a WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = k AND o_orderdate >= TIMESTAMP '1998-01-01' AND (valid_until IS NULL OR o_orderdate < valid_until))"""


def name_index(spark, sf_dir):
    named = table(spark, sf_dir, "part").select("p_partkey", F.split(F.lower("p_name"), " ").alias("names"))
    return groups.name_index(named, "names", "p_partkey").select("name", F.size("ids").alias("n"), F.col("ids")[0].alias("first_id"))


NAME_INDEX = """
SELECT name, CAST(count(DISTINCT p_partkey) AS INTEGER) AS n, min(p_partkey) AS first_id FROM (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS name FROM part) GROUP BY name"""


QUERIES = {
    "interval_join": (interval_join, INTERVAL_JOIN),
    "time_join": (time_join, TIME_JOIN),
    "asymmetric_unique": (asymmetric_unique, ASYMMETRIC_UNIQUE),
    "pair_key_join": (pair_key_join, PAIR_KEY_JOIN),
    "three_table_join": (three_table_join, THREE_TABLE_JOIN),
    "semi_ever_open": (semi_ever_open, SEMI_EVER_OPEN),
    "anti_orphans": (anti_orphans, ANTI_ORPHANS),
    "left_last_activity": (left_last_activity, LEFT_LAST_ACTIVITY),
    "conditional_left_join": (conditional_left_join, CONDITIONAL_LEFT_JOIN),
    "unique_or_null": (unique_or_null, UNIQUE_OR_NULL),
    "duplicate_groups": (duplicate_groups, DUPLICATE_GROUPS),
    "update_from": (update_from, UPDATE_FROM),
    "signature_join": (signature_join, SIGNATURE_JOIN),
    "signature_match": (signature_match, SIGNATURE_MATCH),
    "set_ops": (set_ops, SET_OPS),
    "catalog_merge": (catalog_merge, CATALOG_MERGE),
    "catalog_merge_supplied": (catalog_merge_supplied, CATALOG_MERGE_SUPPLIED),
    "logo_reuse": (logo_reuse, LOGO_REUSE),
    "alias_validity": (alias_validity, ALIAS_VALIDITY),
    "name_index": (name_index, NAME_INDEX),
}
