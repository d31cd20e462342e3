"""Names that are alike, against every pair scored."""

import random
from difflib import SequenceMatcher

import pytest
from oddslake.functions import text
from oddslake.plans import names
from pyspark.sql import functions as F

ALPHABET = ["team", "esports", "gaming", "alpha", "beta", "gamma", "delta", "red", "blue", "north", "star", "wolf", "é", "zed"]


def score(x, y):
    if x == y:
        return 1.0 if x else 0.0
    s, t = set(x.split()), set(y.split())
    within = 0.94 if s and t and (s <= t or t <= s) else 0.0
    return max(within, 0.72 * (len(s & t) / len(s | t) if s | t else 0) + 0.28 * SequenceMatcher(None, x, y).ratio())


def some_names(seed, n):
    rng = random.Random(seed)
    rows = [(k, " ".join(rng.choice(ALPHABET) if rng.random() < 0.8 else f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 7)))) for k in range(n)]
    return rows + [(n, ""), (n + 1, None), (n + 2, "!!"), (n + 3, "Team"), (n + 3, "Équipe ALPHA"), (n + 4, "equipe alpha")]


@pytest.mark.parametrize("least, most", [(0.9, 20_000), (0.6, 20_000), (0.94, 3), (0.35, 1)])
def test_all_pairs_above_the_threshold(spark, monkeypatch, least, most):
    monkeypatch.setattr(names, "MOST_FREQUENT", most)
    left, right = some_names(1, 150), some_names(2, 120)
    tables = [spark.createDataFrame(x, "id long, name string") for x in (left, right)]
    keys = [{(r["id"], r["key"]) for r in t.select("id", text.plain_name(F.col("name")).alias("key")).collect()} for t in tables]
    best = {}
    for a, x in keys[0]:
        for b, y in keys[1]:
            if x and y and score(x, y) >= least:
                best[a, b] = max(best.get((a, b), 0), round(score(x, y), 9))
    want = {(a, b, s) for (a, b), s in best.items()}
    got = {(r["left_id"], r["right_id"], round(r["score"], 9)) for r in names.similar_names(*tables, least).collect()}
    assert got == want and len(want) > 20


def test_thresholds_that_words_cannot_bound(spark):
    one = spark.createDataFrame([(1, "a")], "id long, name string")
    with pytest.raises(ValueError, match="least"):
        names.similar_names(one, one, 0.28)
    assert names.similar_names(one, one.where("false"), 0.9).count() == 0


def test_no_side_is_crossed(spark):
    one = spark.createDataFrame([(1, "a b")], "id long, name string")
    plan = names.similar_names(one, one, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_likely_names_equal_brute_force(spark, sf_dir):
    left, right = ({r["id"]: " ".join(r["name"].lower().split()) for r in df.collect()} for df in names._renamed_parts(spark, sf_dir))
    got = {(r["left_id"], r["right_id"]) for r in names.likely_names(spark, sf_dir).collect()}
    assert got == {(a, b) for a, x in left.items() for b, y in right.items() if (set(x.split()) & set(y.split())) and score(x, y) >= 0.9}


def test_pairs_of_ids_are_never_grouped(spark):
    one = spark.createDataFrame([(1, "a b"), (1, "c d"), (2, "a b")], "id long, name string")
    plan = names.similar_names(one, one, 0.9)._jdf.queryExecution().optimizedPlan().toString()
    assert not any("left_id" in line.split("],")[0] and "right_id" in line.split("],")[0] for line in plan.splitlines() if "Aggregate [" in line)


@pytest.mark.parametrize("tile", [1, 7, 256])
def test_names_of_many_ids_are_spelt_out_in_full(spark, monkeypatch, tile):
    monkeypatch.setattr(names, "TILE", tile)
    rows = [(k, "a b") for k in range(50)] + [(k, "c d") for k in range(45, 60)] + [(99, "x")]
    table = spark.createDataFrame(rows, "id long, name string")
    got = sorted((r["left_id"], r["right_id"], r["score"]) for r in names.similar_names(table, table, 0.9).collect())
    of = lambda name: {k for k, n in rows if n == name}
    assert got == sorted((a, b, 1.0) for a, b in {(a, b) for n in ("a b", "c d", "x") for a in of(n) for b in of(n)})


def test_pairs_of_names_are_dealt_over_tasks_before_they_take_up_ids(spark):
    pairs = spark.createDataFrame([("a b", "a b")], "left_key string, right_key string")
    members = spark.createDataFrame([(1, "a b")], "id long, key string")
    plan = names.spelt_out(pairs, members, members)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [left_key" in plan
