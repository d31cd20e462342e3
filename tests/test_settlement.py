"""Settlement of selections, on results made by hand."""

from datetime import datetime, timedelta

from oddslake.plans import settlement
from pyspark.sql import functions as F

NOW = datetime(2024, 1, 10, 12)
PAYLOAD = "struct<status:string,format:string,seriesScore:struct<home:int,away:int>,maps:array<struct<number:int,status:string,winnerId:string>>>"


def result(*winners, score=None):
    home = sum(w == "h" for w in winners)
    return ("finished", "BO3", score or (home, len(winners) - home), [(k + 1, "finished", w) for k, w in enumerate(winners)])


def settled(spark, snapshots, selections):
    matches = spark.createDataFrame([(m, "h", "a", "BO3") for m in sorted({s[0] for s in snapshots})], "match_id string, home_id string, away_id string, format string")
    rows = [(m, f"s{k}", source, "finished", NOW - timedelta(minutes=age), payload) for k, (m, source, age, payload) in enumerate(snapshots)]
    proof = settlement.proofs(spark.createDataFrame(rows, f"match_id string, snapshot_id string, source string, status string, observed_at timestamp, payload {PAYLOAD}"), matches)
    columns = "selection_id string, market_id string, event_id string, label string, accessible_label string, line string, ordinal int, market_label string, scope string, period int"
    picks = spark.createDataFrame([(i, market, event, label, None, None, None, name, scope, period) for i, market, event, label, name, scope, period in selections], columns)
    quotes = picks.where("selection_id not like 'never%'").select("selection_id", F.lit(1.9).alias("odds"))
    mapping = [("h", ["alpha"]), ("a", ["beta"])]
    fixtures = spark.createDataFrame([(f"e-{r['match_id']}", r["match_id"], "h", "a", mapping) for r in matches.collect()], "event_id string, match_id string, home_id string, away_id string, mapping array<struct<team_id:string,keys:array<string>>>")
    out = settlement.settle(picks, quotes, fixtures, proof, F.lit(NOW))
    return {r["selection_id"]: (r["status"], r["reason"]) for r in out.collect()}


def pair(prefix, market, event, name="Vainqueur du match", scope="match", period=None):
    return [(f"{prefix}h", market, event, "Alpha", name, scope, period), (f"{prefix}a", market, event, "Team Beta", name, scope, period)]


def test_settlement(spark):
    live, archive = settlement.LIVE, settlement.ARCHIVE
    snapshots = [
        ("done", live, 60, result("h", "h")),
        ("clash", live, 60, result("h", "h")), ("clash", archive, 60, result("a", "a")),
        ("fresh", live, 10, result("h", "h")),
        ("stood", live, 50, result("a", "a")), ("stood", live, 5, result("a", "a")),
        ("changed", live, 50, result("h", "h")), ("changed", live, 5, result("a", "a")),
        ("open", live, 60, result("h", score=(1, 0))),
        ("late", archive, 90, result("h", "a", "h")),
    ]
    picks = []
    for m in ("done", "clash", "fresh", "stood", "changed", "open", "late"):
        picks += pair(f"{m}-", f"mw-{m}", f"e-{m}")
    for k in (1, 3):
        picks += pair(f"map{k}-", f"map{k}", "e-done", f"Map {k} Vainqueur", "period", k)
    picks += [("alone", "m-alone", "e-done", "Alpha", "Vainqueur du match", "match", None), ("total", "m-total", "e-done", "Alpha", "Total", "match", None)]
    picks += [("never-open", "mw-done", "e-late", "Alpha", "Vainqueur du match", "match", None)]
    got = settled(spark, snapshots, picks)
    assert (got["done-h"], got["done-a"]) == (("won", None), ("lost", None))
    assert got["clash-h"] == ("pending", "source-conflict")
    assert got["fresh-h"] == got["changed-a"] == ("pending", "correction-window")
    assert (got["stood-a"], got["stood-h"]) == (("won", None), ("lost", None))  # the same result has stood since its first snapshot
    assert got["open-h"] == ("pending", "missing-final-result")
    assert (got["late-h"], got["late-a"]) == (("won", None), ("lost", None))
    assert (got["map1-h"][0], got["map1-a"][0], got["map3-h"][0], got["map3-a"][0]) == ("won", "lost", "void", "void")
    assert got["alone"] == ("pending", "unverified-market-or-identity")
    assert "total" not in got and "never-open" not in got
