"""Teams, leagues and edges from items made by hand."""

import pytest
from oddslake.plans import graph
from pyspark.sql import functions as F

FIELDS = [f.split()[0] for f in graph.ITEM.split(", ")]


@pytest.fixture
def items(spark):
    def build(*rows):
        return spark.createDataFrame([tuple(r.get(f) for f in FIELDS) for r in rows], graph.ITEM)

    return build


def league(i, region="EU", **more):
    return {"url": "a", "kind": "League", "id": i, "name": i.upper(), "slug": i, "region": region} | more


def match(i, league_id, *team_ids, starts_at=None, url="m", **more):
    return {"url": url, "kind": "EventMatch", "id": i, "league_id": league_id, "starts_at": starts_at, "teams": [(f"{i}:{t}", f"Label {t}", None, None) for t in team_ids]} | more


def assigned(df):
    return {r["team_id"]: (r["league_id"], r["basis"]) for r in graph.assigned_leagues(df, F.col("region") == "INTERNATIONAL").collect()}


def test_home_before_participation_and_own_region_before_latest(items):
    df = items(
        league("lec"), league("worlds", "INTERNATIONAL"), league("lck"),
        {"url": "t", "kind": "Team", "id": "1", "name": "One", "home_league_id": "lec"}, {"url": "t", "kind": "Team", "id": "2", "name": "Two", "home_league_id": "gone"}, {"url": "t", "kind": "Team", "id": "3", "name": "Three"}, {"url": "t", "kind": "Team", "id": "0", "name": "Nobody"},
        match("m1", "lck", "1", "2", starts_at="2024-01-01"), match("m2", "worlds", "1", "2", "4", starts_at="2024-09-01"), match("m3", "unknown", "5", starts_at="2024-09-01"), match("m4", "lec", "2", starts_at=None),
    )
    assert assigned(df) == {"1": ("lec", "home"), "2": ("lck", "participation"), "3": (None, None), "4": ("worlds", "participation"), "5": (None, None)}


def test_ties_go_by_evidence_and_then_by_league(items):
    df = items(league("a"), league("b"), match("m1", "b", "1", starts_at="x"), match("m2", "a", "1", starts_at="x"), match("m2", "b", "2", starts_at="x"), match("m2", "a", "2", starts_at="x", url="n"))
    assert assigned(df) == {"1": ("a", "participation"), "2": ("a", "participation")}


def test_edges_are_one_for_each_evidence_with_all_its_pages(items):
    tournament = {"kind": "Tournament", "id": "t1", "league_id": "a", "season_id": "s1", "teams": [("1", None, None, None), ("0", None, None, None), (None, None, None, None)]}
    df = items(league("a"), tournament | {"url": "p2"}, tournament | {"url": "p1", "starts_at": "2024"}, tournament | {"url": "p1"}, match("m", "a", "1"), match("m", "zz", "1"), {"url": "t", "kind": "Team", "id": "1", "name": "One", "home_league_id": "a"})
    got = {(r["team_id"], r["league_id"], r["kind"], r["evidence"]): (r["season_id"], r["starts_at"], r["urls"]) for r in graph.affiliations(df).collect()}
    assert got == {("1", "a", "tournament", "t1"): ("s1", "2024", ["p1", "p2"]), ("1", "a", "match", "m"): (None, None, ["m"]), ("1", "a", "home", "1"): (None, None, ["t"])}


def test_a_match_names_participants_under_its_own_id(items):
    df = items(league("a"), {"url": "m", "kind": "EventMatch", "id": "m", "league_id": "a", "teams": [("m:1", "One", "O", None), ("other:2", "Two", None, None), ("m:", "None", None, None), ("m:0", "Zero", None, None), ("m", "No", None, None), ("m:7", "", None, None)]})
    assert {r["team_id"] for r in graph.teams(df).collect()} == {"1", "7"}
    assert [tuple(r) for r in graph.nameless_participants(df).collect()] == [("m", "m", "7")]


def test_a_team_s_own_values_come_before_labels(items):
    df = items({"url": "t1", "kind": "Team", "id": "1", "name": "Old", "code": "OLD", "slug": "one"}, {"url": "t2", "kind": "Team", "id": "1", "name": "New", "code": "NEW"}, match("m", "a", "1", "2"), match("a", "a", "2", url="l"))
    got = {r["team_id"]: tuple(r)[1:] for r in graph.teams(df).collect()}
    assert got == {"1": ("New", "NEW", "one", None), "2": ("Label 2", None, None, None)}
    assert graph.assigned_leagues(df.where("false"), F.lit(False)).count() == 0
