"""Series: bans, played time, folded maps and the match list, on rows made by hand."""

import json
from datetime import datetime

import pytest
from oddslake.plans import listing, series
from pyspark.sql import functions as F


def bans_of(spark, bans):
    df = spark.createDataFrame([(json.dumps(bans),)], "j string").select(F.from_json("j", series.BANS).alias("b"))
    return [(b["teamId"], b["champion"], b["championImage"]) for b in df.select(series.distinct_bans(F.col("b")).alias("o")).first()["o"]]


def ban(team, champion=None, image=None):
    return {"teamId": team, "champion": champion, "championImage": image}


def test_bans_are_distinct(spark):
    assert bans_of(spark, [ban("a", "Ahri"), ban("a", " AHRI "), ban("b", "Ahri")]) == [("a", "Ahri", None), ("b", "Ahri", None)]
    # a named ban takes the place of the unnamed one with its image
    assert bans_of(spark, [ban("a", None, "x.png"), ban("b", "Zed"), ban("a", "Ahri", "x.png"), ban("a", None, "x.png")]) == [("a", "Ahri", "x.png"), ("b", "Zed", None)]
    assert bans_of(spark, [ban(None, "Ahri"), ban("a"), ban("a", "  "), ban("a", None, "y"), ban("a", None, "y")]) == [("a", None, "y")]
    assert bans_of(spark, None) == [] and bans_of(spark, []) == []
    assert bans_of(spark, [ban("a", f"c{k}") for k in range(6)]) == []
    assert len(bans_of(spark, [ban("ab"[k % 2], f"c{k}") for k in range(10)])) == 10
    assert bans_of(spark, [ban("abc"[k % 3], f"c{k}") for k in range(11)]) == []


EVENTS = "array<struct<type:string,clock:long,value:string,clock_end:long>>"


@pytest.mark.parametrize(
    ("events", "seconds"),
    [
        ([("START", 0), ("END", 60_999)], 60),
        ([("START", 0), ("PAUSE", 10_000, "start"), ("PAUSE", 20_000, "end"), ("END", 60_000)], 50),
        ([("START", 0), ("PAUSE", 10_000, "start", 15_000), ("END", 60_000)], 55),
        # overlapping pauses count each
        ([("START", 0), ("PAUSE", 10_000, "start", 30_000), ("PAUSE", 20_000, "start", 40_000), ("END", 100_000)], 60),
        # an open pause ends the frame
        ([("START", 0), ("KILL", 5_000), ("PAUSE", 30_000, "start"), ("END", 60_000)], 30),
        # a resume without a pause
        ([("START", 0), ("PAUSE", 20_000, "end"), ("END", 60_000)], None),
        ([("PAUSE", 1_000, "end"), ("START", 2_000), ("END", 62_000)], 60),
        ([("START", 0), ("PAUSE", 20_000, "start", 10_000), ("END", 60_000)], None),
        ([("START", 0), ("PAUSE", 20_000, "odd"), ("END", 60_000)], None),
        ([("START", 0), ("END", None)], None),
        ([("PAUSE", 0, "start", 5)], None),
        ([], None),
        (None, None),
        ([("END", 60_000), ("START", 0)], 60),
    ],
)
def test_played_time(spark, events, seconds):
    rows = None if events is None else [tuple([*e, None, None][:4]) for e in events]
    df = spark.createDataFrame([("f", rows)], f"id string, events {EVENTS}")
    assert series.frame_durations(df).first()["seconds"] == seconds


def player(role, name, **more):
    return {"role": role, "name": name} | more


def game(**more):
    return {"number": 1, "status": "finished", "winnerId": "a", "sourceGameId": "g", "sides": [{"teamId": "a", "players": []}, {"teamId": "b", "players": []}]} | more


def fold(spark, *maps):
    rows = [("m", 1, datetime(2024, 1, 1, 0, k), f"s{k}", json.dumps(m)) for k, m in enumerate(maps)]
    df = spark.createDataFrame(rows[::-1], "match_id string, number int, observed_at timestamp, id string, j string").withColumn("map", F.from_json("j", series.MAP))
    return series.folded_maps(df).first()["map"].asDict(recursive=True)


def test_a_later_map_keeps_what_it_lacks(spark):
    five = [player(r, f"P{r}", champion="Ahri", kills=3) for r in ("TOP", "JGL", "MID", "BOT", "SUP")]
    old = game(durationSeconds=1800, durationSource="archive", updatedAt="t0", bans=[ban("a", "Ahri"), ban("b", "Zed")], sides=[{"teamId": "a", "side": "blue", "towers": 7, "players": five}, {"teamId": "b", "dragons": 2, "players": []}])
    new = game(updatedAt="t1", bans=[ban("a", "Ahri")], sides=[{"teamId": "b", "dragons": 0, "towers": 1, "players": []}, {"teamId": "a", "players": []}])
    got = fold(spark, old, new)
    assert (got["durationSeconds"], got["durationSource"], got["updatedAt"]) == (1800, "archive", "t0")
    assert [b["champion"] for b in got["bans"]] == ["Ahri", "Zed"]
    sides = {s["teamId"]: s for s in got["sides"]}
    assert (sides["b"]["dragons"], sides["b"]["towers"]) == (0, 1)  # an explicit zero stands
    assert (sides["a"]["side"], sides["a"]["towers"], len(sides["a"]["players"])) == ("blue", 7, 5)


def test_players_are_filled_by_role_and_name(spark):
    old = game(sides=[{"teamId": "a", "players": [player("MID", "Faker", champion="Ahri", kills=4, cs=200), player("TOP", "Zeus", champion="Jax", kills=1)]}, {"teamId": "b", "players": []}])
    new = game(sides=[{"teamId": "a", "players": [player("MID", "FAKER", champion="", kills=5), player("TOP", "Zeus", champion="Gnar")]}, {"teamId": "b", "players": []}])
    mid, top = fold(spark, old, new)["sides"][0]["players"]
    assert (mid["name"], mid["champion"], mid["kills"], mid["cs"]) == ("FAKER", "Ahri", 5, 200)
    assert (top["champion"], top["kills"]) == ("Gnar", None)  # another champion: nothing is carried over


@pytest.mark.parametrize("change", [{"winnerId": "b"}, {"sourceGameId": "h"}, {"status": "live"}])
def test_other_games_are_not_merged(spark, change):
    got = fold(spark, game(durationSeconds=5, bans=[ban("a", "Ahri")]), game(**change))
    assert got["durationSeconds"] is None and got["bans"] is None


def test_durations_and_bans_with_conditions(spark):
    clock = game(durationSeconds=10, durationSource=series.EVENT_CLOCK)
    assert fold(spark, clock, game(durationSeconds=20, durationSource="x"))["durationSeconds"] == 10
    with_players = game(durationSeconds=20, durationSource="x", sides=[{"teamId": "a", "players": [player("MID", "F")]}, {"teamId": "b"}])
    assert fold(spark, clock, with_players)["durationSeconds"] == 20
    got = fold(spark, game(bans=[ban("a", "Ahri")]), game(bans=[ban("a", "Jax")]))
    assert [b["champion"] for b in got["bans"]] == ["Jax"]


def test_a_live_refresh_without_players_changes_nothing(spark):
    live = game(status="live", winnerId=None, updatedAt="t0", sides=[{"teamId": "a", "players": [player("MID", "F")]}, {"teamId": "b"}])
    assert fold(spark, live, game(status="live", winnerId=None, updatedAt="t1"))["updatedAt"] == "t0"
    assert fold(spark, live, game(status="live", winnerId=None, updatedAt="t1", sourceGameId="other"))["updatedAt"] == "t1"


DAY = datetime(2024, 1, 10, 12)


def listed(spark, matches, snapshots, links=()):
    m = spark.createDataFrame([(i, "l", "a", "b", at, source, "BO3", DAY) for i, at, source in matches], "match_id string, league_id string, home_id string, away_id string, starts_at timestamp, source string, format string, registered_at timestamp")
    s = spark.createDataFrame([(f"s{k:02d}", i, source, status, datetime(2024, 1, 10, 12, k), json.dumps(payload)) for k, (i, source, status, payload) in enumerate(snapshots)], "snapshot_id string, match_id string, source string, status string, observed_at timestamp, j string")
    li = spark.createDataFrame(list(links), "match_id string, provider string, last_seen_at timestamp")
    out = listing.listed_matches(m, s.withColumn("payload", F.from_json("j", listing.PAYLOAD)).drop("j"), li, F.lit("2024-01-10").cast("date"))
    return {r["match_id"]: r.asDict(recursive=True) for r in out.collect()}


def whole(*winners, **more):
    return {"format": "BO3", "completionBasis": "sourced-format", "maps": [game(number=k + 1, winnerId=w, sourceGameId=None) for k, w in enumerate(winners)]} | more


def test_match_list_chooses_the_snapshot(spark):
    live = {"format": "BO3", "currentScore": {"home": 1, "away": 0}, "maps": []}
    got = listed(
        spark,
        [("done", DAY, "loltv"), ("walk", DAY, "loltv"), ("old", datetime(2024, 1, 2, 22, 59), "loltv"), ("edge", datetime(2024, 1, 2, 23), "loltv"), ("retired", DAY, "sofascore"), ("seen", DAY, "sofascore"), ("none", DAY, "loltv"), ("odd", DAY, "loltv")],
        [
            ("done", "oracles-elixir", "finished", whole("a", "b", "a", patch="14.1")),
            ("done", "loltv", "live", live | {"stage": "Final"}),
            ("walk", "oracles-elixir", "finished", whole("a", "a")),
            ("walk", "loltv", "walkover", live),
            ("retired", "sofascore", "finished", whole("a", "a")),
            ("seen", "sofascore", "finished", whole("a", "a")),
            ("seen", "loltv", "live", live),
            ("none", "oracles-elixir", "finished", whole("a", "b", patch="x")),  # no side has won
            ("odd", "loltv", "surprising", live),
        ],
        [("done", "loltv", datetime(2024, 1, 11)), ("done", "oracles-elixir", datetime(2024, 1, 12)), ("done", "oracles-elixir", datetime(2024, 1, 10))],
    )
    assert set(got) == {"done", "walk", "edge", "seen", "none", "odd"}
    done = got["done"]
    assert (done["status"], done["score"], done["patch"], done["stage"], done["updated_at"]) == ("finished", {"home": 2, "away": 1}, "14.1", None, datetime(2024, 1, 12))
    assert [m["winnerId"] for m in done["maps"]] == ["a", "b", "a"]
    assert got["walk"]["status"] == "walkover" and got["walk"]["maps"] == []
    assert got["seen"]["status"] == "live" and got["seen"]["updated_at"] == datetime(2024, 1, 10, 12, 6)
    assert (got["none"]["status"], got["none"]["score"], got["none"]["updated_at"]) == ("scheduled", None, DAY)
    assert (got["odd"]["status"], got["odd"]["score"]) == ("scheduled", None)


def test_match_list_shows_only_possible_maps(spark):
    live = lambda score, *maps: {"format": "BO3", "currentScore": dict(zip(("home", "away"), score, strict=True)), "maps": list(maps)}
    running = game(number=2, status="live", winnerId=None, sourceGameId="x")
    got = listed(
        spark,
        [(i, DAY, "loltv") for i in ("ok", "late", "over", "sides")],
        [
            ("ok", "loltv", "live", live((1, 0), game(durationSeconds=9))),
            ("ok", "loltv", "live", live((1, 0), game(), running)),
            ("late", "loltv", "live", live((0, 0), running)),  # the second map can't run at 0:0
            ("over", "loltv", "live", live((0, 0), game())),  # a won map that the score doesn't know
            ("sides", "loltv", "live", live((1, 0), game(sides=[{"teamId": "a"}, {"teamId": "z"}]), game(number=4))),
        ],
    )
    assert [(m["number"], m["status"], m["durationSeconds"]) for m in got["ok"]["maps"]] == [(1, "finished", 9), (2, "live", None)]
    assert got["late"]["maps"] == got["over"]["maps"] == got["sides"]["maps"] == []
