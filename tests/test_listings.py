"""Listing and detail pages, live feeds and rendered line-ups, against rows made by hand."""

import json

import pytest
from oddslake.plans import listings

ROLES = ("TOP", "JUNGLE", "MID", "BOTTOM", "SUPPORT")


def page(body, *records):
    stream = "".join(f"{k:x}:{json.dumps(r)}\n" for k, r in enumerate(records))
    half = len(stream) // 2  # a record may be split over two scripts
    return f"<html><body>{body}" + "".join(f"<script>self.__next_f.push([1,{json.dumps(x)}])</script>" for x in (stream[:half], stream[half:])) + "</body></html>"


def event(k, **changes):
    out = {"id": f"m{k}", "slug": f"s{k}", "date": "$D2024-05-01T18:00:00.000Z", "state": "COMPLETED", "best_of": 3, "team1": {"id": "t1", "name": "Équipe & One", "code": "EO", "image": "a"}, "team2": {"id": "t2", "name": "Two", "code": "TW.A"}, "team1_name": "TBD", "team2_name": "Deux", "team1_score": 2, "team2_score": 0, "stage": {"tournament": {"id": "", "name": "Spring Cup 2024 "}}}
    return out | changes


def links(*slugs):
    return "<main>" + "".join(f'<a href="/match/{x}">x</a>' for x in slugs) + "</main>"


def listed(spark, *pages):
    rows = [(k, f"/matches/all/{k}", html) for k, html in enumerate(pages)]
    return listings.listing_rows(spark.createDataFrame(rows, "page_id long, url string, html string"))


def test_matches_and_issues_of_listing_pages(spark):
    open_side, same, nameless = event(2, team1={"id": ""}), event(3, team2=event(3)["team1"]), event(4, stage={})
    first = page(links("s1", "s2", "s3", "s4", "s5", "s6", "s7"), {"matches": [event(1, best_of=1), {"deeper": event(1)}, open_side, same, nameless, event(5, state="ODD"), event(6, postponed=True), event(7, state="UNSTARTED"), event(8)]})
    rows = listed(spark, first, page(links("s1"), event(1, date="2024-05-01T18:00:00")), page("<p>", event(1)), page(links("s1"), event(2)), page(links(), {"matches": []}), page(links()), page(links(), {"matches": [1]}), "", None, first.replace("0:{", "zz{"))
    known = {r["source_id"]: r for r in listings.listed_events(rows).collect()}
    assert sorted(known) == ["m1", "m6", "m7"]
    one = known["m1"]
    assert (one["best_of"], one["status"], one["home_score"], one["away_score"], one["path"]) == (3, "finished", 2, 0, "/match/s1")
    assert (one["home_names"], one["away_names"]) == (["equipe and one"], ["two", "deux"])
    assert one["competition_slug"] == one["competition_source_id"] == "spring-cup-2024"
    assert (known["m6"]["status"], known["m7"]["status"], known["m7"]["home_score"]) == ("postponed", "scheduled", None)
    issues = {(r["page_id"], r["source_id"], r["issue"]) for r in listings.listing_issues(rows).collect()}
    assert issues == {(0, "m5", "unknown-state"), (1, None, "time-without-offset"), (2, None, "no-main-content"), (3, None, "no-identities"), (5, None, "no-records"), (6, None, "no-identities"), (7, None, "no-main-content"), (8, None, "no-main-content"), (9, None, "unsound-stream")}


def test_matches_that_no_link_names_are_an_issue_where_there_are_no_links(spark):
    rows = listed(spark, page(links(), {"matches": [event(1), event(2)]}), page(links(), event(1)), page(links(), {"matches": []}, {"matches": [event(1)]}))
    assert [tuple(r) for r in listings.listing_issues(rows).orderBy("page_id").collect()] == [(0, None, "no-identities"), (1, None, "no-identities")]


def test_further_pages_are_those_of_the_navigation(spark):
    bar = '<nav><a href="/matches/all/2">2</a><a class="n" href="/matches/results/all/1">r</a><a href="/matches/all/2">2</a><a href="/matches/all/x">x</a></nav><a href="/matches/all/9">9</a>'
    found = listings.further_pages(spark.createDataFrame([(1, bar), (2, None)], "page_id long, html string"))
    assert [tuple(r) for r in found.collect()] == [(1, "/matches/all/2"), (1, "/matches/results/all/1")]


def player(k, tag="", **changes):
    out = {"id": f"p{k}", "summoner_name": f"{tag}Name {k}", "role": ROLES[k], "champion_id": f"c{k}", "kills": k, "deaths": 0, "assists": 1, "creep_score": 100, "total_gold_earned": 9000 + k}
    return out | changes


def side(name, camp, tag="", players=range(5), **changes):
    return {"id": f"side-{name}", "side": camp, "team": {"name": name, "code": "EO" if name != "Two" else "TW.A"}, "players": [player(k, tag) for k in players], "towers": 7, "dragons": 3, "win": name != "Two", "bans": [{"champion_id": "x"}, {"champion_id": ""}]} | changes


def game(k=1, **changes):
    return {"id": f"g{k}", "number": k, "state": "COMPLETED", "duration": 0, "teams": [side("Two", "BLUE"), side("Équipe & One", "RED")]} | changes


def detail(*games, header=None, **changes):
    head = header or '<section><a href="/team/1" aria-label="&Eacute;"></a>'.replace("&Eacute;", "Équipe &amp; One") + '<a aria-label="Deux" href="/team/2"></a><span>2<!-- --> : <!-- -->1</span> <b>BO 5</b></section>'
    return page(f"<main>{head}</main>", {"matchId": "m1", "matchDate": "2024-05-01T19:00:00Z", "state": "STARTED", "games": list(games)} | changes)


def details(spark, *pages, scored=False):
    events = listings.listed_events(listed(spark, page(links("s1"), event(1))))
    rows = [(k, "m1", html) for k, html in enumerate(pages)]
    return listings.match_details(spark.createDataFrame(rows, "page_id long, source_id string, html string"), events, scored)


def test_a_page_tells_its_match_or_an_issue(spark):
    two = page("<main><section></section></main>", {"matchId": "m1", "games": []}, {"matchId": "m1", "games": []})
    turned = '<section><a href="/team/2" aria-label="Two"></a><a href="/team/1" aria-label="Équipe &amp; One"></a></section>'
    unscored = '<section><a href="/team/1" aria-label="Équipe &amp; One"></a><a href="/team/2" aria-label="Two"></a><span>1:0</span><span>1:1</span></section>'
    pages = [detail(game()), two, detail(header=turned), detail(header=unscored), detail(state="ODD"), detail(matchDate="2024-05-01"), detail(matchId="m2"), page("<main></main>"), None]
    found = {r["page_id"]: r for r in details(spark, *pages).collect()}
    assert [found[k]["issue"] for k in range(9)] == [None, "not-this-match", "other-teams", None, "unknown-state", "time-without-offset", "not-this-match", "no-header", "no-header"]
    assert [(found[k]["home_score"], found[k]["away_score"], found[k]["best_of"], found[k]["status"]) for k in (0, 3)] == [(2, 1, 5, "live"), (2, 0, 3, "live")]
    assert details(spark, pages[3], scored=True).collect()[0]["issue"] == "no-score"


def test_games_of_a_page_are_maps_if_they_are_sound(spark):
    both_won, unknown_team = [side("Two", "BLUE", win=True), side("Équipe & One", "RED")], [side("Two", "BLUE"), side("Three", "RED")]
    games = [game(1), game(2, teams=both_won), game(3, teams=unknown_team), game(4, state="STARTED", teams=both_won), game(5, teams=[side("Two", "BLUE", players=range(4)), side("Équipe & One", "RED")]), game(6), game(0), game(7, number=2, state="UNSTARTED")]
    maps = {r["number"]: r for r in listings.published_maps(listings.source_games(details(spark, detail(*games)))).collect()}
    assert sorted(maps) == [1, 4, 5]
    home, away = maps[1]["sides"]
    assert (home["position"], home["side"], home["towers"], home["dragons"], home["bans"], maps[1]["winner"], maps[1]["seconds"]) == ("home", "red", 7, 3, ["x"], "home", None)
    assert [(p["role"], p["cs"], p["gold"]) for p in away["players"]][1] == ("JGL", 100, 9001)
    assert maps[4]["winner"] is None
    assert (maps[5]["sides"][1]["players"], maps[5]["sides"][1]["towers"], maps[5]["sides"][1]["side"]) == ([], None, None)


def feed(teams, **changes):
    return {"id": "g1", "type": "feed", "timestamp": "2024-05-01T19:30:00Z", "state": "STARTED", "teams": teams, "events": [{"type": "START", "clock": 0}, {"type": "KILL", "clock": 61000}]} | changes


def camp(name, side_name, tag, **changes):
    out = side(name, side_name, tag) | {"dragons": ["fire", "air"]} | changes
    return {k: v for k, v in out.items() if k not in ("id", "team", "win")}


TWO, ONE = camp("", "RED", "tw "), camp("", "BLUE", "EO ")
FEEDS = {
    "swapped": (feed([ONE, TWO]), None),
    "suffixed": (feed([camp("", "RED", "TW.A "), ONE]), None),
    "shared": (feed([TWO, camp("", "BLUE", "TW ")]), "repeated-team"),
    "one-camp": (feed([TWO, camp("", "RED", "EO ")]), "repeated-team"),
    "missing": (feed([TWO | {"players": [player(k, "TW " if k else "") for k in range(5)]}, ONE]), "ambiguous-team"),
    "inside": (feed([TWO, camp("", "BLUE", "EOX ")]), "ambiguous-team"),
    "four": (feed([TWO | {"players": TWO["players"][:4]}, ONE]), "incomplete-line-up"),
    "no-camp": (feed([TWO | {"side": "GREEN"}, ONE]), "incomplete-line-up"),
    "single": (feed([TWO]), "not-two-teams"),
    "no-teams": (feed(None), "not-two-teams"),
    "other": (feed([TWO, ONE], id="g2"), "other-game"),
    "kind": (feed([TWO, ONE], type="window"), "other-game"),
    "untimed": (feed([TWO, ONE], timestamp="2024-05-01T19:30:00"), "time-without-offset"),
    "roles": (feed([TWO | {"players": [player(k, "TW ", role="MID") for k in range(5)]}, ONE]), "incomplete-statistics"),
}


@pytest.mark.parametrize("state", ["UNSTARTED", "COMPLETED"])
def test_feeds_meet_teams_by_their_players_tags(spark, state):
    games = listings.source_games(details(spark, detail(game(state=state))))
    named = None
    for k in FEEDS:  # one table of games, each under the name of its feed
        own = games.selectExpr(f"'{k}' AS source_id", "home_names", "away_names", "home_code", "away_code", "game")
        named = own if named is None else named.unionByName(own)
    feeds = spark.createDataFrame([(k, "g1", json.dumps(x)) for k, (x, _) in FEEDS.items()] + [("lost", "g1", json.dumps(feed([TWO, ONE]))), ("broken", "g1", "{"), ("empty", "g1", None)], "source_id string, game_id string, data string")
    found = {r["source_id"]: r for r in listings.merged_feeds(named, feeds).collect()}
    assert {k: r["issue"] for k, r in found.items()} == {k: issue for k, (_, issue) in FEEDS.items()} | {"lost": "unknown-game", "broken": "other-game", "empty": "other-game"}
    for k in ("swapped", "suffixed"):
        home, away = found[k]["sides"]
        assert (home["side"], away["side"], away["players"][2]["name"]) == ("blue", "red", "Name 2")
        assert (home["dragons"], home["towers"], home["heralds"], home["bans"]) == (2, 7, None, ["x"])
        assert (found[k]["seconds"], found[k]["status"], found[k]["winner"]) == ((61, "live", None) if state == "UNSTARTED" else (61, "finished", "home"))
    assert found["shared"]["sides"] is None


def test_rendered_line_ups_need_a_team_five_figures_and_five_roles(spark):
    both = details(spark, detail(game(1), game(2), game(3)))
    maps, events = listings.published_maps(listings.source_games(both)), both.select("source_id", "home_names", "away_names")
    shown = lambda k, **more: {"name": f"NAME {k}", "champion": f"c{k}" if k else "new", "kills": 9, "deaths": 1, "assists": 2, "cs": 50} | more
    team = lambda name, players, **more: {"name": name, "players": players} | more
    five = [shown(k) for k in range(5)]
    rendered = [
        ("m1", 1, {"durationSeconds": 1800, "teams": [team("Deux", five, towers=3), team("Equipe and One", five[:4])]}),
        ("m1", 2, {"teams": [team("Two", five), team("Deux", five), team("Équipe & One", [*five[:4], shown(4, kills=None)])]}),
    ]
    roles = listings.page_roles(spark.createDataFrame([("m1", page("", [{"role": r, "player": {"summoner_name": f"Name {k}"}} for k, r in enumerate(ROLES)] + [{"role": "MID", "player": {"summoner_name": "Twice"}}, {"role": "TOP", "player": {"summoner_name": "twice"}}]))], "source_id string, html string"))
    assert len(roles.collect()[0]["roles"]) == 5
    out = {r["number"]: r for r in listings.rendered_line_ups(maps, events, spark.createDataFrame([(a, b, json.dumps(c)) for a, b, c in rendered], "source_id string, number long, data string"), roles).collect()}
    home, away = out[1]["sides"]
    assert (out[1]["from_page"], out[1]["seconds"], away["towers"], home["towers"], home["players"][0]["kills"]) == (True, 1800, 3, 7, 0)
    assert [(p["id"], p["role"], p["kills"], p["gold"]) for p in away["players"]][:2] == [("name 0", "TOP", 9, None), ("name 1", "JGL", 9, 9001)]
    assert not out[2]["from_page"] and not out[3]["from_page"]
    assert out[2]["sides"] == out[3]["sides"]


def test_a_feed_is_read_once_and_its_events_are_put_in_order_once(spark, sf_dir):
    from oddslake.plans.series import frame_seconds

    plan = listings.tagged_feeds(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    events = spark.createDataFrame([([("START", 0, None, None), ("PAUSE", 5000, "start", None), ("PAUSE", 9000, "end", None), ("KILL", 61000, None, None)],), ([],), (None,)], "events array<struct<type:string,clock:long,value:string,clock_end:long>>")
    seconds = events.select(frame_seconds(events["events"]).alias("s"))
    assert seconds._jdf.queryExecution().analyzed().toString().count("array_sort") == 1
    assert [r["s"] for r in seconds.collect()] == [57, None, None]
