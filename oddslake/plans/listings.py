"""Matches from listing and detail pages, with live feeds and rendered line-ups merged into their games.

Python reads a page's stream once; all rules are column expressions on the page's own row, so
that pages meet events, feeds and games by one join on their ids and are never grouped.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake.functions import moments, text
from oddslake.operators.latest import top_n
from oddslake.plans.series import frame_seconds
from oddslake.sources.pages import flight_records, nested_objects
from oddslake.sources.tables import table

#: Objectives of a side, and what pages and feeds call them (fixed values).
OBJECTIVES = {"towers": "towers", "dragons": "dragons", "barons": "barons", "heralds": "herald", "grubs": "horde", "inhibitors": "inhibitors"}
#: Figures of a player and what pages and feeds call them; those that a sound player has (fixed values).
FIGURES = {"level": "level", "kills": "kills", "deaths": "deaths", "assists": "assists", "cs": "creep_score", "gold": "total_gold_earned"}
NEEDED = ("kills", "deaths", "assists", "cs")
#: Camps as they are written, and the number of players of a side and of maps of a match (fixed values).
CAMPS = ("BLUE", "RED")
LINE_UP, MOST_MAPS = 5, 5

_PLAYER = "struct<id:string,summoner_name:string,role:string,champion_id:string," + ",".join(f"{c}:long" for c in FIGURES.values()) + ">"
_SIDE = f"id:string,side:string,win:boolean,team_name:string,team:struct<name:string,code:string>,players:array<{_PLAYER}>,bans:array<struct<champion_id:string>>," + ",".join(f"{c}:string" for c in OBJECTIVES.values())
_GAME = f"id:string,number:long,state:string,duration:long,teams:array<struct<{_SIDE}>>"
_NAMED = "struct<id:string,name:string,code:string,image:string>"
_EVENT = f"id string, slug string, date string, state string, postponed boolean, best_of long, team1 {_NAMED}, team2 {_NAMED}, team1_name string, team2_name string, team1_score long, team2_score long, stage struct<tournament:{_NAMED}>, matches string"
_DETAIL = f"matchId string, matchDate string, state string, games array<struct<{_GAME}>>"
_FEED = f"id string, type string, timestamp string, state string, teams array<struct<{_SIDE}>>, events array<struct<type:string,clock:long,value:string,clock_end:long>>"
_RENDERED = "durationSeconds long, teams array<struct<name:string,towers:long,players:array<struct<name:string,champion:string,level:long,kills:long,deaths:long,assists:long,cs:long>>>>"


def page_stream(*shapes: tuple[str, ...]):
    """A function of a page's HTML: struct(issue, objects), the objects of its stream that have all keys of one of ``shapes``.

    Objects are JSON texts in the order of the page. A stream that is cut off or has an
    unkeyed record is "unsound-stream", one without records "no-records".
    """

    def objects(html: str | None) -> tuple[str | None, list[str]]:
        try:
            records = flight_records(html)
        except ValueError:
            return "unsound-stream", []
        found = (x for x in nested_objects(list(records.values())) if any(all(k in x for k in s) for s in shapes))
        return (None if records else "no-records"), [json.dumps(x) for x in found]

    @F.pandas_udf("issue string, objects array<string>")
    def read(html: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([objects(x) for x in html], columns=["issue", "objects"])

    return read


def _first_issue(rules: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(rule, issue) for issue, rule in rules.items()])


def _main(html: str) -> Column:
    return F.regexp_extract(html, r"(?s)<main\b[^>]*>(.*)</main>", 1)


def _unescaped(c: Column) -> Column:
    pairs = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&#x27;": "'", "&amp;": "&"}
    return reduce(lambda out, pair: F.replace(out, F.lit(pair[0]), F.lit(pair[1])), pairs.items(), c)


def _not_below_zero(c: Column) -> Column:
    return F.when(c >= 0, c)


def _state(c: Column) -> Column:
    return text.looked_up(c, text.STATES)


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def _name_keys(name: Column, alias: Column) -> Column:
    """The name keys that stand for a side: its team's name and, unless it is open, the name that the listing shows."""
    shown = F.when(~F.lower(alias).eqNullSafe("tbd"), alias)
    return F.array_distinct(F.filter(F.transform(F.array(name, shown), text.plain_name), lambda k: k.isNotNull()))


def listing_rows(pages: DataFrame) -> DataFrame:
    """What listing pages say, one row a match or issue; ``pages``: page_id, url, html.

    An issue without source_id is its whole page's, which then gives no match: no main
    content, an unsound stream, a start without an offset, or no match at all where the
    page has links or does not say that it is empty. Only objects whose slug the main
    content links are matches of the page. Matches with a side that is open or twice the
    same, or without a competition, give no row; those of unknown state give an issue. Of
    several objects of one match the last one that gives a row counts.
    """
    page = pages.select("page_id", F.col("url").alias("listing_url"), F.col("html").rlike(r"<main\b").alias("whole"), F.regexp_extract_all(_main("html"), F.lit(r'<a\b[^>]*\bhref="/match/([^"]*)"'), 1).alias("slugs"), page_stream(("slug", "id", "date"), ("matches",))("html").alias("stream"))
    parsed = page.withColumn("rows", F.transform("stream.objects", lambda x: F.from_json(x, _EVENT)))
    own = F.filter("rows", lambda r: F.array_contains("slugs", r["slug"]) & _filled(r["id"]) & r["date"].isNotNull())
    start = lambda r: moments.instant(F.regexp_replace(r["date"], r"^\$D", ""))
    parsed = parsed.withColumn("own", F.transform(own, lambda r: F.struct(start(r).alias("starts_at"), r.alias("r"))))
    says_empty = F.exists("rows", lambda r: F.coalesce(r["matches"] == "[]", F.lit(False)))  # matches themselves have no such field
    issue = _first_issue({"no-main-content": ~F.coalesce("whole", F.lit(False)), "stream": F.col("stream.issue").isNotNull(), "time-without-offset": F.exists("own", lambda x: x["starts_at"].isNull()), "no-identities": (F.size("own") == 0) & ((F.size("slugs") > 0) | ~says_empty)})
    checked = parsed.withColumn("page_issue", F.when(issue == "stream", F.col("stream.issue")).otherwise(issue))
    # a page without matches gives one row without one, so that it is read and parsed once for its matches and issues
    rows = checked.select("page_id", "listing_url", "page_issue", F.posexplode_outer(F.when(F.col("page_issue").isNull(), F.col("own"))).alias("place", "x")).select("page_id", "listing_url", "page_issue", "place", "x.starts_at", "x.r.*")
    tournament = F.col("stage.tournament")
    rows = rows.where(F.col("page_issue").isNotNull() | _filled(F.col("team1.id")) & _filled(F.col("team2.id")) & (F.col("team1.id") != F.col("team2.id")) & _filled(tournament["name"]))
    state = F.when(_state(F.col("state")).isNotNull(), F.when(F.col("postponed"), "postponed").otherwise(_state(F.col("state"))))
    slug = F.regexp_replace(F.regexp_replace(text.plain_name(tournament["name"]), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    rows = rows.withColumns({"status": state, "competition_slug": slug})
    score = lambda c: F.when(F.col("status") != "scheduled", _not_below_zero(F.col(c)))
    out = rows.select(
        "page_id", "listing_url", "place", F.coalesce("page_issue", F.when(F.col("status").isNull(), "unknown-state")).alias("issue"), F.col("id").alias("source_id"), F.concat(F.lit("/match/"), "slug").alias("path"), "starts_at", "status",
        F.col("team1.name").alias("home_name"), F.col("team2.name").alias("away_name"), F.col("team1.id").alias("home_source_id"), F.col("team2.id").alias("away_source_id"), F.col("team1.image").alias("home_image"), F.col("team2.image").alias("away_image"),
        F.col("team1.code").alias("home_code"), F.col("team2.code").alias("away_code"), _name_keys(F.col("team1.name"), F.col("team1_name")).alias("home_names"), _name_keys(F.col("team2.name"), F.col("team2_name")).alias("away_names"),
        tournament["name"].alias("competition"), F.when(_filled(tournament["id"]), tournament["id"]).otherwise(F.col("competition_slug")).alias("competition_source_id"), "competition_slug", tournament["image"].alias("competition_image"),
        _not_below_zero(F.col("best_of")).alias("best_of"), score("team1_score").alias("home_score"), score("team2_score").alias("away_score"),
    )
    return top_n(out, ["page_id", "source_id", "issue"], [F.desc("place")])


def listed_events(rows: DataFrame) -> DataFrame:
    """Matches of ``listing_rows`` without an issue."""
    return rows.where("issue is null").drop("issue", "place")


def listing_issues(rows: DataFrame) -> DataFrame:
    """(page_id, source_id, issue): what was set aside; source_id is null where it is the whole page."""
    return rows.where("issue is not null").select("page_id", "source_id", "issue")


def further_pages(pages: DataFrame) -> DataFrame:
    """(page_id, path): the other listing pages that a page's navigation names, each once."""
    bars = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<nav\b[^>]*>(.*?)</nav>"), 1), " ")
    paths = F.regexp_extract_all(bars, F.lit(r'<a\b[^>]*\bhref="(/matches/(?:results/)?all/\d+)"'), 1)
    return pages.select("page_id", F.explode(F.array_sort(F.array_distinct(paths))).alias("path"))


def match_details(pages: DataFrame, events: DataFrame, scored: bool = False) -> DataFrame:
    """Events of a listing as their own pages tell them, with games as the page has them, or an issue.

    ``pages``: page_id, source_id, html; ``events`` as of ``listed_events``. Exactly one
    object of the stream must be of the match and have games, and the header must name both
    teams in order; with ``scored`` it must also show one score. Otherwise what the page
    does not say stays as listed.
    """
    read = pages.select("page_id", "source_id", F.regexp_replace("html", r"(?s)<!--.*?-->", " ").alias("html"), page_stream(("matchId", "games"))("html").alias("stream"))
    header = F.regexp_extract(_main("html"), r"(?s)<section\b[^>]*>(.*?)</section>", 1)
    page = read.select("page_id", "source_id", "stream", _main("html").rlike(r"<section\b").alias("headed"), header.alias("header"))
    links = F.filter(F.regexp_extract_all("header", F.lit(r"(<a\b[^>]*>)"), 1), lambda a: a.rlike(r'\bhref="/team/') & a.rlike(r'\baria-label="'))
    labels = F.transform(links, lambda a: text.plain_name(_unescaped(F.regexp_extract(a, r'\baria-label="([^"]*)"', 1))))
    scores = F.regexp_extract_all("header", F.lit(r"<span\b[^>]*>\s*(\d+\s*:\s*\d+)\s*</span>"), 1)
    shown = F.regexp_extract(F.regexp_replace("header", "<[^>]*>", " "), r"\bBO\s*(\d+)\b", 1)
    page = page.select("page_id", "source_id", F.col("stream.issue").alias("stream_issue"), "stream.objects", F.coalesce("headed", F.lit(False)).alias("headed"), labels.alias("labels"), scores.alias("scores"), shown.alias("shown"))
    rows = page.join(events.drop("page_id", "listing_url"), "source_id")
    rows = rows.withColumn("own", F.filter(F.transform("objects", lambda x: F.from_json(x, _DETAIL)), lambda r: r["matchId"] == F.col("source_id")))
    record, score = F.get("own", F.lit(0)), F.when(F.size("scores") == 1, F.split(F.get("scores", F.lit(0)), r"\s*:\s*"))
    named = (F.size("labels") == 2) & F.array_contains("home_names", F.get("labels", F.lit(0))) & F.array_contains("away_names", F.get("labels", F.lit(1)))
    start = moments.instant(F.regexp_replace(record["matchDate"], r"^\$D", ""))
    rules = {
        "no-header": ~F.col("headed"), "stream": F.col("stream_issue").isNotNull(), "not-this-match": F.size("own") != 1, "other-teams": ~F.coalesce(named, F.lit(False)),
        "no-score": F.lit(scored) & score.isNull(), "unknown-state": _state(record["state"]).isNull(), "time-without-offset": start.isNull(),
    }
    issue = _first_issue(rules)
    told = {
        "issue": F.when(issue == "stream", F.col("stream_issue")).otherwise(issue), "status": _state(record["state"]), "starts_at": start, "best_of": F.coalesce(F.when(F.col("shown") != "", F.col("shown").try_cast("long")), F.col("best_of")),
        "home_score": F.coalesce(F.get(score, F.lit(0)).try_cast("long"), F.col("home_score")), "away_score": F.coalesce(F.get(score, F.lit(1)).try_cast("long"), F.col("away_score")), "games": record["games"],
    }
    return rows.withColumns(told).drop("own", "objects", "labels", "scores", "shown", "headed", "stream_issue")


def source_games(details: DataFrame) -> DataFrame:
    """(source_id, home_names, away_names, home_code, away_code, game): games of sound details, one a row."""
    return details.where("issue is null").select("source_id", "home_names", "away_names", "home_code", "away_code", F.explode("games").alias("game"))


def _position(side: Column) -> Column:
    """home or away where a side's name is one of that team's only; the team's own name comes before the shown one."""
    key = text.plain_name(F.when(_filled(side["team"]["name"]), side["team"]["name"]).otherwise(side["team_name"]))
    return text.once(key, lambda k: F.when(F.array_contains("home_names", k) & ~F.array_contains("away_names", k), "home").when(F.array_contains("away_names", k) & ~F.array_contains("home_names", k), "away"))


def _players(side: Column) -> Column:
    """A side's five players of five roles with their figures; empty unless all are known."""
    figures = lambda p: {k: _not_below_zero(p[c]) for k, c in FIGURES.items()}
    sound = F.filter(side["players"], lambda p: text.looked_up(F.lower(p["role"]), text.ROLES).isNotNull() & _filled(p["summoner_name"]) & reduce(lambda a, b: a & b, [F.coalesce(figures(p)[c] >= 0, F.lit(False)) for c in NEEDED]))
    shaped = F.transform(sound, lambda p: F.struct(F.when(_filled(p["id"]), p["id"]).otherwise(p["summoner_name"]).alias("id"), p["summoner_name"].alias("name"), text.looked_up(F.lower(p["role"]), text.ROLES).alias("role"), F.when(_filled(p["champion_id"]), p["champion_id"]).alias("champion"), *[v.alias(k) for k, v in figures(p).items()]))
    whole = lambda x: (F.size(x) == LINE_UP) & (F.size(F.array_distinct(F.transform(x, lambda p: p["role"]))) == LINE_UP)
    return text.once(shaped, lambda x: F.when(whole(x), x).otherwise(F.slice(x, 1, 0)))


def _published_side(side: Column, position: Column) -> Column:
    """A side with its position; camp and objectives only beside a whole line-up, as an empty feed shows zeros that nobody has seen."""

    def shape(players: Column) -> Column:
        seen = F.size(players) == LINE_UP
        objectives = [F.when(seen, _not_below_zero(side[c].try_cast("long"))).alias(k) for k, c in OBJECTIVES.items()]
        bans = F.filter(F.transform(side["bans"], lambda b: b["champion_id"]), _filled)
        return F.struct(position.alias("position"), F.when(seen & side["side"].isin(*CAMPS), F.lower(side["side"])).alias("side"), players.alias("players"), *objectives, F.coalesce(bans, F.array().cast("array<string>")).alias("bans"), F.coalesce(side["win"], F.lit(False)).alias("win"))

    return text.once(_players(side), shape)


def _with_map(games: DataFrame, position: Callable[[Column], Column] = _position) -> DataFrame:
    """``games`` with number, status, seconds, winner and sides of their game, home first, and whether it is sound."""
    sides = F.filter(F.transform("game.teams", lambda s: _published_side(s, position(s))), lambda s: s["position"].isNotNull())
    home_first = lambda x: F.array_sort(x, lambda a, b: F.when(a["position"] == "home", -1).otherwise(1))
    rows = games.withColumns({"number": F.col("game.number"), "status": _state(F.col("game.state")), "seconds": F.when(F.col("game.duration") > 0, F.col("game.duration")), "sides": text.once(sides, lambda x: F.when(F.size(x) == 2, home_first(x)))})
    winners = F.filter("sides", lambda s: s["win"])
    two = F.get("sides", F.lit(0))["position"] != F.get("sides", F.lit(1))["position"]
    sound = F.col("number").between(1, MOST_MAPS) & F.col("status").isin("live", "finished") & two & ((F.col("status") == "live") | (F.size(winners) == 1))
    return rows.withColumns({"winner": F.when(F.col("status") == "finished", F.get(winners, F.lit(0))["position"]), "sound": F.coalesce(sound, F.lit(False))})


def published_maps(games: DataFrame) -> DataFrame:
    """(source_id, game_id, number, status, seconds, winner, sides) of games of ``source_games`` that are sound.

    Number 1 to 5, live or finished, one side of each team; a finished one has exactly one winner.
    """
    return _with_map(games).where("sound").select("source_id", F.col("game.id").alias("game_id"), "number", "status", "seconds", "winner", "sides")


def _codes(side: Column, position: Column) -> Column:
    """The tags that may stand before a side's players: its code and its team's listed one, each also without its part after a point."""
    listed = F.when(position == "home", F.col("home_code")).when(position == "away", F.col("away_code"))
    codes = F.array(side["team"]["code"], listed)
    short = F.transform(codes, lambda c: F.regexp_replace(c, r"^(.*?)\.\w+", "$1"))
    return F.array_distinct(F.filter(F.transform(F.concat(codes, short), F.lower), _filled))


def merged_feeds(games: DataFrame, feeds: DataFrame) -> DataFrame:
    """Live feeds merged into the games that they name: the columns of ``published_maps``, state, observed_at, and issue.

    ``games`` as of ``source_games``; ``feeds``: source_id, game_id, data (JSON). Which of a
    game's teams a camp is, its five players' tags alone say: all five begin with one tag of
    one team and no other tag fits. Anything less, and a team or camp named twice, gives the
    feed's issue and no map. Names lose their tag. Teams keep their page's name and result, as
    a feed has no winner; a feed may start a game, but not end it or start it again.
    Objectives that the feed does not publish are null. The clock is that of the feed's events.
    """
    # a game's teams are told by their place in it, so that no step carries them twice
    tagged = F.transform("game.teams", lambda s: text.once(_position(s), lambda p: F.struct(p.alias("position"), _codes(s, p).alias("codes"))))
    listed = games.select("source_id", F.col("game.id").alias("game_id"), "game", tagged.alias("tagged"))
    rows = feeds.select("source_id", "game_id", "data").join(listed, ["source_id", "game_id"], "left").withColumn("feed", F.from_json("data", _FEED)).drop("data")

    def meant(t: Column) -> Column:
        def by(names: Column) -> Column:
            fits = lambda code: text.once(F.concat(code, F.lit(" ")), lambda tag: F.forall(names, lambda n: F.startswith(n, tag)))
            return F.flatten(F.transform("tagged", lambda o, k: F.transform(F.filter(o["codes"], fits), lambda c: F.struct(k.alias("place"), c.alias("code")))))

        return text.once(F.transform(t["players"], lambda p: F.lower(F.coalesce(p["summoner_name"], F.lit("")))), by)

    rows = rows.withColumn("meant", F.transform("feed.teams", meant))
    lined = lambda t: F.coalesce(t["side"].isin(*CAMPS) & (F.size(t["players"]) == LINE_UP), F.lit(False))
    different = lambda texts: F.size(F.array_distinct(F.filter(texts, _filled))) == 2
    first = lambda m: F.get(m, F.lit(0))

    def merged(seen: Column, one: Column) -> Column:
        own, code = F.get("game.teams", one["place"]), one["code"]
        untagged = lambda p: p.withField("summoner_name", F.trim(F.substr(p["summoner_name"], F.length(code) + 2)))
        dragons = F.json_array_length(seen["dragons"]).cast("string")
        return text.once(own, lambda own: F.struct(
            own["id"].alias("id"), seen["side"].alias("side"), own["win"].alias("win"), own["team_name"].alias("team_name"), own["team"].alias("team"), F.transform(seen["players"], untagged).alias("players"),
            F.coalesce(seen["bans"], own["bans"]).alias("bans"), *[(dragons if k == "dragons" else seen[k] if k in ("herald", "horde") else F.coalesce(seen[k], own[k])).alias(k) for k in OBJECTIVES.values()],
            F.get("tagged", one["place"])["position"].alias("position"),
        ))

    observed = moments.instant(F.regexp_replace(F.col("feed.timestamp"), r"^\$D", ""))
    rules = {
        "other-game": ~((F.col("feed.id") == F.col("game_id")) & (F.col("feed.type") == "feed")) | F.col("feed.id").isNull() | F.col("feed.type").isNull(),
        "time-without-offset": observed.isNull(),
        "unknown-game": F.col("game").isNull(),
        "not-two-teams": F.col("feed.teams").isNull() | (F.size("feed.teams") != 2),
        "incomplete-line-up": F.exists("feed.teams", lambda t: ~lined(t)),
        "ambiguous-team": F.exists("meant", lambda m: F.size(m) != 1),
        "repeated-team": ~(different(F.transform("meant", lambda m: F.get("game.teams", first(m)["place"])["id"])) & different(F.transform("feed.teams", lambda t: t["side"]))),
    }
    checked = rows.withColumns({"issue": _first_issue(rules), "observed_at": observed, "state": F.col("feed.state"), "clock": frame_seconds(F.col("feed.events"))})
    started = F.col("feed.state").isin("STARTED", "PAUSED") & (F.coalesce(F.col("game.state"), F.lit("")) != "COMPLETED")
    game = F.struct(F.col("game.id").alias("id"), F.col("game.number").alias("number"), F.when(started, "STARTED").otherwise(F.col("game.state")).alias("state"), F.coalesce("clock", "game.duration").alias("duration"), F.transform("feed.teams", lambda t, k: text.once(first(F.get("meant", k)), lambda one: merged(t, one))).alias("teams"))
    whole = _with_map(checked.withColumn("game", F.when(F.col("issue").isNull(), game)), lambda s: s["position"])
    sound = F.col("sound") & F.forall("sides", lambda s: F.size(s["players"]) == LINE_UP)
    issue = F.coalesce("issue", F.when(~F.coalesce(sound, F.lit(False)), "incomplete-statistics"))
    out = whole.withColumn("issue", issue)
    # zero seconds of a page mean an unknown time, but a clock of zero was seen
    told = {"number": F.col("number"), "status": F.col("status"), "seconds": F.coalesce("clock", "seconds"), "winner": F.col("winner"), "sides": F.col("sides")}
    return out.select("source_id", "game_id", "state", "observed_at", "issue", *[F.when(F.col("issue").isNull(), c).alias(k) for k, c in told.items()])


def page_roles(pages: DataFrame) -> DataFrame:
    """(source_id, roles): a map from name keys of players to their role, of names that a match's page gives one role only; ``pages``: source_id, html."""
    found = pages.select("source_id", F.explode(page_stream(("player", "role"))("html")["objects"]).alias("data"))
    row = F.from_json("data", "role string, player struct<summoner_name:string>")
    named = found.select("source_id", row.alias("r")).select("source_id", text.plain_name(F.col("r.player.summoner_name")).alias("name"), text.looked_up(F.lower(F.col("r.role")), text.ROLES).alias("role"))
    single = named.where("name <> '' and role is not null").groupBy("source_id", "name").agg(F.min("role").alias("role"), F.max("role").alias("last")).where("role = last")
    return single.groupBy("source_id").agg(F.map_from_entries(F.collect_list(F.struct("name", "role"))).alias("roles"))  # the players of one page


def rendered_line_ups(maps: DataFrame, events: DataFrame, rendered: DataFrame, roles: DataFrame) -> DataFrame:
    """``maps`` of ``published_maps`` with the players that the browser shows, and ``from_page``: whether they come from it.

    ``rendered``: source_id, number, data (JSON: teams and durationSeconds); ``roles`` as of
    ``page_roles``. A side takes a shown line-up if exactly one shown team has its name, and
    its five players have their figures and five different roles, found by name. Gold is not
    shown: it stays with a player of the same name and champion.
    """
    shown = rendered.select("source_id", "number", F.from_json("data", _RENDERED).alias("shown"))
    rows = maps.join(shown, ["source_id", "number"], "left").join(roles, "source_id", "left").join(events.select("source_id", "home_names", "away_names"), "source_id", "left")

    def line_up(side: Column) -> Column:
        names = F.when(side["position"] == "home", F.col("home_names")).otherwise(F.col("away_names"))
        teams = F.filter("shown.teams", lambda t: F.array_contains(names, text.plain_name(t["name"])))
        return F.when(F.size(teams) == 1, F.get(teams, F.lit(0)))

    def player(side: Column, p: Column) -> Column:
        key = text.plain_name(p["name"])
        same = F.get(F.filter(side["players"], lambda q: text.plain_name(q["name"]) == key), F.lit(0))
        role = F.try_element_at(F.col("roles"), key)
        return F.struct(key.alias("id"), p["name"].alias("name"), role.alias("role"), p["champion"].alias("champion"), *[p[c].alias(c) for c in ("level", *NEEDED)], F.when(same["champion"].eqNullSafe(p["champion"]), same["gold"]).alias("gold"))

    def merged(side: Column) -> Column:
        def with_team(team: Column) -> Column:
            known = F.filter(F.transform(team["players"], lambda p: player(side, p)), lambda p: p["role"].isNotNull() & reduce(lambda a, b: a & b, [p[c].isNotNull() for c in NEEDED]))
            whole = lambda x: (F.size(team["players"]) == LINE_UP) & (F.size(x) == LINE_UP) & (F.size(F.array_distinct(F.transform(x, lambda p: p["role"]))) == LINE_UP)
            return text.once(known, lambda x: F.struct(F.when(whole(x), side.withField("players", x).withField("towers", F.coalesce(team["towers"], side["towers"]))).otherwise(side).alias("side"), F.coalesce(whole(x), F.lit(False)).alias("taken")))

        return text.once(line_up(side), with_team)

    rows = rows.withColumn("merged", F.transform("sides", merged))
    return rows.withColumns({"sides": F.transform("merged", lambda m: m["side"]), "from_page": F.exists("merged", lambda m: m["taken"]), "seconds": F.coalesce("shown.durationSeconds", "seconds")}).drop("merged", "shown", "roles", "home_names", "away_names")


def _as_page(body: Column, record: Column) -> Column:
    """HTML of a page with a body and one record in its stream."""
    quoted = F.replace(F.replace(record, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit("<html><body>"), body, F.lit('<script>self.__next_f.push([1,"0:'), quoted, F.lit('\\n"])</script></body></html>'))


def _order_state() -> Column:
    return F.when(F.col("o_orderkey") % 11 == 0, "SUSPENDED").when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "P", "PAUSED").otherwise("UNSTARTED")


def listed_orders(spark, sf_dir):
    """Orders as matches on a listing page of their customer, read back from the page's HTML.

    Every 13th is postponed, every 11th of a state that nobody knows, every 17th not linked;
    those between a team and itself, and with an open side, are no matches.
    """
    team = lambda key, rest: F.struct(F.when(key % 19 != 0, F.concat(F.lit("t"), key % rest)).alias("id"), F.concat(F.lit("Té\"am & "), key % rest).alias("name"))
    match = F.struct(
        F.concat(F.lit("m"), "o_orderkey").alias("id"), F.concat(F.lit("s"), "o_orderkey").alias("slug"), F.date_format("o_orderdate", "'$D'yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), _order_state().alias("state"), (F.col("o_orderkey") % 13 == 0).alias("postponed"),
        (F.col("o_orderkey") % 5).alias("team1_score"), (F.col("o_orderkey") % 3 - 1).alias("team2_score"), team(F.col("o_custkey"), 7).alias("team1"), team(F.col("o_orderkey"), 7).alias("team2"), F.struct(F.struct(F.col("o_orderpriority").alias("name")).alias("tournament")).alias("stage"),
    )
    link = F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit('<a class="x" href="/match/s'), "o_orderkey", F.lit('">')))
    grouped = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("page_id")).agg(F.array_join(F.collect_list(link), "").alias("links"), F.to_json(F.collect_list(match)).alias("matches"))
    html = _as_page(F.concat(F.lit("<main>"), "links", F.lit("</main>")), F.concat(F.lit('{"matches":'), "matches", F.lit("}")))
    rows = listing_rows(grouped.select("page_id", F.concat(F.lit("/matches/all/"), "page_id").alias("url"), html.alias("html")))
    return rows.select("page_id", "issue", "source_id", "path", F.unix_seconds("starts_at").alias("starts_at"), "status", "home_source_id", "away_source_id", F.get("home_names", F.lit(0)).alias("home_key"), "competition_source_id", "home_score", "away_score")


_LISTED = """
WITH r AS (SELECT o_custkey AS page_id, o_orderkey AS k, o_custkey % 7 AS h, o_orderkey % 7 AS a, o_orderpriority AS c, epoch(o_orderdate)::BIGINT AS due,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 13 = 0 THEN 'postponed' WHEN o_orderstatus = 'F' THEN 'finished' WHEN o_orderstatus = 'P' THEN 'live' ELSE 'scheduled' END AS status,
  o_custkey % 19 <> 0 AND o_orderkey % 19 <> 0 AND o_custkey % 7 <> o_orderkey % 7 AS known FROM orders WHERE o_orderkey % 17 <> 0)"""
LISTED_ORDERS = f"""{_LISTED}
SELECT page_id, CASE WHEN status IS NULL THEN 'unknown-state' END AS issue, 'm' || k AS source_id, '/match/s' || k AS path, due AS starts_at, status, 't' || h AS home_source_id, 't' || a AS away_source_id,
  'te am and ' || h AS home_key, trim(regexp_replace(lower(c), '[^a-z0-9]+', '-', 'g'), '-') AS competition_source_id,
  CASE WHEN status <> 'scheduled' THEN k % 5 END AS home_score, CASE WHEN status <> 'scheduled' AND k % 3 > 0 THEN k % 3 - 1 END AS away_score FROM r WHERE known
UNION ALL SELECT o_custkey, 'no-identities', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM orders GROUP BY o_custkey HAVING bool_and(o_orderkey % 17 = 0)"""


def tagged_feeds(spark, sf_dir):
    """Orders as games of two teams, each with a live feed merged in: teams are told by their players' tags.

    Teams of one tag, a camp named twice and line-ups of four come up and are set aside.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 5).alias("h"), (F.col("o_orderkey") % 4 + 3).alias("a"), (F.col("o_totalprice") % 9).cast("long").alias("q"), F.col("o_orderstatus").alias("s"))
    roles = ["TOP", "JUNGLE", "MID", "BOTTOM", "SUPPORT"]

    def own(c: Column, p: str) -> Column:
        known = {"id": F.concat(F.lit(p), c), "win": F.lit(p == "h"), "team": F.struct(F.concat(F.lit(p), c).alias("name"), F.concat(F.lit("C"), c, F.lit(".A")).alias("code"))}
        return F.struct(*[known.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in T.StructType.fromDDL(_SIDE)])

    game = F.struct(F.concat(F.lit("g"), "k").alias("id"), F.lit(1).cast("long").alias("number"), F.when(F.col("s") == "F", "COMPLETED").otherwise("UNSTARTED").alias("state"), F.lit(None).cast("long").alias("duration"), F.array(own(F.col("h"), "h"), own(F.col("a"), "a")).alias("teams"))
    games = orders.select(F.col("k").alias("source_id"), F.array(F.concat(F.lit("h"), "h")).alias("home_names"), F.array(F.concat(F.lit("a"), "a")).alias("away_names"), F.lit(None).cast("string").alias("home_code"), F.lit(None).cast("string").alias("away_code"), game.alias("game"))
    figures = [F.col("q").alias(c) for c in ("kills", "deaths", "assists", "creep_score")]
    player = lambda c, k, role: F.struct(F.concat(F.lit("c"), c, F.lit(f" Player {k}")).alias("summoner_name"), F.lit(role).alias("role"), *figures)
    five = lambda c: F.array(*[player(c, k, role) for k, role in enumerate(roles)])
    camp = lambda c, side: F.struct(side.alias("side"), F.when(F.col("k") % 10 == 7, F.slice(five(c), 1, 4)).otherwise(five(c)).alias("players"), F.array(F.col("q"), F.col("q")).alias("dragons"), (F.col("q") - 4).alias("horde"))
    camps = F.array(camp(F.col("a"), F.when(F.col("k") % 10 != 3, "BLUE").otherwise("RED")), camp(F.col("h"), F.lit("RED")))
    data = F.to_json(F.struct(F.concat(F.lit("g"), "k").alias("id"), F.lit("feed").alias("type"), F.lit("2024-01-01T00:00:00Z").alias("timestamp"), F.lit("STARTED").alias("state"), camps.alias("teams")))
    merged = merged_feeds(games, orders.select(F.col("k").alias("source_id"), F.concat(F.lit("g"), "k").alias("game_id"), data.alias("data")))
    home = F.get("sides", F.lit(0))
    return merged.select("source_id", "issue", "status", "winner", home["side"].alias("home_camp"), F.get(home["players"], F.lit(2))["name"].alias("home_mid"), home["dragons"].alias("home_dragons"), home["grubs"].alias("home_grubs"), home["towers"].alias("home_towers"))


TAGGED_FEEDS = """
WITH r AS (SELECT o_orderkey AS k, o_custkey % 5 AS h, o_orderkey % 4 + 3 AS a, (o_totalprice % 9)::DECIMAL(18, 6) AS q, o_orderstatus = 'F' AS f FROM orders),
i AS (SELECT *, CASE WHEN k % 10 = 7 THEN 'incomplete-line-up' WHEN h = a THEN 'ambiguous-team' WHEN k % 10 = 3 THEN 'repeated-team' END AS issue FROM r)
SELECT k AS source_id, issue, CASE WHEN issue IS NULL THEN CASE WHEN f THEN 'finished' ELSE 'live' END END AS status, CASE WHEN issue IS NULL AND f THEN 'home' END AS winner, CASE WHEN issue IS NULL THEN 'red' END AS home_camp,
  CASE WHEN issue IS NULL THEN 'Player 2' END AS home_mid, CASE WHEN issue IS NULL THEN 2::BIGINT END AS home_dragons, CASE WHEN issue IS NULL AND q >= 4 THEN floor(q)::BIGINT - 4 END AS home_grubs, NULL::BIGINT AS home_towers FROM i"""

QUERIES = {"listed_orders": (listed_orders, LISTED_ORDERS), "tagged_feeds": (tagged_feeds, TAGGED_FEEDS)}
