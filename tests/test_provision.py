"""Teams set up from a batch against one row after the other in plain Python; brands of competitions by hand."""

import random

from oddslake.plans import provision

TEAM = "team_id string, league_id string, name string, code string, slug string, aliases array<string>, source_ids array<string>, images array<string>, image string"
SEEN = "place long, source_id string, name string, league_id string, image string"


def one_by_one(seen, teams):
    """The batch worked off row by row; names here mean a team if they are equal but for case and the word "team"."""
    key = lambda n: n.lower().removeprefix("team ")
    teams = {t[0]: dict(zip(("id", "league", "name", "aliases", "ids", "images", "image"), (t[0], t[1], t[2], set(t[5]), set(t[6]), set(t[7]), t[8]), strict=True)) for t in teams}
    for _, source_id, name, league, image in sorted(seen, key=lambda r: r[0]):
        team = next((t for t in teams.values() if source_id in t["ids"]), None)
        if team is None:
            meant = [t for t in teams.values() if not t["ids"] and key(name) in {key(x) for x in (t["name"], *t["aliases"])}]
            own = [t for t in meant if t["league"] == league]
            team = own[0] if len(own) == 1 else meant[0] if len(meant) == 1 else None
        if team is None:
            team = teams.setdefault(f"team:{source_id}", {"id": f"team:{source_id}", "league": league, "name": name, "aliases": set(), "ids": set(), "images": set(), "image": None})
        team["aliases"].add(name)
        team["ids"].add(source_id)
        if image:
            team["images"].add(image)
            team["image"] = team["image"] or image
    return {t["id"]: (t["league"], t["name"], sorted(t["aliases"], key=str.casefold), sorted(t["ids"]), sorted(t["images"]), t["image"]) for t in teams.values()}


def batch(worlds):
    """Small worlds of their own names: few names, teams of several names, ids that come again, in one league or another."""
    dice, seen, teams = random.Random(7), [], []
    for w in range(worlds):
        names = [f"w{w}x{k}" for k in range(dice.randint(1, 4))]
        for t in range(dice.randint(0, 6)):
            teams.append((f"k{w}t{t}", dice.choice("ABC"), dice.choice(names), "", "", [dice.choice(names)] * dice.randint(0, 1), [f"s{w}i{t}"] * (dice.random() < 0.15), [], None))
        for _ in range(dice.randint(1, 14)):
            seen.append((f"s{w}i{dice.randint(0, 7)}", dice.choice(["", "", "Team "]) + dice.choice(names), dice.choice("ABCD"), dice.choice([None, "", "u1", "u2"])))
    dice.shuffle(seen)
    return [(k, *r) for k, r in enumerate(seen)], teams


def as_rows(df):
    return {r["team_id"]: (r["league_id"], r["name"], r["aliases"], r["source_ids"], r["images"], r["image"]) for r in df.collect()}


def test_a_batch_gives_what_one_row_after_the_other_gives(spark):
    seen, teams = batch(150)
    stored, rows = spark.createDataFrame(teams, TEAM), spark.createDataFrame(seen, SEEN)
    changes = provision.provisioned(rows, stored).drop("created").cache()
    after = stored.join(changes, "team_id", "left_anti").unionByName(changes).cache()
    expected, before = one_by_one(seen, teams), {t[0]: (t[1], t[2], t[5], t[6], t[7], t[8]) for t in teams}
    assert as_rows(after) == expected
    assert as_rows(changes) == {k: v for k, v in expected.items() if before.get(k) != v}
    assert provision.provisioned(rows, after).count() == 0


def test_earlier_rows_decide_what_later_ones_may_take(spark):
    teams = [("t1", "A", "Fox", "", "", [], [], [], None), ("t2", "B", "Fox", "", "", [], [], [], None), ("t3", "A", "Owl", "OWL", "", [" ", "b", "A"], None, None, "kept")]
    # c names neither league's team, a takes its league's, b then the only one left, d comes too late
    seen = [(1, "c", "Fox", "C", None), (2, "a", "Fox", "A", None), (3, "b", "team fox", "C", "u"), (4, "d", "Fox", "B", None), (5, "e", "owl", "Z", "v"), (6, "", "Owl", "A", None), (7, None, "Owl", "A", None), (8, "D!", "Ant", "A", None), (9, "d?", "Bee", "B", None)]
    rows, stored = spark.createDataFrame(seen, SEEN), spark.createDataFrame(teams, TEAM)
    found = {r["source_id"]: (r["team_id"], r["basis"]) for r in provision.team_assignments(rows, stored).collect()}
    assert found == {"c": ("team:c", "created"), "a": ("t1", "league-name"), "b": ("t2", "name"), "d": ("team:d", "created"), "e": ("t3", "name"), "D!": ("team:d", "created"), "d?": ("team:d", "created")}
    after = as_rows(provision.provisioned(rows, stored))
    assert after["t3"] == ("A", "Owl", ["A", "b", "owl"], ["e"], ["v"], "kept")
    assert after["team:d"] == ("B", "Fox", ["Fox"], ["d"], [], None)
    assert provision.provisioned(rows.where("false"), stored).count() == 0
    assert provision.provisioned(rows, stored.where("false")).count() == 6 - 1


def test_long_chains_of_takers_settle(spark):
    # t1 is taken only after t0 is, and so on: each round settles one more
    n = 4
    teams = [(f"t{k}", "A", f"n{k}", "", "", [f"n{k + 1}"], [], [], None) for k in range(n)]
    seen = [(k, f"s{k}", f"n{k}", "B", None) for k in range(n)]
    found = {r["source_id"]: r["team_id"] for r in provision.team_assignments(spark.createDataFrame(seen, SEEN), spark.createDataFrame(teams, TEAM)).collect()}
    assert found == {f"s{k}": f"t{k}" for k in range(n)}


def test_brands_of_competitions(spark):
    leagues = [
        ("l1", "Major League", "mjl", "i", "logo-1", False), ("l2", "Minor League", "minor", "", "logo-2", False), ("l3", "Other", "other", "", "logo-2", False), ("p4", "Minor League", "x", "i", "logo-3", True),
        ("l5", "Minor League", "y", "i", None, False), ("l6", "Major League Summer 2024", "z", "i", None, True), ("l7", None, None, None, None, False),
    ]
    asked = [("Anything", "logo-1"), ("Minor League Playoffs", "logo-2"), ("MJL Spring 2025", None), ("Major League Summer 2024", ""), ("Nobody", "logo-3"), ("", None), (None, None)]
    found = provision.competition_brands(spark.createDataFrame(asked, "name string, image string"), spark.createDataFrame(leagues, "league_id string, name string, slug string, image string, source_image string, provider boolean"))
    assert {r["name"]: (r["league_id"], r["reason"]) for r in found.collect()} == {"Anything": ("l1", "logo"), "Minor League Playoffs": ("l5", "base-name"), "MJL Spring 2025": ("l1", "base-name"), "Major League Summer 2024": ("l1", "base-name")}


def test_names_meet_teams_in_one_join_and_teams_are_grouped_before_they_become_names(spark):
    from oddslake.plans.identity import team_scores

    teams = spark.createDataFrame([("t1", "Fox Women", ["Team Fox Women", "FOX women"], "FX", "fox"), ("t2", "Owl", None, "", None)], "team_id string, name string, aliases array<string>, code string, slug string")
    names = spark.createDataFrame([("fox women",), ("Fox",), ("Team Owl",), ("OWL",), ("fx",), (None,)], "name string")
    scores = team_scores(names, teams)
    plan = scores._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # the names asked for, the teams, and the result; a table of the teams' names would be a fourth
    assert (sum("Join " in x for x in plan), sum("Aggregate " in x for x in plan)) == (1, 3)
    assert {(r["name"], r["team_id"]): r["score"] for r in scores.collect()} == {("fox women", "t1"): 1.0, ("Fox", "t1"): 1.0, ("Team Owl", "t2"): 0.94, ("OWL", "t2"): 1.0, ("fx", "t1"): 1.0}
