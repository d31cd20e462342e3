"""Decisions after an alias is revoked, and rules over versions, on rows made by hand."""

from datetime import datetime, timedelta

import pytest
from oddslake.operators import versions
from oddslake.plans import resolve, revisions
from pyspark.sql import functions as F

from .test_resolve import ALIAS, AT, CANDIDATE, FIXTURE, GAME, candidate, fixture, team


def alias(name, target, kind="team", key="k", provider="book", days=1):
    return (kind, provider, GAME, key, name, "loltv", target, AT - timedelta(days=days), AT + timedelta(days=days))


@pytest.fixture
def world(spark):
    fixtures = [fixture("plain"), fixture("by-alias", "Öxyz Q", "Beta"), fixture("against-alias", "Alpha", "Gamma"), fixture("league", competition="Elite Cup"), fixture("elsewhere", "Oxyz Q", "Beta")]
    fixtures[-1] = (*fixtures[-1][:1], "other", *fixtures[-1][2:])
    candidates = [candidate("m1", home=team("t1", "Alpha", loltv="11"), away=team("t2", "Beta", loltv="12")), candidate("m2", home=team("t1", "Alpha", loltv="11"), away=team("t3", "Gamma", loltv="13"))]
    aliases = [alias("Oxyz Q", "11"), alias("Gamma", "99"), alias("Elite Cup", "c1", "competition"), alias("Nobody", "11"), alias("Oxyz Q", "11", provider="third")]
    return spark.createDataFrame(fixtures, FIXTURE), spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(aliases, ALIAS)


def rows(df):
    return sorted(map(str, df.select("fixture_id", "status", "reason", "match_id", "basis").collect()))


@pytest.mark.parametrize("name, touched", [("Oxyz Q", {"by-alias"}), ("Gamma", {"against-alias"}), ("Elite Cup", {"league"}), ("Nobody", set())])
def test_a_revoked_alias_equals_a_full_rerun(world, name, touched):
    fixtures, candidates, aliases = world
    before = resolve.resolve(fixtures, candidates, aliases)
    gone = revisions.with_alias_ids(aliases).where((F.col("name") == name) & (F.col("provider") == "book"))
    assert {r["fixture_id"] for r in revisions.touched_fixtures(fixtures, gone).collect()} == touched
    left, after = revisions.revoked(before, fixtures, candidates, aliases, [r["alias_id"] for r in gone.collect()])
    assert left.count() == aliases.count() - 1 and left.columns == aliases.columns
    full = rows(resolve.resolve(fixtures, candidates, left))
    assert rows(after) == full and (full != rows(before)) == bool(touched)
    assert rows(revisions.decided_again(after, fixtures, candidates, aliases, gone.drop("alias_id"))) == rows(before)  # added again


def test_an_unknown_alias_is_an_error(world):
    fixtures, candidates, aliases = world
    with pytest.raises(ValueError, match="unknown"):
        revisions.revoked(resolve.resolve(fixtures, candidates, aliases), fixtures, candidates, aliases, ["nothing"])


def test_append_only_and_stops(spark):
    kind = "id int, a string, stopped_at timestamp, stop_reason string"
    t = datetime(2024, 1, 1)
    before = spark.createDataFrame([(1, "x", None, None), (2, None, t, "end"), (3, "x", t, "end"), (4, "x", t, "end"), (5, "x", t, None), (6, "gone", t, "end")], kind)
    after = spark.createDataFrame([(1, "x", t, "end"), (2, None, t, "end"), (3, "x", None, None), (4, "x", t, "other"), (5, "y", t, None), (7, "new", None, None)], kind)
    assert {tuple(r) for r in versions.broken_append_only(before, after, ["id"]).collect()} == {(1, "changed"), (3, "changed"), (4, "changed"), (5, "changed"), (6, "missing")}
    assert {r["id"] for r in versions.resumed(before, after, ["id"]).collect()} == {3, 4}
    assert versions.broken_append_only(before, before, ["id"]).count() == 0 and versions.broken_append_only(before.select("id"), before.select("id"), ["id"]).count() == 0


def test_what_an_event_allows(spark):
    t, later = datetime(2024, 1, 1), datetime(2024, 1, 2)
    events = spark.createDataFrame([("s", "scheduled", None), ("l", "live", None), ("x", "live", t), ("n", None, None)], "event_id string, status string, stopped_at timestamp")
    rows = [(1, "s", "prematch", later, t), (2, "s", "prematch", t, t), (3, "s", "prematch", None, t), (4, "l", "prematch", later, t), (5, "l", "live", None, t), (6, "s", "live", later, t), (7, "x", "live", None, t), (8, "n", "live", None, t), (9, "?", "live", None, t)]
    snapshots = spark.createDataFrame(rows, "snapshot_id int, event_id string, phase string, scheduled_at timestamp, recorded_at timestamp")
    got = {r["snapshot_id"]: r["rule"] for r in versions.disallowed_snapshots(snapshots, events).collect()}
    assert got == {2: "not-prematch", 3: "not-prematch", 4: "not-prematch", 6: "not-live", 7: "not-collectible", 8: "not-collectible", 9: "not-collectible"}


def test_quotes_of_their_snapshot(spark):
    t = [datetime(2024, 1, 1, h) for h in range(4)]
    snapshots = spark.createDataFrame([("s", "e", t[1], t[2])], "snapshot_id string, event_id string, started_at timestamp, finished_at timestamp")
    selections = spark.createDataFrame([("own", "e"), ("other", "f")], "selection_id string, event_id string")
    rows = [(1, "s", "own", t[1], 2.0, False), (2, "s", "own", t[2], None, True), (3, "s", "own", t[0], 2.0, False), (4, "s", "own", t[3], 2.0, False), (5, "s", "own", None, 2.0, False), (6, "s", "other", t[1], 2.0, False), (7, "s", "?", t[1], 2.0, False), (8, "?", "own", t[1], 2.0, False), (9, "s", "own", t[1], 2.0, True), (10, "s", "own", t[1], None, False)]
    quotes = spark.createDataFrame(rows, "quote_id int, snapshot_id string, selection_id string, observed_at timestamp, odds double, disabled boolean")
    got = {r["quote_id"]: r["rule"] for r in versions.stray_quotes(quotes, snapshots, selections).collect()}
    late, other, suspended = "out-of-time", "other-event", "odds-of-a-suspended-quote"
    assert got == {3: late, 4: late, 5: late, 6: other, 7: other, 8: other, 9: suspended, 10: suspended}
