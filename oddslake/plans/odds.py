"""Current odds: quotes per phase, two-sided markets with their probabilities, open opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddslake.functions import text

from oddslake.functions import money
from oddslake.operators.latest import latest_then_valid, top_n, valid_then_latest
from oddslake.operators.matching import only_candidate


def current_quotes(snapshots: DataFrame, quotes: DataFrame) -> DataFrame:
    """Each selection's newest quote in the newest snapshot of its event, of any phase (ties to the smaller id)."""
    newest = top_n(snapshots.select("event_id", "snapshot_id", "phase", "finished_at"), ["event_id"], [F.desc("finished_at"), F.asc("snapshot_id")])
    rows = quotes.join(newest.select("event_id", "snapshot_id", "phase"), "snapshot_id")
    found = top_n(rows, ["selection_id"], [F.desc("observed_at"), F.asc_nulls_last("odds")])
    return found.withColumn("quote_open", ~F.col("disabled") & F.col("odds").isNotNull())


def opportunities(markets: DataFrame, matches: DataFrame, estimates: DataFrame, readings: DataFrame, now: Column, max_age: str = "900 seconds") -> DataFrame:
    """Open opportunities at ``now``, one row a market: probability, odds, last and first reading, expected value.

    Active market, future match, newest estimate (which hides the market if it has
    expired), at least one reading and the last one fresh.
    """
    newest = latest_then_valid(estimates, ["market_id"], "estimated_at", now, F.col("valid_until") > now, [F.asc("probability")])
    seen = readings.where(F.col("recorded_at") <= now)
    last = seen.groupBy("market_id").agg(F.max("recorded_at").alias("last_at"), F.max_by("odds", F.struct("recorded_at", "odds")).alias("odds"), F.min_by("odds", F.struct("recorded_at", "odds")).alias("first_odds"), F.count("*").alias("n_readings"))
    fresh = last.where(F.col("last_at") >= now - F.expr(f"interval {max_age}"))
    rows = markets.where("active").join(matches.where(F.col("starts_at") > now), "match_id").join(newest.select("market_id", "probability"), "market_id").join(fresh, "market_id")
    return rows.withColumn("value", money.expected_value(F.col("probability"), F.col("odds")))


def probabilities(markets: DataFrame, estimates: DataFrame, now: Column) -> DataFrame:
    """(match_id, kind, team_id, probability): newest estimate among those valid at ``now``, of active markets; null where markets disagree."""
    valid = valid_then_latest(estimates, ["market_id"], "estimated_at", now, F.col("valid_until") > now, [F.asc("probability")])
    rows = markets.where("active").join(valid.select("market_id", "probability"), "market_id")
    agreed = F.when(F.min("probability") == F.max("probability"), F.max("probability"))
    return rows.groupBy("match_id", F.col("market").alias("core_kind"), F.col("pick_id").alias("team_id")).agg(agreed.alias("probability"))


def match_odds(matches: DataFrame, links: DataFrame, selections: DataFrame, snapshots: DataFrame, quotes: DataFrame, estimates: DataFrame, now: Column, max_age: str = "900 seconds") -> DataFrame:
    """One row per match, kind, map and phase with its two selections, the home side's first.

    ``matches``: match_id, home_id, away_id, status. ``links``: match_id, event_id,
    event_status (linked events only). ``selections``: selection_id, market_id, event_id,
    kind, map_number, team_id, result (those of verified winner markets). ``snapshots``:
    snapshot_id, event_id, phase, finished_at. ``quotes``: snapshot_id, selection_id,
    observed_at, odds, disabled. ``estimates``: match_id, core_kind, team_id, probability.

    Matches with several linked events, and kinds with several or incomplete markets, give
    nothing. A selection without a quote in the newest snapshot of a phase removes that
    phase. Suspended odds are null. Probabilities go with fresh, open, current prematch
    prices of the match or its first map only.
    """
    # files tell little of the rows that are made of them, so no side is sent to the driver on their word
    large = lambda df: df.hint("merge")
    single = only_candidate(links, ["match_id"]).join(large(matches), "match_id")
    rows = selections.join(large(single), "event_id").where((F.col("team_id") == F.col("home_id")) | (F.col("team_id") == F.col("away_id")))
    kind = ["match_id", "kind", "map_number"]
    shape = rows.groupBy(*kind).agg(F.countDistinct("market_id").alias("markets"), F.count("*").alias("n"), F.countDistinct("team_id").alias("teams"), F.countDistinct("selection_id").alias("ids"))
    unique = shape.where("markets = 1 and n = 2 and teams = 2 and ids = 2")
    same = (rows["match_id"] == unique["match_id"]) & (rows["kind"] == unique["kind"]) & rows["map_number"].eqNullSafe(unique["map_number"])
    rows = rows.join(large(unique), same, "left_semi")
    newest = top_n(snapshots.where(F.col("finished_at") <= now), ["event_id", "phase"], [F.desc("finished_at"), F.desc("snapshot_id")])
    priced = quotes.where(F.col("observed_at") <= now).join(large(newest.select("snapshot_id", "phase")), "snapshot_id")
    last = top_n(priced, ["selection_id", "phase"], [F.desc("observed_at"), F.asc_nulls_last("odds")])
    rows = rows.join(large(last.select("selection_id", "phase", "observed_at", "odds", "disabled")), "selection_id")
    rows = rows.where(~((F.col("phase") == "live") & (F.col("status") == "scheduled")))
    expected = F.when(F.col("phase") == "prematch", "scheduled").otherwise("live")
    rows = rows.withColumn("historical", F.coalesce((F.col("status") != expected) | (F.col("event_status") != expected), F.lit(True)))
    rows = rows.withColumn("suspended", F.col("disabled") | F.col("odds").isNull())
    rows = rows.withColumn("core_kind", F.when(F.col("kind") == "match_winner", "winner").when(F.col("map_number") == 1, "map1"))
    rows = rows.join(large(estimates), ["match_id", "core_kind", "team_id"], "left")
    open_now = (F.col("observed_at") >= now - F.expr(f"interval {max_age}")) & ~F.col("suspended") & (F.col("phase") == "prematch") & ~F.col("historical")
    pick = F.struct(
        (F.col("team_id") != F.col("home_id")).alias("is_away"), "team_id", F.when(~F.col("suspended"), F.col("odds")).alias("odds"), "suspended", "observed_at",
        F.when(open_now, F.col("probability")).alias("probability"), "result",
    )
    out = rows.groupBy(*kind, "phase", "historical").agg(F.max("observed_at").alias("observed_at"), F.sort_array(F.collect_list(pick)).alias("selections"))
    return out.where(F.size("selections") == 2)


def displayed_value(result: Column, phase: Column, historical: Column, suspended: Column, value: Column) -> Column:
    """The value if it may be shown: pending, prematch, current, open, known and above 0."""
    return F.when((result == "pending") & (phase == "prematch") & ~historical & ~suspended & (value > 0), value)


def filtered_values(items: DataFrame, least: float = 0.0, league: str = "all", teams: list[str] | None = None, term: str = "", sort: str = "time") -> DataFrame:
    """Opportunities that pass optional filters ("all", an empty list and an empty term disable them), in the order asked for."""
    rows = items.where(F.col("value") >= F.lit(least).cast("decimal(20,10)"))
    rows = rows if league == "all" else rows.where(F.col("league_id") == league)
    rows = rows.where(F.col("pick_id").isin(teams)) if teams else rows
    rows = rows.where(text.contains_folded(F.concat_ws(" ", "home_name", "away_name"), term)) if term else rows
    orders = {"time": F.asc("starts_at"), "probability": F.desc("probability"), "value": F.desc("value")}
    return rows.orderBy(orders[sort], "market_id")


def best_and_average(items: DataFrame) -> DataFrame:
    """One row: number, average value (0 without rows) and the market of greatest value, the smallest id on ties."""
    best = F.min_by("market_id", F.struct((-F.col("value")).alias("v"), F.col("market_id").alias("m")))
    return items.agg(F.count("*").alias("n"), F.coalesce(F.avg("value"), F.lit(0)).alias("average"), best.alias("best"))


def history_windows(readings: DataFrame, hours: int) -> DataFrame:
    """Readings of each market's last ``hours``, each with its change to the reading before it, be that inside or not."""
    own = Window.partitionBy("market_id").orderBy("recorded_at")
    rows = readings.withColumn("change", F.col("odds") - F.lag("odds").over(own)).withColumn("_last", F.max("recorded_at").over(Window.partitionBy("market_id")))
    return rows.where(F.col("recorded_at") >= F.col("_last") - F.expr(f"interval {hours} hours")).drop("_last")
