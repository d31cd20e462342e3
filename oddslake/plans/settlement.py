"""Settlement of selections from verified, stable match results.

Two sources report results. A source's proof is its newest snapshot if that is valid, dated
back to the first of the run of snapshots that say the same. Proofs that contradict each
other settle nothing; a proof settles only once it has stood for half an hour.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddslake.functions import text
from oddslake.operators.latest import top_n, trailing_runs
from oddslake.plans.series import completed, target_of

DELAY = "30 minutes"
LIVE, ARCHIVE = "loltv", "oracles-elixir"
#: Labels that name no team (fixed values).
NO_TEAM = ("", "yes", "no", "oui", "non", "draw", "tie")


def verified_result(source: Column, status: Column, payload: Column, home: Column, away: Column, format_name: Column) -> Column:
    """struct(winner, maps, played, signature) of a snapshot that proves its match's result, else null.

    ``payload`` is a struct of status, format, seriesScore (home, away) and maps (number,
    status, winnerId).
    """
    maps, target = payload["maps"], target_of(format_name)
    numbers = F.transform(maps, lambda m: m["number"])
    won = F.filter(maps, lambda m: m["status"] == "finished")
    by_side = lambda m: (m["winnerId"] == home) | (m["winnerId"] == away)
    sound = F.forall(maps, lambda m: m["number"].between(1, 5) & F.when(m["status"] == "finished", F.coalesce(by_side(m), F.lit(False))).otherwise(m["winnerId"].isNull()))
    sound = sound & (F.size(F.array_distinct(numbers)) == F.size(numbers))
    stated = payload["seriesScore"]
    stated_ok = stated.isNotNull() & (stated["home"] >= 0) & (stated["away"] >= 0)
    full = completed(maps, home, away, format_name)
    agrees = stated_ok & full.isNotNull() & (stated["home"] == full["home"]) & (stated["away"] == full["away"])
    h, a = F.when(stated_ok, stated["home"]).otherwise(full["home"]), F.when(stated_ok, stated["away"]).otherwise(full["away"])
    wins = lambda side: F.size(F.filter(won, lambda m: m["winnerId"] == side))
    live = (full.isNull() | ~stated_ok | agrees) & (F.greatest(h, a) == target) & (F.least(h, a) < target)
    live = live & F.forall(won, lambda m: m["number"] <= h + a) & (wins(home) <= h) & (wins(away) <= a)
    proven = F.when(source == ARCHIVE, agrees).when(source == LIVE, live)
    ok = (status == "finished") & (payload["status"] == "finished") & (payload["format"] == format_name) & target.isNotNull() & maps.isNotNull() & sound & proven
    entries = F.array_sort(F.transform(won, lambda m: F.struct(m["number"].alias("number"), m["winnerId"].alias("winner"))))
    signature = F.sha2(F.concat_ws("|", format_name, h.cast("string"), a.cast("string"), F.to_json(entries)), 256)
    result = F.struct(F.when(h > a, home).otherwise(away).alias("winner"), F.map_from_entries(entries).alias("maps"), (h + a).alias("played"), signature.alias("signature"))
    return F.when(F.coalesce(ok, F.lit(False)), result)


def proofs(snapshots: DataFrame, matches: DataFrame) -> DataFrame:
    """One row a match with the proofs ``live`` and ``archive`` (struct or null) that may settle it.

    ``snapshots``: match_id, snapshot_id, source, status, observed_at, payload, already only
    those of the match's own source ids. An archive proof is dropped while the live source
    has no proof but a walkover, or a row at least as new as the archive's.
    """
    rows = snapshots.join(matches.select("match_id", "home_id", "away_id", "format"), "match_id")
    rows = rows.withColumn("result", verified_result(F.col("source"), F.col("status"), F.col("payload"), F.col("home_id"), F.col("away_id"), F.col("format")))
    keys, order = ["match_id", "source"], ["observed_at", "snapshot_id"]
    slim = rows.select(*keys, *order, "status", "result", F.col("result.signature").alias("signature"))
    runs = trailing_runs(slim, keys, order, "signature", F.col("result").isNotNull())
    proof = runs.select(*keys, F.struct("source", "snapshot_id", "observed_at", "result.winner", "result.maps", "result.played", "result.signature").alias("proof"))
    last = top_n(slim, keys, [F.desc(c) for c in order]).select(*keys, F.col("status").alias("last_status"), F.col("observed_at").alias("last_at"))
    both = last.join(proof, keys, "left").groupBy("match_id").agg(
        *[F.first(F.when(F.col("source") == s, F.col(c)), ignorenulls=True).alias(f"{name}_{c}") for s, name in ((LIVE, "live"), (ARCHIVE, "archive")) for c in ("proof", "last_status", "last_at")]
    )
    overtaken = F.col("live_proof").isNull() & F.col("live_last_at").isNotNull() & ((F.col("live_last_status") == "walkover") | (F.col("live_last_at") >= F.col("archive_last_at")))
    return both.select("match_id", F.col("live_proof").alias("live"), F.when(~overtaken, F.col("archive_proof")).alias("archive"))


def picked_team(labels: Column, mapping: Column) -> Column:
    """The only team of ``mapping`` (array of team_id and keys) that some label names, else null."""
    keys = F.filter(F.transform(labels, lambda x: text.team_key(text.plain_name(x))), lambda k: k.isNotNull() & ~k.isin(*NO_TEAM))
    hits = F.array_distinct(F.transform(F.filter(mapping, lambda t: F.arrays_overlap(t["keys"], keys)), lambda t: t["team_id"]))
    return F.when(F.size(hits) == 1, hits[0])


def settle(selections: DataFrame, quotes: DataFrame, fixtures: DataFrame, proof: DataFrame, now: Column) -> DataFrame:
    """selection_id, status (won, lost, void, pending), reason, kind, map_number, picked, source, snapshot_id.

    ``selections``: selection_id, market_id, event_id, label, accessible_label, line,
    ordinal, market_label, scope, period. ``fixtures``: event_id, match_id, home_id,
    away_id, mapping (array of struct team_id, keys), of linked events. Only selections
    once quoted open, of winner markets, are settled.
    """
    rows = selections.join(quotes.where(F.col("odds").isNotNull()).select("selection_id"), "selection_id", "left_semi")
    rows = rows.withColumn("market", text.winner_market(F.col("market_label"), F.col("scope"), F.col("period"))).where(F.col("market").isNotNull())
    rows = rows.join(fixtures, "event_id", "left").join(proof, "match_id", "left")
    plain = F.col("line").isNull() & F.col("ordinal").isNull()
    rows = rows.withColumn("pick", F.when(plain, picked_team(F.array("label", "accessible_label"), F.col("mapping"))))
    market = Window.partitionBy("market_id")
    picks = F.array_sort(F.collect_set("pick").over(market))
    sides = F.array_sort(F.array("home_id", "away_id"))
    rows = rows.withColumn("valid", F.coalesce((F.count("*").over(market) == 2) & (F.count("pick").over(market) == 2) & (picks == sides), F.lit(False)))
    live, archive, number = F.col("live"), F.col("archive"), F.col("market.map_number")
    shared = F.array_intersect(F.map_keys(live["maps"]), F.map_keys(archive["maps"]))
    conflict = live.isNotNull() & archive.isNotNull() & ((live["winner"] != archive["winner"]) | F.exists(shared, lambda k: F.element_at(live["maps"], k) != F.element_at(archive["maps"], k)))
    usable = lambda p: p.isNotNull() & ((F.col("market.kind") == "match_winner") | F.array_contains(F.map_keys(p["maps"]), number) | (number > p["played"]))
    chosen = F.when(F.col("valid") & ~F.coalesce(conflict, F.lit(False)), F.when(usable(live), live).when(usable(archive), archive))
    rows = rows.withColumn("proof", chosen)
    ripe = now >= F.col("proof.observed_at") + F.expr(f"interval {DELAY}")
    winner = F.when(F.col("market.kind") == "match_winner", F.col("proof.winner")).otherwise(F.try_element_at(F.col("proof.maps"), number))
    status = F.when(ripe, F.when(number > F.col("proof.played"), "void").when(winner.isNull(), "pending").when(F.col("pick") == winner, "won").otherwise("lost")).otherwise("pending")
    reason = F.when(~F.col("valid"), "unverified-market-or-identity").when(F.coalesce(conflict, F.lit(False)), "source-conflict").when(F.col("proof").isNull(), "missing-final-result").when(~ripe, "correction-window")
    return rows.select("selection_id", status.alias("status"), reason.alias("reason"), F.col("market.kind").alias("kind"), number.alias("map_number"), F.when(F.col("valid"), F.col("pick")).alias("picked"), F.col("proof.source").alias("source"), F.col("proof.snapshot_id").alias("snapshot_id"))


def journal(current: DataFrame, decided: DataFrame, now: Column) -> DataFrame:
    """The rows of ``decided`` whose evidence differs from the current one, stamped with ``now``."""
    digest = text.fingerprint({c: F.col(c) for c in decided.columns})
    fresh = decided.withColumn("evidence_sha256", digest)
    return fresh.join(current.select("selection_id", "evidence_sha256"), ["selection_id", "evidence_sha256"], "left_anti").withColumn("decided_at", now)
