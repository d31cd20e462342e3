"""Expectations over two versions of a table, and over a table and what it refers to, rather than over single rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MISSING, CHANGED = "missing", "changed"


def broken_append_only(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rule): rows of an append-only table that the later version lacks, or has with other values.

    Both versions have the same columns; keys are unique in each. New rows break nothing.
    """
    values = [c for c in before.columns if c not in keys]
    digest = lambda df: df.select(*keys, F.struct(*values).alias("_row") if values else F.lit(1).alias("_row"))
    joined = digest(before).join(digest(after).withColumnRenamed("_row", "_later").withColumn("_there", F.lit(True)), list(keys), "left")
    rule = F.when(F.col("_there").isNull(), MISSING).when(~F.col("_row").eqNullSafe(F.col("_later")), CHANGED)
    return joined.select(*keys, rule.alias("rule")).where(F.col("rule").isNotNull())


def resumed(before: DataFrame, after: DataFrame, keys: Sequence[str], stop: Sequence[str] = ("stopped_at", "stop_reason")) -> DataFrame:
    """(keys) of rows that had stopped (the first column of ``stop`` is known) and whose stop has been taken back or changed since."""
    was = before.where(F.col(stop[0]).isNotNull()).select(*keys, F.struct(*stop).alias("_was"))
    now = after.select(*keys, F.struct(*stop).alias("_now"))
    return was.join(now, list(keys)).where(~F.col("_was").eqNullSafe(F.col("_now"))).select(*keys)


def disallowed_snapshots(snapshots: DataFrame, events: DataFrame) -> DataFrame:
    """(snapshot_id, rule): snapshots that their event does not allow at the time they are recorded.

    ``snapshots``: snapshot_id, event_id, phase, scheduled_at, recorded_at. ``events``:
    event_id, status, stopped_at. The event must be known and not stopped (not-collectible);
    before a match it is scheduled to start later (not-prematch), and in one it is live
    (not-live).
    """
    known = events.select("event_id", "status", "stopped_at", F.lit(True).alias("_known"))
    rows = snapshots.join(known, "event_id", "left")
    collectible = F.col("_known").isNotNull() & F.col("status").isNotNull() & F.col("stopped_at").isNull()
    prematch = (F.col("status") == "scheduled") & F.coalesce(F.col("scheduled_at") > F.col("recorded_at"), F.lit(False))
    rule = F.when(~collectible, "not-collectible").when((F.col("phase") == "prematch") & ~prematch, "not-prematch").when((F.col("phase") == "live") & (F.col("status") != "live"), "not-live")
    return rows.select("snapshot_id", rule.alias("rule")).where(F.col("rule").isNotNull())


def stray_quotes(quotes: DataFrame, snapshots: DataFrame, selections: DataFrame) -> DataFrame:
    """(quote_id, rule): quotes that do not belong to their snapshot, the first rule that they break.

    ``quotes``: quote_id, snapshot_id, selection_id, observed_at, odds, disabled.
    ``snapshots``: snapshot_id, event_id, started_at, finished_at. ``selections``:
    selection_id, event_id. Both name the same event (other-event), the quote was observed
    while the snapshot was taken (out-of-time), and it is disabled exactly if it has no odds
    (odds-of-a-suspended-quote).
    """
    rows = quotes.join(snapshots.select("snapshot_id", F.col("event_id").alias("_event"), "started_at", "finished_at"), "snapshot_id", "left")
    rows = rows.join(selections.select("selection_id", F.col("event_id").alias("_own")), "selection_id", "left")
    same = F.col("_event").isNotNull() & F.col("_event").eqNullSafe(F.col("_own"))
    in_time = F.coalesce(F.col("observed_at").between(F.col("started_at"), F.col("finished_at")), F.lit(False))
    rule = F.when(~same, "other-event").when(~in_time, "out-of-time").when(F.col("disabled") != F.col("odds").isNull(), "odds-of-a-suspended-quote")
    return rows.select("quote_id", rule.alias("rule")).where(F.col("rule").isNotNull())


def several_active(runs: DataFrame, keys: Sequence[str], ended: Column) -> DataFrame:
    """(keys, n) of those with more than one run that has not ended."""
    return runs.where(~F.coalesce(ended, F.lit(False))).groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
