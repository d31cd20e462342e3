"""Expectations: named conditions that rows must satisfy, and tables of their violations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Conditions of the odds model by table; null counts as satisfied unless a rule says otherwise.
RULES: dict[str, dict[str, str]] = {
    "quotes": {"odds-range": "odds is null or (odds > 1 and odds < 1e9)", "suspended-without-odds": "disabled = (odds is null)"},
    "estimates": {"probability-range": "probability > 0 and probability < 1", "valid-after-estimate": "valid_until > estimated_at"},
    "matches": {"sides-differ": "home_id <> away_id", "format": "format is null or format in ('BO1', 'BO3', 'BO5')"},
    "snapshots": {"time-order": "started_at <= finished_at", "phase": "phase in ('prematch', 'live')"},
    "events": {"stop-reason": "(stopped_at is null) = (stop_reason is null)"},
    "results": {"map-number": "case when kind = 'match_winner' then map_number is null else coalesce(map_number between 1 and 5, false) end"},
}


def violations(df: DataFrame, rules: dict[str, str | Column]) -> DataFrame:
    """(rule, n): the rows that break each rule, from one pass over ``df``."""
    conditions = {name: F.expr(c) if isinstance(c, str) else c for name, c in rules.items()}
    counts = df.agg(*[F.count_if(~F.coalesce(c, F.lit(True))).alias(name) for name, c in conditions.items()])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("n")) for name in conditions])
    return counts.select(F.explode(pairs).alias("v")).select("v.rule", "v.n")


def repeated_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys met more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def strays(rows: DataFrame, catalogue: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the catalogue."""
    return rows.join(catalogue.select(*keys), list(keys), "left_anti")


def only_known_fields(json_text: Column, known: Sequence[str]) -> Column:
    """Whether a JSON object has no other keys than ``known``."""
    return F.size(F.array_except(F.json_object_keys(json_text), F.array(*[F.lit(k) for k in known]))) == 0


def all_hold(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows that satisfy every rule."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.expr(r), F.lit(True)) for r in rules.values()]))
