"""Odds, expected value and money in decimals; rounding happens once, at the end."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ODDS, PROBABILITY = "decimal(16,6)", "decimal(12,10)"


def expected_value(probability: Column, odds: Column) -> Column:
    """(probability * odds - 1) * 100, exact; null unless 0 < probability < 1 and odds > 1."""
    p, o = probability.cast(PROBABILITY), odds.cast(ODDS)
    return F.when((p > 0) & (p < 1) & (o > 1), (p * o - F.lit(1)) * F.lit(100))


def fair_odds(probability: Column) -> Column:
    return F.when((probability > 0) & (probability < 1), F.lit(1) / probability)


def quantized_odds(odds: Column) -> Column:
    """Odds with six decimals, half to even."""
    return F.bround(odds, 6).cast(ODDS)


def profit_cents(stake: Column, odds: Column) -> Column:
    """Profit of a won stake in cents, half up."""
    cents = F.floor(stake.cast("decimal(12,2)") * odds.cast(ODDS) * 100 + F.lit("0.5").cast("decimal(2,1)"))
    return cents.cast("long") - (stake.cast("decimal(12,2)") * 100).cast("long")


def valid_stake(stake: float) -> float:
    if not 0.01 <= stake <= 100_000:
        raise ValueError("a stake is 0.01 to 100000")
    return stake


def whole_number(text: Column) -> Column:
    """A non-negative whole number written as any number text; null otherwise."""
    x = text.try_cast("double")
    return F.when((x >= 0) & (x == F.floor(x)), x.cast("long"))


def series_target(best_of: Column) -> Column:
    return F.ceil(best_of / 2).cast("int")


def series_winner(home: Column, away: Column, target: Column) -> Column:
    """1 for home, 2 for away, null while neither has reached the target ahead of the other."""
    return F.when((home >= target) & (home > away), 1).when((away >= target) & (away > home), 2)


def direction(change: Column) -> Column:
    return F.signum(change).cast("int")
