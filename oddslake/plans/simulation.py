"""Historical simulation of equal stakes with exact cents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.functions import money
from oddslake.operators.latest import running_total


def chosen(records: DataFrame, now: Column, min_value: float = 0.0, league: str = "all", teams: list[str] | None = None, market: str = "all", days: int = 0) -> DataFrame:
    """Settled records whose expected value is above ``min_value``; "all", an empty list and 0 days disable a filter."""
    value = money.expected_value(F.col("probability"), F.col("odds"))
    rows = records.where((value > F.lit(str(min_value)).cast("decimal(20,10)")) & (F.col("settled_at") <= now))
    rows = rows if league == "all" else rows.where(F.col("league_id") == league)
    rows = rows.where(F.col("pick_id").isin(teams)) if teams else rows
    rows = rows if market == "all" else rows.where(F.col("market") == market)
    return rows.where(F.col("settled_at") >= now - F.expr(f"interval {days} days")) if days else rows


def simulate(records: DataFrame, stake: float) -> DataFrame:
    """``records`` with profit_cents of a stake and cumulative_cents, by settled_at and id.

    Won stakes return their odds, rounded half up to a cent; void ones return the stake.
    """
    stake = F.lit(str(money.valid_stake(stake))).cast("decimal(12,2)")
    cents = (stake * 100).cast("long")
    profit = F.when(F.col("result") == "won", money.profit_cents(stake, F.col("odds"))).when(F.col("result") == "lost", -cents).otherwise(F.lit(0)).cast("long")
    return running_total(records.withColumn("profit_cents", profit), F.to_date("settled_at"), [F.asc("settled_at"), F.asc("id")], "profit_cents", "cumulative_cents")


def summary(rows: DataFrame, stake: float) -> DataFrame:
    """One row: profit_cents, invested_cents, roi_pct (0 without stakes), wins, count and voids of simulated rows."""
    cents = int(round(money.valid_stake(stake) * 100))
    settled = F.col("result") != "void"
    total = rows.agg(F.coalesce(F.sum("profit_cents"), F.lit(0)).cast("long").alias("profit_cents"), F.count_if(settled).alias("count"), F.count_if(F.col("result") == "won").alias("wins"), F.count_if(~settled).alias("voids"))
    total = total.withColumn("invested_cents", F.col("count") * cents)
    return total.withColumn("roi_pct", F.when(F.col("invested_cents") > 0, F.col("profit_cents") * 100.0 / F.col("invested_cents")).otherwise(0.0))


def curve(rows: DataFrame) -> DataFrame:
    """(at, cumulative_cents): the cumulative profit after each day, with a zero at the first observation."""
    points = rows.groupBy(F.col("settled_at").alias("at")).agg(F.max_by("cumulative_cents", "id").alias("cumulative_cents"))
    seed = rows.agg(F.min("observed_at").alias("at"), F.lit(0).cast("long").alias("cumulative_cents")).where("at is not null")
    return seed.unionByName(points)


def broken_records(records: DataFrame) -> DataFrame:
    """Records that break the contract: times out of order, a pick that is no side, a match and market met twice."""
    twice = records.groupBy("match_id", "market").agg(F.count("*").alias("n")).where("n > 1").select("match_id", "market")
    wrong = ~((F.col("observed_at") < F.col("starts_at")) & (F.col("starts_at") <= F.col("settled_at")) & ((F.col("pick_id") == F.col("home_id")) | (F.col("pick_id") == F.col("away_id"))))
    return records.where(F.coalesce(wrong, F.lit(True))).unionByName(records.join(twice, ["match_id", "market"], "left_semi").select(*records.columns)).distinct()
