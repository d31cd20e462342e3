"""Ordered computations per key: latest rows, as-of choices, changes, runs, intervals and running totals.

Every function takes its reference time and its tie order as arguments. Windows are
partitioned by key; where a total runs over a whole table, it is built from sums by bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1, rank: str | None = None) -> DataFrame:
    """The first ``n`` rows of each key in ``order``; ``rank`` names a column for the place, if wanted."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_rank") <= n)
    return ranked.withColumnRenamed("_rank", rank) if rank else ranked.drop("_rank")


def latest_then_valid(df: DataFrame, keys: Sequence[str], time: str, at: Column, valid: Column, ties: Sequence[Column]) -> DataFrame:
    """The latest row up to ``at`` of each key, and only if that row is valid: an invalid newest row hides its key."""
    return top_n(df.where(F.col(time) <= at), keys, [F.desc(time), *ties]).where(valid)


def valid_then_latest(df: DataFrame, keys: Sequence[str], time: str, at: Column, valid: Column, ties: Sequence[Column]) -> DataFrame:
    """The latest valid row up to ``at`` of each key: an older valid row stands in for an invalid newest one."""
    return top_n(df.where((F.col(time) <= at) & valid), keys, [F.desc(time), *ties])


def first_matching(df: DataFrame, keys: Sequence[str], order: Sequence[Column], choices: dict[str, Column], value: Column) -> DataFrame:
    """For each key and named predicate, ``value`` of the first row in ``order`` that satisfies it (null if none)."""
    own = Window.partitionBy(*keys)
    ranked = df.withColumn("_value", value).withColumn("_rank", F.row_number().over(own.orderBy(*order)))
    return ranked.groupBy(*keys).agg(*[F.min_by("_value", F.when(p, F.col("_rank"))).alias(name) for name, p in choices.items()])


def changes(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Rows whose ``value`` differs from the key's previous row; the first stays. A, B, A keeps three rows."""
    own = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_seen", F.row_number().over(own)).withColumn("_before", F.lag(value).over(own))
    return marked.where((F.col("_seen") == 1) | ~F.col(value).eqNullSafe(F.col("_before"))).drop("_seen", "_before")


def variations(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: str) -> DataFrame:
    """Adds ``step`` (difference to the previous row, null on the first) and ``since_first`` (difference to the first)."""
    own = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("step", F.col(value) - F.lag(value).over(own)).withColumn("since_first", F.col(value) - F.first(value).over(own))


def within_last(df: DataFrame, keys: Sequence[str], time: str, span: str) -> DataFrame:
    """Rows no older than ``span`` before their key's newest row, inclusive."""
    newest = F.max(time).over(Window.partitionBy(*keys))
    return df.withColumn("_newest", newest).where(F.col(time) >= F.col("_newest") - F.expr(f"interval {span}")).drop("_newest")


def steps(df: DataFrame, keys: Sequence[str], order: Sequence[Column], time: str) -> DataFrame:
    """Adds ``until``: the next row's time, up to which a row's value holds (null on the last)."""
    return df.withColumn("until", F.lead(time).over(Window.partitionBy(*keys).orderBy(*order)))


def trailing_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], signature: str, valid: Column | None = None) -> DataFrame:
    """For each key the first row of its last run of equal signatures, with ``run_length``.

    ``order`` names columns that order rows ascending. An invalid last row gives no run; an
    invalid or different row ends the run before it.
    """
    valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    own = Window.partitionBy(*keys)
    backwards = own.orderBy(*[F.desc(c) for c in order])
    marked = df.withColumn("_valid", valid).withColumn("_last", F.first(F.struct(F.col(signature).alias("s"), F.col("_valid").alias("v"))).over(backwards))
    breaks = (~(F.col("_valid") & F.col("_last.v") & F.col(signature).eqNullSafe(F.col("_last.s")))).cast("int")
    inside = marked.withColumn("_breaks", F.sum(breaks).over(backwards)).where("_breaks = 0")
    run = inside.withColumn("run_length", F.count("*").over(own))
    return top_n(run, keys, [F.asc(c) for c in order]).drop("_valid", "_last", "_breaks")


def merged_intervals(df: DataFrame, keys: Sequence[str], start: str, end: str, gap: str | None = None) -> DataFrame:
    """Overlapping or touching intervals of each key, or such within ``gap`` of each other, as one row each."""
    own = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(own.rowsBetween(Window.unboundedPreceding, -1))
    reach = reach + F.expr(f"interval {gap}") if gap else reach
    marked = df.withColumn("_reach", reach).withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n")).drop("_island")


def running_total(df: DataFrame, bucket: Column, order: Sequence[Column], value: str, name: str = "running") -> DataFrame:
    """Running sum of ``value`` over the whole table.

    ``bucket`` rises with ``order`` and cuts the table into parts that are sorted one by one
    (a day, say); only the parts' sums are summed in one place.
    """
    cut = df.withColumn("_bucket", bucket)
    totals = cut.groupBy("_bucket").agg(F.sum(value).alias("_total"))
    before = F.sum("_total").over(Window.partitionBy(F.lit(0)).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    starts = totals.select("_bucket", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("_inside", inside).join(starts, "_bucket").withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_before", "_inside")


def strictly_rising(df: DataFrame, keys: Sequence[str], order: Sequence[Column], time: str) -> DataFrame:
    """(keys, is_rising): whether each key's times, in ``order``, rise from row to row."""
    own = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_before", F.lag(time).over(own))
    return marked.groupBy(*keys).agg(F.every(F.coalesce(F.col(time) > F.col("_before"), F.col("_before").isNull())).alias("is_rising"))


def anchors(df: DataFrame, keys: Sequence[str], time: str, id_column: str) -> DataFrame:
    """For each key and distinct time the smallest id that was observed then."""
    return df.groupBy(*keys, time).agg(F.min(id_column).alias("anchor"))


def ranked_with_margin(df: DataFrame, keys: Sequence[str], candidate: str, score: str, least: float, margin: float) -> DataFrame:
    """Per key the best candidate if its score is at least ``least`` and ``margin`` above the second's (0 if none), else null."""
    two = top_n(df, keys, [F.desc(score), F.asc(candidate)], 2, rank="_place")
    both = two.groupBy(*keys).agg(F.max(F.when(F.col("_place") == 1, F.col(candidate))).alias("_best"), F.max(F.when(F.col("_place") == 1, F.col(score))).alias("best_score"), F.coalesce(F.max(F.when(F.col("_place") == 2, F.col(score))), F.lit(0.0)).alias("second_score"))
    sure = (F.col("best_score") >= least) & (F.col("best_score") - F.col("second_score") >= margin)
    return both.withColumn("chosen", F.when(sure, F.col("_best"))).drop("_best")


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Nulls of ``columns`` filled from the key's nearest earlier row with a value; an explicit zero is a value."""
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(own) for c in columns})


def page(df: DataFrame, key: str, after, size: int) -> DataFrame:
    """A keyset page: up to ``size`` + 1 rows with ``key`` above ``after``; the extra row tells that more follow."""
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    return rows.orderBy(key).limit(size + 1)


def neighbours(days: DataFrame, day: str) -> DataFrame:
    """(day, before, after): each distinct day with the nearest populated days, over one row a day."""
    own = Window.partitionBy(F.lit(0)).orderBy(day)
    one = days.select(day).where(F.col(day).isNotNull()).distinct()
    return one.withColumn("before", F.lag(day).over(own)).withColumn("after", F.lead(day).over(own))
