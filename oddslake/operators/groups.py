"""Aggregations with a rule: counts by bucket, zero-filled groups, unanimity, null-poisoned sums, ordered lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket_counts(df: DataFrame, buckets: dict[str, Column], total: str = "all", keys: Sequence[str] = ()) -> DataFrame:
    """One row (a key) with the rows that satisfy each named condition, and ``total`` for all."""
    return df.groupBy(*keys).agg(F.count("*").alias(total), *[F.count_if(c).alias(name) for name, c in buckets.items()])


def zero_filled(catalogue: DataFrame, rows: DataFrame, keys: Sequence[str], name: str = "n") -> DataFrame:
    """Every row of ``catalogue`` with the number of ``rows`` of its key, 0 where there are none."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias(name))
    return catalogue.join(counts, list(keys), "left").withColumn(name, F.coalesce(name, F.lit(0)).cast("long"))


def unanimous(value: str, otherwise: str = "pending") -> Column:
    """The value that all rows of a group share, else ``otherwise``; a null is a disagreement."""
    return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count("*")), F.max(value)).otherwise(F.lit(otherwise))


def complete_sum(values: str, size: int) -> Column:
    """The sum of an array of exactly ``size`` non-null values, else null."""
    whole = (F.size(values) == size) & F.forall(values, lambda x: x.isNotNull())
    return F.when(whole, F.aggregate(values, F.lit(0).cast("double"), lambda s, x: s + x.cast("double")))


def history(df: DataFrame, keys: Sequence[str], order: str, *columns: str, name: str = "history") -> DataFrame:
    """Each key with its rows as an array of structs in ``order`` (then by the other columns).

    The array holds all rows of a key, so keys must be of bounded size (a market, a match).
    """
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(order, *columns))).alias(name))


def best(df: DataFrame, keys: Sequence[str], value: str, id_column: str) -> DataFrame:
    """Per key the id with the greatest value, the smallest id on ties; the key columns and ``best``, ``best_value``."""
    return df.groupBy(*keys).agg(F.max(value).alias("best_value"), F.min_by(id_column, F.struct((-F.col(value)).alias("v"), F.col(id_column).alias("i"))).alias("best"))


def as_map(df: DataFrame, keys: Sequence[str], key: str, value: str, name: str = "data") -> DataFrame:
    """Each key with a map of its (key, value) rows, in key order; keys of bounded size."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias(name))


def name_index(df: DataFrame, names: str, id_column: str) -> DataFrame:
    """(name, ids): the ids that carry each name of the array ``names``, sorted."""
    listed = df.select(F.explode(names).alias("name"), id_column)
    return listed.groupBy("name").agg(F.array_sort(F.collect_set(id_column)).alias("ids"))


def coverage(before: DataFrame, after: DataFrame, key: str, least: float = 0.8) -> DataFrame:
    """One row: rows before and after, their ratio and whether it reaches ``least`` (true without rows before)."""
    counts = before.agg(F.countDistinct(key).alias("n_before")).crossJoin(after.agg(F.countDistinct(key).alias("n_after")))  # one row each
    ratio = F.when(F.col("n_before") > 0, F.col("n_after") / F.col("n_before"))
    return counts.withColumn("ratio", ratio).withColumn("is_enough", F.coalesce(F.col("ratio") >= least, F.lit(True)))
