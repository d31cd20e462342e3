"""Versioned ingestion: strict CSV rows, file validation, content addresses, publication, upserts, retention."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake.operators.latest import top_n

#: Columns that a file of game rows must have (fixed values).
REQUIRED = ("gameid", "participantid", "teamid", "playerid", "date", "year", "league")


class InvalidFile(ValueError):
    """A source file whose header or rows break the contract."""


def csv_rows(spark: SparkSession, path: str, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Rows of a UTF-8 CSV file as strings; the header must be unique and hold ``required``; a row of other width fails the read."""
    header = spark.read.options(multiLine=True, escape='"').csv(path, header=False).limit(1).collect()
    names = [(x or "").lstrip("﻿") for x in header[0]] if header else []
    if len(set(names)) != len(names) or not set(required) <= set(names):
        raise InvalidFile("the header lacks required columns or repeats one")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    reader = spark.read.schema(schema).options(header=True, mode="FAILFAST", enforceSchema=True, multiLine=True, escape='"', encoding="UTF-8", maxCharsPerColumn=2_000_000, maxColumns=4096, nullValue="\u0000", emptyValue="")
    return reader.csv(path).na.fill("")  # an empty value is an empty text


def payload_rows(rows: DataFrame, version_id: str) -> DataFrame:
    """CSV rows as version_id, game_id, participant_id and a map of all their values."""
    pairs = [x for c in rows.columns for x in (F.lit(c), F.col(c))]
    return rows.select(F.lit(version_id).alias("version_id"), F.col("gameid").alias("game_id"), F.col("participantid").alias("participant_id"), F.create_map(*pairs).alias("payload"))


def file_digests(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of the files of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def selected_files(inventory: DataFrame, years: Sequence[int]) -> DataFrame:
    """The inventory's files of the years asked for; every year must be there, once."""
    found = inventory.where(F.col("file_year").isin(list(years)))
    per_year = {r["file_year"]: r["n"] for r in found.groupBy("file_year").agg(F.count("*").alias("n")).collect()}  # a row a year
    if per_year != {y: 1 for y in years}:
        raise InvalidFile(f"years {sorted(set(years) - per_year.keys())} are missing or some is met twice")
    return found.orderBy("file_year")


def new_content(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose content hash is not known yet, one of each hash."""
    return top_n(files.join(known.select("sha256"), "sha256", "left_anti"), ["sha256"], [F.asc("path")])


def content_path(digest: Column) -> Column:
    return F.concat(F.lit("sha256/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def publish(rows: DataFrame, table: str, pointer: str, dataset: str, version: str) -> None:
    """Append a version's rows under its own partition, then move the dataset's pointer to it.

    Readers go by the pointer, so a version that is half written is never seen.
    """
    rows.withColumns({"dataset_id": F.lit(dataset), "version_id": F.lit(version)}).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id", "version_id").parquet(table)
    mark = rows.sparkSession.createDataFrame([(version,)], "version_id string")
    mark.write.mode("overwrite").parquet(f"{pointer}/dataset_id={dataset}")


def active_rows(spark: SparkSession, table: str, pointer: str) -> DataFrame:
    """Rows of the versions that the pointers name."""
    marks = spark.read.parquet(pointer)
    return spark.read.parquet(table).join(F.broadcast(marks), ["dataset_id", "version_id"], "left_semi")  # a row a dataset


def insert_absent(table: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` and those ``rows`` whose key it lacks."""
    return table.unionByName(rows.join(table.select(*keys), list(keys), "left_anti").dropDuplicates(list(keys)))


def upserted(table: DataFrame, rows: DataFrame, keys: Sequence[str], time: str, first_seen: str) -> DataFrame:
    """The newest row of each key from both, with the earliest ``first_seen``; an older row never replaces a newer one."""
    every = table.unionByName(rows)
    first = every.groupBy(*keys).agg(F.min(first_seen).alias(first_seen))
    rest = [F.col(c).desc_nulls_last() for c in table.columns if c not in (*keys, time)]
    newest = top_n(every, keys, [F.desc(time), *rest])
    return newest.drop(first_seen).join(first, list(keys)).select(*table.columns)


def merged_identity(observations: DataFrame, keys: Sequence[str], time: str, columns: Sequence[str]) -> DataFrame:
    """Each key's columns from its newest row in which they are not blank: newer wins, a blank never overwrites."""
    aggregates = [F.max_by(F.col(c), F.when(F.trim(F.col(c).cast("string")) != "", F.col(time))).alias(c) for c in columns]
    return observations.groupBy(*keys).agg(*aggregates, F.max(time).alias(time))


def retained(rows: DataFrame, time: str, now: Column, days: int = 14) -> DataFrame:
    return rows.where(F.col(time) >= now - F.expr(f"interval {days} days"))


def inventory(rows: DataFrame, id_column: str) -> DataFrame:
    """One row: rows, distinct ids and bytes of the payloads."""
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(id_column).alias("n_ids"), F.coalesce(F.sum(F.octet_length(F.to_json("payload"))), F.lit(0)).alias("n_bytes"))
