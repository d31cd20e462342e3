"""Readers of the driver's tables, and the views of them that the queries use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.functions.money import ODDS

#: The reference time of the queries.
NOW = "2024-01-20 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now() -> Column:
    return F.lit(NOW).cast("timestamp_ntz")


def odds_of(value: str) -> Column:
    """Decimal odds made of a value of ``events``."""
    return (F.lit(1) + F.col(value).cast("decimal(16,6)") / F.lit(100)).cast(ODDS)


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a log of odds: one market a user, one reading a row."""
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", odds_of("value").alias("odds"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset, and all of Spark runs in one process, a local folder is made;
    a cluster has to name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once, as a Parquet table in the shared folder, for plans that read it many times.

    It outlives executors, and readers take only the columns and rows that they need.
    """
    path = f"{shared_dir(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
