"""Outcomes that settle after a delay, from a stream of readings."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import functions as F

from oddslake.sources.tables import shared_dir, table
from oddslake.streaming import corrections, live


def late_corrections(spark, sf_dir):
    """Kinds of event that a user keeps to for two days, and those given up after that; the watermark is a day behind."""
    schema = table(spark, sf_dir, "events").select("user_id", "ts", "event_type").schema
    folder = f"{shared_dir(spark)}/late-corrections-{uuid.uuid4().hex}"
    stream = live.event_stream(spark, f"{sf_dir}/events.parquet*", schema, files_a_batch=1_000_000).withColumn("ts", F.col("ts").cast("timestamp"))
    settled = corrections.settled_after(stream, "user_id", "ts", "event_type", timedelta(days=2), "1 day")
    query = settled.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start(f"{folder}/rows")
    query.awaitTermination()
    out = spark.read.schema(settled.schema).parquet(f"{folder}/rows")
    return out.select("user_id", "status", "event_type", F.col("since").cast("timestamp_ntz").alias("since"), F.col("at").cast("timestamp_ntz").alias("moment"))


LATE_CORRECTIONS = """
WITH e AS (SELECT user_id, ts, event_type, lag(event_type) OVER w AS before, max(ts) OVER (PARTITION BY user_id) AS newest FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_type)),
r AS (SELECT user_id, event_type, newest, ts AS since, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type) AS until FROM e WHERE before IS DISTINCT FROM event_type),
s AS (SELECT *, since + INTERVAL 2 DAY AS due FROM r WHERE since + INTERVAL 2 DAY <= coalesce(until, greatest(newest, (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 DAY FROM events))))
SELECT user_id, 'settled' AS status, event_type, since, due AS moment FROM s UNION ALL SELECT user_id, 'withdrawn', event_type, since, until FROM s WHERE until IS NOT NULL"""


QUERIES = {"late_corrections": (late_corrections, LATE_CORRECTIONS)}
