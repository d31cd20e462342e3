"""Streaming forms of the stateful operators: latest state, change logs, budgets, corrections.

All are functions of a streaming DataFrame; the caller starts and stops the query. State is
per key and bounded: one hash, one row or one window's count.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str | None = None, files_a_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files of a folder, a bounded number of files in each batch."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).parquet(folder)


def latest_state(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Each key's value at its greatest time, for update or complete output; late rows never rewind it."""
    return stream.groupBy(key).agg(F.max_by(value, time).alias(value), F.max(time).alias(time))


def changed_values(stream: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """(key, time, value) of rows that differ from the key's row before them; A, B, A gives three.

    Rows of a batch are taken in time order; rows older than the last one kept are passed over.
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema.fields}

    def step(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        rows = pd.concat(list(frames)).sort_values([time, value])
        kept = []
        for at, x in zip(rows[time], rows[value], strict=True):
            stamp = int(pd.Timestamp(at).value)
            if last is not None and stamp < last[0]:
                continue
            if last is None or str(x) != last[1]:
                kept.append((group[0], at, x))
            last = (stamp, str(x))
        if last is not None:
            state.update(last)
        yield pd.DataFrame(kept, columns=[key, time, value])

    schema = f"{key} {kinds[key]}, {time} {kinds[time]}, {value} {kinds[value]}"
    return stream.select(key, time, value).groupBy(key).applyInPandasWithState(step, schema, "at long, value string", "append", GroupStateTimeout.NoTimeout)


def first_of_content(stream: DataFrame, time: str, digest: str, late: str = "1 hour") -> DataFrame:
    """Rows whose content hash was not seen within the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([digest])


def window_counts(stream: DataFrame, time: str, width: str, late: str, slide: str | None = None) -> DataFrame:
    """(since, until, n) for tumbling or sliding windows; rows later than the watermark are dropped."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    counted = stream.withWatermark(time, late).groupBy(window.alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def over_budget(stream: DataFrame, time: str, width: str, late: str, budget: int) -> DataFrame:
    """Fixed windows in which more than ``budget`` rows fell."""
    return window_counts(stream, time, width, late).where(F.col("n") > budget)


def sessions(stream: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """(key, since, until, n) of runs of rows with less than ``gap`` between them."""
    counted = stream.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(key, F.col("w.start").alias("since"), F.col("w.end").alias("until"), "n")


def upsert_batches(target: str, keys: list[str], time: str):
    """A foreachBatch function that keeps the newest row of each key in a versioned Parquet table.

    Each batch writes ``target``/v<batch id + 1> from the version before it, so that a batch
    that is run again overwrites its own output only.
    """
    from oddslake.operators.latest import top_n

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch
        if batch_id > 0:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{target}/v{batch_id}").unionByName(batch)
        rest = [F.col(c).desc_nulls_last() for c in batch.columns if c not in (*keys, time)]
        top_n(rows, keys, [F.desc(time), *rest]).write.mode("overwrite").parquet(f"{target}/v{batch_id + 1}")

    return write


def run_available(stream: DataFrame, checkpoint: str, name: str, mode: str = "append", seconds: int = 120):
    """Run a stream over all that is there now into an in-memory table, and return that table."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        if not query.awaitTermination(seconds):
            raise TimeoutError(f"the stream {name} didn't end")
    finally:
        query.stop()
    return stream.sparkSession.table(name)
