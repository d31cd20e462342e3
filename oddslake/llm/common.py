"""Helpers that the corpus operators share: the shared folder, written tables, bounded broadcasts."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes of white space that part words and are stripped from lines: blank, and TAB to CR.
SPACE_CLASS = "[ \\t-\\r]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the session's ``spark.checkpoint.dir``. Only where that is unset, and all of
    Spark runs in one process (tests), a new local folder is made and set; a cluster has to
    name one.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named is None:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="oddslake-", dir=os.environ.get("TMPDIR")))
        named = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def drop_written(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that nothing reads any more."""
    for table in tables:
        remove(table.sparkSession, table.written_to)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of ``fresh_path`` that nothing reads any more."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def remainder_of_id(column: str, modulus: int) -> Column:
    """crc32 of an id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


def small_enough(df: DataFrame, most_rows: int) -> bool:
    """Whether ``df`` has at most ``most_rows`` rows; reads no more than it must to tell."""
    return df.limit(most_rows + 1).count() <= most_rows


def bound_batches(spark: SparkSession, rows: int = 2_000) -> None:
    """Arrow batches of at most ``rows`` rows in this session, unless it has another bound already: texts may be long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":  # Spark's default
        spark.conf.set(key, str(rows))


def renamed(docs: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """``docs`` with all columns but ``used`` under names c0, c1, ... that no helper column has, and the new names in order."""
    names = [c if c in used else f"c{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), names


def give_back_memory() -> None:
    """Return what this Python worker no longer holds to the system: workers outlive tasks, and the next may be another kind's."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        return


def slices(batch: pa.RecordBatch, text: str, most_chars: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """Pieces of ``batch`` with about ``most_chars`` bytes of text, or one row."""
    sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
    start, total = 0, 0
    for k, size in enumerate(sizes):
        if k > start and total + size > most_chars:
            yield batch.slice(start, k - start)
            start, total = k, 0
        total += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)
    give_back_memory()
