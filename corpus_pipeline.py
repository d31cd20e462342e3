"""A corpus pipeline: five stages over ``documents``, each written as Parquet and read again.

Documents that the quality classifier rejects go; lines that many documents repeat go; one
document of each near-duplicate group stays; sources are mixed to their weights, with
documents repeated as the mix says; what is left is encoded to piece ids and decoded again.

All stages take null and empty texts, texts of any length, ties, repeated rows and empty
tables, as the operators' docstrings say; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddslake.llm import line_dedup, mixing, near_dedup, pieces, quality_model
from oddslake.llm.common import fresh_path, read_table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the classifier, taught by ``labels``, does not reject; empty and null texts are scored like others."""
    return quality_model.keep_good(docs, read_table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that ten documents or more share; n_chars is counted anew; a null text becomes an empty one."""
    out = line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return out.select(*docs.columns)


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies; rows without words or without an id are no one's copies and stay."""
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the mix takes, twice where it takes them twice; a null source is one of its own."""
    return mixing.mixed(docs)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_sha256 of every row; a null or empty text has no ids. Copies side by side are encoded once."""
    out = pieces.encode(docs, pieces.tokenizer_path("piece_bpe_32k.model"), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near-copies", keep_one_of_near_copies),
    ("mix", mix_sources),
    ("pieces", to_pieces),
]

#: The classifier and the tokenizer are beyond SQL; the tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows: doc_id, n_tokens, ids and decoded_sha256, one for each copy the mix takes."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
