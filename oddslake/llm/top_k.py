"""Exact top-k inner-product search with norm buckets.

Vectors are grouped into buckets by length: cells of a logarithmic grid, light ones
together and heavy ones in several blocks. A first pass over the longest vectors gives each
query a score that its k best reach at least; queries that then need vectors of about one
length share a block. In every other
bucket that score, divided by the query's and the bucket's lengths, is a threshold on the
cosine: above 1 the bucket is skipped; a high one prunes by coordinates (a vector within
that angle of the query has each coordinate within known bounds), a low one by length.
What remains is verified by integer products. Blocks are packed in the narrowest integers
that hold them; vectors and the query blocks that need them meet by a shuffle of regions of
blocks, never by a broadcast, and a task holds one region's vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddslake.llm.common import read_table, written

#: Vectors of a block of a bucket, and queries of a block.
BLOCK, QUERY_BLOCK = 4096, 512
#: Steps of an octave in the grid of lengths, of which there are at most 70 octaves.
LENGTH_STEPS, NEED_STEPS = 256, 32
#: Cosine threshold from which coordinates are used, and how many.
COORDINATE_FROM, FOCUS = 0.3, 3
#: Room for rounding in bounds on cosines.
EPSILON = 1e-9
#: Products below this are exact in doubles.
EXACT = 2.0**52
#: Bytes of seed blocks that are broadcast at most.
MOST_SEED_BYTES = 1 << 26
#: Regions that the blocks of vectors are put in, unless one would have more than so many blocks: a query block is sent once to each region that it needs.
REGIONS, MOST_REGION_BLOCKS = 64, 64
#: A query with candidates of this share of a block or more is multiplied with the whole block, together with others.
TOGETHER_FROM = 1 / 16

_HELD = ("n", "rows", "ids", "vectors", "norms", "least")
_PACKED = "dims int, block int, n int, rows binary, ids binary, vectors binary, norms binary, least binary"
#: Shuffle partitions of the regions at most; a region is never split.
MOST_TASKS = 2048


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dims, v, norm) with v = floor(scale * x); vectors that are null, or hold a null or non-finite component, go."""
    x = F.col("embedding")
    finite = ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    out = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull()).where(finite)
    out = out.select("vec_id", F.size(x).alias("dims"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"))
    return out.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))))


def grid(measure: str, steps: int) -> Column:
    """The cell of a logarithmic grid that holds ``measure``; -1 for null and for what is not above 0."""
    return F.when(F.col(measure) > 0, F.floor(F.log2(F.col(measure) + 1) * steps)).otherwise(-1).cast("int")


class Run(NamedTuple):
    """Blocks ``start`` to ``start + parts - 1`` of vectors of ``dims`` components, none with a greater measure than ``most``."""

    dims: int
    start: int
    parts: int
    most: float


def runs_of(cells: list, size: int) -> tuple[list[Run], list[tuple[int, int, int, int]]]:
    """Blocks of about ``size`` rows from counted ``cells`` (dims, cell, n, most), greatest cells first.

    Light cells that follow each other share a block; a heavy one has several. Returns the
    runs of blocks, and (dims, cell, start, parts) of each cell. Cells are as many as the
    grid has, so this is short work for any number of rows.
    """
    runs: list[Run] = []
    places, room, dims, at = [], 0, None, 0
    for c in sorted(cells, key=lambda c: (c["dims"], -c["cell"])):
        if c["dims"] != dims:
            dims, at, room = c["dims"], 0, 0
        if c["n"] > room:
            runs.append(Run(dims, at, -(-c["n"] // size), c["most"]))
            at += runs[-1].parts
            room = size if runs[-1].parts == 1 else 0
        room -= c["n"] if runs[-1].parts == 1 else 0
        places.append((dims, c["cell"], runs[-1].start, runs[-1].parts))
    return runs, places


def in_blocks(table: DataFrame, size: int) -> tuple[DataFrame, list[Run]]:
    """``table`` (row, vec_id, dims, v, norm, least, measure, cell) packed into blocks by cell, and their runs."""
    cells = table.groupBy("dims", "cell").agg(F.count("*").alias("n"), F.max("measure").alias("most")).collect()  # a row for each cell of the grid
    runs, places = runs_of(cells, size)
    named = F.broadcast(table.sparkSession.createDataFrame(places, "dims int, cell int, start int, parts int"))
    placed = table.join(named, ["dims", "cell"]).withColumn("block", (F.col("start") + F.pmod(F.xxhash64("row"), F.col("parts"))).cast("int"))
    packed = placed.select("row", "vec_id", "dims", "v", "norm", "least", "block").groupBy("dims", "block").applyInArrow(pack, _PACKED)
    return written(packed, "blocks"), runs


def pack(table: pa.Table) -> pa.Table:
    """One row with all vectors of a block, the longest first, on ties by smaller vec_id."""
    rows, ids, norms, least = (table.column(c).to_numpy() for c in ("row", "vec_id", "norm", "least"))
    dims, block = table.column("dims")[0].as_py(), table.column("block")[0].as_py()
    v = pc.list_flatten(table.column("v")).to_numpy().reshape(len(ids), dims)
    order = np.lexsort((ids, -norms))
    held = {"rows": rows, "ids": ids, "vectors": narrow(v), "norms": norms, "least": least.astype(np.float64)}
    return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([block], pa.int32()), "n": pa.array([len(ids)], pa.int32()), **{c: [x[order].tobytes()] for c, x in held.items()}})


def narrow(v: np.ndarray) -> np.ndarray:
    """``v`` in the narrowest integers that hold it."""
    low, high = (int(v.min()), int(v.max())) if v.size else (0, 0)
    return v.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


class Block(NamedTuple):
    """A packed block of vectors, the longest first."""

    rows: np.ndarray
    ids: np.ndarray
    vectors: np.ndarray
    norms: np.ndarray
    least: np.ndarray


def _unpacked(row: dict, side: str = "") -> Block:
    n, dims = row[f"{side}n"], row["dims"]
    rows, ids = (np.frombuffer(row[f"{side}{c}"], np.int64) for c in ("rows", "ids"))
    norms, least = (np.frombuffer(row[f"{side}{c}"], np.float64) for c in ("norms", "least"))
    packed = row[f"{side}vectors"]
    vectors = np.frombuffer(packed, f"i{len(packed) // (n * dims)}" if dims else np.int8).reshape(n, dims)
    return Block(rows, ids, vectors, norms, least)


def candidates(query: np.ndarray, length: float, least: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray | None:
    """Places of the vectors of a block whose product with ``query`` may reach ``least``; None for all."""
    if not np.isfinite(least) or length == 0 or norms[0] == 0:
        return None
    cosine = least / (length * norms[0]) - EPSILON  # the local threshold: no vector of the block is longer
    if cosine > 1:
        return np.empty(0, np.int64)
    upto = len(norms) if least <= 0 else int(np.searchsorted(-norms, -(least / length) * (1 - EPSILON), "right"))
    if cosine < COORDINATE_FROM:
        return np.arange(upto)
    angle = math.acos(cosine)
    direction = query / length
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    fits = np.ones(upto, bool)
    for f in focus:
        own = math.acos(min(1.0, max(-1.0, direction[f])))
        low, high = math.cos(min(math.pi, own + angle)) - EPSILON, math.cos(max(0.0, own - angle)) + EPSILON
        coordinate = vectors[:upto, f]
        fits &= (coordinate >= low * norms[:upto]) & (coordinate <= high * norms[:upto])
    return np.flatnonzero(fits)


def best_of_block(asked: Block, held: Block, k: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """(query row, query id, vec_ids, scores) of the k best in the block, ties to smaller ids, none below the query's threshold."""
    kind = np.float64 if asked.norms.max() * held.norms[0] < EXACT else np.int64  # no sum of products is above the product of lengths
    vectors, queries = held.vectors.astype(kind, order="F"), asked.vectors.astype(kind)
    places = [candidates(v, length, floor, vectors, held.norms) for v, length, floor in zip(queries, asked.norms, asked.least, strict=True)]
    many = [n for n, at in enumerate(places) if at is None or len(at) >= TOGETHER_FROM * len(held.ids)]
    products = dict(zip(many, queries[many] @ vectors.T, strict=True))
    out = []
    for n, at in enumerate(places):
        if at is not None and not len(at):
            continue
        scores = products.get(n)
        if scores is None:
            scores = vectors[at] @ queries[n]
        elif at is not None:
            scores = scores[at]
        keep = scores >= asked.least[n]
        keep &= (held.rows if at is None else held.rows[at]) != asked.rows[n]
        scores, own = scores[keep], (held.ids if at is None else held.ids[at])[keep]
        if len(scores) > k:
            top = np.partition(scores, len(scores) - k)[len(scores) - k]
            scores, own = scores[scores >= top], own[scores >= top]
            order = np.lexsort((own, -scores))[:k]
            scores, own = scores[order], own[order]
        if len(scores):
            out.append((int(asked.rows[n]), int(asked.ids[n]), own, scores.astype(np.int64)))
    return out


_FOUND = "query_row long, query_id long, vec_id long, score long"


def _as_batch(found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    sizes = [len(x[2]) for x in found]
    columns = [np.repeat([x[0] for x in found], sizes), np.repeat([x[1] for x in found], sizes), *(np.concatenate([x[c] for x in found]) for c in (2, 3))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["query_row", "query_id", "vec_id", "score"])


def _scored(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1).to_pylist()[0]
                found = best_of_block(_unpacked(row, "q_"), _unpacked(row), k)
                if found:
                    yield _as_batch(found)

    return pairs.mapInArrow(run, _FOUND)


def _scored_by_region(asked: DataFrame, blocks: DataFrame, runs: list[Run], k: int) -> DataFrame:
    """The best of all blocks but the first for the query blocks ``asked``, by regions of blocks.

    Neither side is broadcast: a query block that is sent to many regions is much more than
    its table, by whose size Spark would choose. A task takes a region's blocks first and
    holds them while the query blocks pass.
    """
    total = sum(r.parts for r in runs)
    per = min(MOST_REGION_BLOCKS, -(-total // REGIONS))
    places = blocks.where("block > 0").select("dims", F.floor(F.col("block") / per).cast("int").alias("region"), F.lit(False).alias("asks"), *_HELD)
    sent = _surviving(asked, runs, per).unionByName(places)
    dealt = sent.repartition(min(4 * -(-total // per), MOST_TASKS), "dims", "region").sortWithinPartitions("dims", "region", "asks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = None, []
        for batch in batches:
            for start in range(batch.num_rows):
                row = batch.slice(start, 1).to_pylist()[0]
                if (row["dims"], row["region"]) != where:
                    where, held = (row["dims"], row["region"]), []
                block = _unpacked(row)
                if not row["asks"]:
                    held.append(block)
                    continue
                need = _need(block.norms, block.least)
                for own in held:
                    found = best_of_block(block, own, k) if _reaches(own.norms[0], need) else []
                    if found:
                        yield _as_batch(found)

    return dealt.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def _asked(blocks: DataFrame) -> DataFrame:
    return blocks.select("dims", *(F.col(c).alias(f"q_{c}") for c in _HELD))


def search(vectors: DataFrame, is_query, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of each query's k highest inner products with all other vectors.

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on vec_id. Components
    become floor(scale * x). Vectors that are null or hold a null or non-finite component,
    and rows without vec_id, take no part. Vectors meet only others of as many components.
    Rows with one id are rows of their own: each is a query with ranks of its own, and a
    candidate of the others. Ties go to smaller ids. Fewer candidates give fewer rows; an
    empty table gives none. Scores must stay below 2^63. Other columns are not read.
    """
    table = integer_vectors(vectors.select(F.col("vec_id").cast("long"), "embedding"), scale).withColumn("row", F.monotonically_increasing_id())
    table = written(table.withColumns({"cell": grid("norm", LENGTH_STEPS), "asks": is_query}), "vectors")  # row numbers are fixed from here on
    blocks, runs = in_blocks(table.withColumns({"measure": F.col("norm"), "least": F.lit(0.0)}), BLOCK)
    if not runs:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    queries = table.where("asks")
    first, _ = in_blocks(queries.withColumns({"measure": F.lit(0.0), "cell": F.lit(0), "least": F.lit(float("-inf"))}), QUERY_BLOCK)
    seeds = blocks.where("block = 0")  # some of the longest vectors of each dimension
    starts = [r for r in runs if r.start == 0]
    if sum(8 * BLOCK * (r.dims + 4) for r in starts) <= MOST_SEED_BYTES:
        seeds = F.broadcast(seeds)
    else:
        seeds = seeds.hint("merge")  # no broadcast by the size of a packed table
    found = written(_ranked(_scored(_asked(first).join(seeds, "dims"), k), k), "seeds")

    # queries of like needs share a block: how long must a vector be to reach the score of rank k?
    floors = found.where(F.col("rank") == k).select(F.col("query_row").alias("row"), F.col("score").cast("double").alias("floor"))
    needs = queries.drop("cell").join(floors, "row", "left").withColumn("measure", F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")))
    needs = needs.withColumns({"cell": grid("measure", NEED_STEPS), "least": F.coalesce("floor", F.lit(float("-inf")))})
    second, _ = in_blocks(needs, QUERY_BLOCK)
    rest = _scored_by_region(second, blocks, runs, k)
    every = found.select("query_row", "query_id", "vec_id", "score").union(rest)
    return _ranked(every, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _need(norms: np.ndarray, least: np.ndarray) -> float:
    """How long a vector must be at least to reach the threshold of some query of a block."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.where((norms > 0) & np.isfinite(least), least / norms, -np.inf).min())


def _reaches(length: float, need: float) -> bool:
    return length >= need * (1 - EPSILON) - EPSILON


def _surviving(asked: DataFrame, runs: list[Run], per: int) -> DataFrame:
    """Query blocks, once for each region of ``per`` blocks that some of their queries need to visit for a block but the first."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                one = batch.slice(n, 1).select(["dims", *_HELD])
                need = _need(*(np.frombuffer(one.column(c)[0].as_py(), np.float64) for c in ("norms", "least")))
                mine = [r for r in runs if r.dims == one.column("dims")[0].as_py() and _reaches(r.most, need)]
                for region in sorted({b // per for r in mine for b in range(max(1, r.start), r.start + r.parts)}):
                    yield pa.RecordBatch.from_arrays([one.column("dims"), pa.array([region], pa.int32()), pa.array([True]), *(one.column(c) for c in _HELD)], names=["dims", "region", "asks", *_HELD])

    return asked.mapInArrow(visit, "dims int, region int, asks boolean, n int, rows binary, ids binary, vectors binary, norms binary, least binary")


def query(spark, sf_dir: str) -> DataFrame:
    return search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id
  WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
