"""Exact Jaccard join of documents on their word n-grams.

The documents and their n-grams are a sparse 0-1 matrix, one row for each distinct set.
Overlaps of rows are the product of the matrix with itself, which is never formed whole:
blocks of rows are multiplied, and only those that sizes allow to link.

Sizes bound both ends. Sets of n and m n-grams link only if the smaller is at least 85 %
of the larger, and then all but 15 % of either's n-grams are common. So of n-grams in any
one order, the first 15 % and one more of two linked sets have one in common, and rows
meet by those alone. The order puts rare n-grams first, by counts of all documents in a
fixed number of counters, so a passage that very many documents share brings none together.

Where two rows first meet, what comes later in both bounds their overlap, so most rows that
meet by chance are never multiplied. Rows that meet in one n-gram are first multiplied with
one of them. Components are taken, and only rows of n-grams that still join several
components are multiplied with each other: pair by pair where an n-gram has few rows, in
blocks against blocks where it has many. All links that connect something are found; equal
sets are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.llm import near_dedup
from oddslake.llm.common import bound_batches, drop_written, give_back_memory, read_table, slices, small_enough, written
from oddslake.llm.near_dedup import Texts, beside, components, largest, oracle, pairs_across, regions, shingles, with_components, with_hubs

#: Words of an n-gram, and the least similarity of a link in hundredths of the union.
SHINGLE, LEAST_HUNDREDTHS = 4, 85
#: Sets below this size link with equal sets only.
LEAST_SIZE = math.ceil(LEAST_HUNDREDTHS / (100 - LEAST_HUNDREDTHS))
#: Counters for each document, and the least and most of them (one byte each in the broadcast).
COUNTERS_A_DOCUMENT, LEAST_COUNTERS, MOST_COUNTERS = 32, 1 << 16, 1 << 24
#: Counts are ordered by steps of an octave; counters are merged in so many segments.
STEPS, SEGMENTS = 5, 16
#: Rows and bytes of n-grams of one block, about.
BLOCK, BLOCK_BYTES = 1024, 1 << 24
#: Rows of an n-gram that are paired with each other; more are multiplied in blocks.
FEW_ROWS = 64
#: Products of a slice of n-grams that are laid out at once.
MOST_PRODUCTS = 1 << 22


def described(docs: DataFrame, counters: int) -> DataFrame:
    """doc_id, n_shingles, set hash (hi, lo) and text_hash of every document; and, with a segment, packed counts of n-grams."""
    schema = "doc_id long, n_shingles long, hi long, lo long, text_hash long, segment int, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        import zstandard

        names = ["doc_id", "n_shingles", "hi", "lo", "text_hash", "segment", "counts"]
        counts = np.zeros(counters, np.uint32)
        for whole in batches:
            for batch in slices(whole, "text"):
                n, sizes, digests = batch.num_rows, [], []
                for text in batch.column("text").to_pylist():
                    items = shingles(text, SHINGLE)
                    sizes.append(len(items))
                    digests.append(xxhash.xxh3_128_digest(items.tobytes()))
                    np.add.at(counts, (items & np.uint64(counters - 1)).astype(np.int64), np.uint32(1))
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), batch.column("text_hash"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        near_dedup._WORDS.clear()
        packed = [zstandard.ZstdCompressor(level=1).compress(x.tobytes()) for x in np.split(counts, SEGMENTS)]
        none = pa.nulls(SEGMENTS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, none, pa.array(range(SEGMENTS), pa.int32()), pa.array(packed, pa.binary())], names=names)

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def frequency_steps(counted: DataFrame, counters: int) -> np.ndarray:
    """For each counter the logarithm of its sum over all tasks, in whole steps of a byte."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, counts in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                part = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.uint32)
                held[segment] = held[segment] + part if segment in held else part.astype(np.uint64)
        steps = [np.floor(np.log2(x.astype(np.float64) + 1) * STEPS).astype(np.uint8).tobytes() for x in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(steps, pa.binary())], names=["segment", "steps"])

    found = counted.select("segment", "counts").repartitionById(SEGMENTS, F.col("segment")).mapInArrow(merge, "segment int, steps binary").collect()  # MOST_COUNTERS bytes at most
    return np.frombuffer(b"".join(r["steps"] for r in sorted(found, key=lambda r: r["segment"])) or bytes(counters), np.uint8)


def leading(items: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """The n-grams by which a set meets others: the rarest ones, as many as no linked set can miss all of."""
    n = len(items)
    if n < LEAST_SIZE:
        return items[:0]
    count = n - -(-LEAST_HUNDREDTHS * n // 100) + 1
    own = steps[(items & np.uint64(len(steps) - 1)).astype(np.int64)].astype(np.uint64)
    place = (own << np.uint64(56)) | (items >> np.uint64(8))  # by steps, then by hash
    return items[np.argsort(place, kind="stable")[:count]]


def keyed(docs: DataFrame, steps: Broadcast) -> DataFrame:
    """(id, text_hash, keys): the leading n-grams of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                keys = [leading(shingles(t, SHINGLE), steps.value).view(np.int64) for t in batch.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, np.concatenate([np.empty(0, np.int64), *keys]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("text_hash"), lists], names=["id", "text_hash", "keys"])
        near_dedup._WORDS.clear()

    return docs.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "id long, text_hash long, keys array<long>")


def sizes_allow(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= LEAST_HUNDREDTHS * F.greatest(a, b)


def may_begin(n: str, i: str, m: str, j: str) -> Column:
    """Whether rows of n and m n-grams may link if their first common one is number i of the one and j of the other (from 0)."""
    most = F.least(F.col(n) - F.col(i), F.col(m) - F.col(j))
    return (most * (100 + LEAST_HUNDREDTHS) >= LEAST_HUNDREDTHS * (F.col(n) + F.col(m))) & sizes_allow(n, m)


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, count): the entries of the product of two blocks of rows; each row is the array of its distinct n-grams.

    N-grams that few of both blocks have are multiplied entry by entry, a slice at a time;
    those that many have as dense columns.
    """
    flat = lambda sets: (np.concatenate([np.empty(0, np.uint64), *sets]), np.repeat(np.arange(len(sets)), [len(s) for s in sets]))
    (vx, rx), (vy, ry) = flat(xs), flat(ys)
    common = np.intersect1d(vx, vy)

    def columns(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, values)
        at[at == len(common)] = 0
        hit = common[at] == values if len(common) else np.zeros(len(values), bool)
        at, rows = at[hit], rows[hit]
        order = np.argsort(at, kind="stable")
        return np.bincount(at, minlength=len(common)), rows[order]

    (dx, rx), (dy, ry) = columns(vx, rx), columns(vy, ry)
    sx, sy = np.cumsum(dx) - dx, np.cumsum(dy) - dy
    out = np.zeros(len(xs) * len(ys), np.int64)
    dense = dx * dy * 8 > len(xs) * len(ys)
    heavy = np.flatnonzero(dense)
    for start in range(0, len(heavy), 2048):
        own = heavy[start : start + 2048]
        x, y = (np.zeros((n, len(own)), np.float32) for n in (len(xs), len(ys)))
        for m, d, s, r in ((x, dx, sx, rx), (y, dy, sy, ry)):
            m[r[_runs(s[own], d[own])], np.repeat(np.arange(len(own)), d[own])] = 1
        out += (x @ y.T).astype(np.int64).ravel()
    light = np.flatnonzero(~dense)
    cuts = np.flatnonzero(np.diff(np.cumsum(dx[light] * dy[light]) // MOST_PRODUCTS)) + 1
    for own in np.split(light, cuts):
        x = np.repeat(rx[_runs(sx[own], dx[own])], np.repeat(dy[own], dx[own]))
        y = ry[_runs(np.repeat(sy[own], dx[own]), np.repeat(dy[own], dx[own]))]
        np.add.at(out, x * len(ys) + y, 1)
    at = np.flatnonzero(out)
    return at // max(1, len(ys)), at % max(1, len(ys)), out[at]


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each run."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())


def tile_links(table: pa.Table) -> pa.Table:
    """Pairs (a, b) that connect what the links of a tile connect, between its rows of the left and of the right side that have different roots.

    A group of rows that links hold together comes as one pair for each of its rows but
    the smallest, however many links there are.
    """
    doc, root = (table.column(c).to_numpy() for c in ("doc_id", "root"))
    left, right = (np.flatnonzero(table.column(c).to_numpy()) for c in ("is_left", "is_right"))
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    sizes = np.array([len(x) for x in items], np.int64)
    x, y, both = overlaps([items[k] for k in left], [items[k] for k in right])
    x, y = left[x], right[y]
    kept = (100 * both >= LEAST_HUNDREDTHS * (sizes[x] + sizes[y] - both)) & (root[x] != root[y])
    names, places = np.unique(doc, return_inverse=True)
    smallest = connected(len(names), places[x[kept]], places[y[kept]])
    at = np.flatnonzero(smallest != np.arange(len(names)))
    give_back_memory()
    return pa.table({"a": pa.array(names[smallest[at]], pa.int64()), "b": pa.array(names[at], pa.int64())})


def connected(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the smallest one that the edges (x, y) reach from it."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[x], label[y])
        before = label.copy()
        for end in (x, y, before[x], before[y]):
            np.minimum.at(label, end, least)
        label = label[label]
        if (label == before).all():
            return label


def _multiplied(tiles: DataFrame, sets: DataFrame, rows: int, size: int) -> DataFrame:
    """The links of all tiles; light tiles are multiplied together.

    ``tiles`` has t, i and j, which name a tile of about a block, is_left, is_right, doc_id
    and root; their ``rows`` and bytes are given. A row of another tile can only add a link,
    never lose one.
    """
    groups = max(1, math.ceil(rows / BLOCK), math.ceil(size / BLOCK_BYTES))
    dealt = tiles.select(F.pmod(F.xxhash64("t", "i", "j"), F.lit(groups)).alias("tile"), "is_left", "is_right", "doc_id", "root").distinct()
    dealt = F.broadcast(dealt) if rows <= near_dedup.MOST_SHAPES else dealt
    return written(sets.join(dealt, "doc_id").groupBy("tile").applyInArrow(tile_links, "a long, b long"), "join-links")


def _parts(rows: str, size: str) -> Column:
    return F.greatest(F.ceil(F.col(rows) / BLOCK), F.ceil(F.col(size) / BLOCK_BYTES), F.lit(1).cast("long"))


def product_of_pairs(texts: Texts, pairs: DataFrame) -> DataFrame:
    """The links among ``pairs`` (a, b) of class numbers: one row of a with blocks of all rows b that it is paired with."""
    pairs = written(pairs, "join-pairs")
    sets = texts.shingle_sets(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")))
    weight = sets.select(F.col("doc_id").alias("b"), F.octet_length("items").cast("long").alias("size"))
    shape = written(pairs.join(weight, "b").groupBy("a").agg(F.count("*").alias("rows"), F.sum("size").alias("size")).withColumn("parts", _parts("rows", "size")), "join-shape")
    rows, size = shape.agg(F.sum(F.col("rows") + F.col("parts")), F.sum("size")).first()
    cut = beside(pairs, shape.select("a", "parts"), "a").withColumn("part", F.pmod(F.xxhash64("b"), "parts"))
    right = cut.select(F.col("a").alias("t"), F.col("part").alias("i"), F.lit(False).alias("is_left"), F.lit(True).alias("is_right"), F.col("b").alias("doc_id"))
    left = shape.select(F.col("a").alias("t"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("i"), F.lit(True), F.lit(False), F.col("a").alias("doc_id"))
    links = _multiplied(right.union(left).withColumns({"j": F.lit(0), "root": F.col("doc_id")}), sets, rows or 0, size or 0)
    drop_written(pairs, sets, shape)
    return links


def product_of_regions(texts: Texts, members: DataFrame) -> DataFrame:
    """The links inside regions between rows of different roots: blocks against blocks, those of the largest root against others only.

    ``members`` has doc_id, root, size and region.
    """
    members = written(members, "join-members")
    own = beside(members, largest(members, "region", "root").select("region", "main"), "region").withColumn("is_main", F.col("root") == F.col("main"))
    size = lambda which: F.sum(F.when(which, 8 * F.col("size")).otherwise(0))
    main = F.col("is_main")
    counts = own.groupBy("region").agg(F.count_if(main).alias("mains"), size(main).alias("main_size"), F.count_if(~main).alias("others"), size(~main).alias("other_size"))
    counts = counts.select("region", _parts("mains", "main_size").alias("main_parts"), _parts("others", "other_size").alias("other_parts"))
    slot = F.xxhash64("doc_id")
    sub = F.when(main, F.col("other_parts") + F.pmod(slot, "main_parts")).otherwise(F.pmod(slot, "other_parts"))
    every = F.when(main, F.col("other_parts")).otherwise(F.col("other_parts") + F.col("main_parts"))
    dealt = beside(own, counts, "region").withColumn("sub", sub).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), every - 1)))
    dealt = dealt.select(F.col("region").alias("t"), F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "doc_id", "root", "size")
    dealt = written(dealt.withColumns({"is_left": F.col("sub") == F.col("i"), "is_right": F.col("sub") == F.col("j")}), "join-tiles")
    rows, size = dealt.agg(F.count("*"), F.sum(8 * F.col("size"))).first()
    sets = texts.shingle_sets(members.select("doc_id"))
    links = _multiplied(dealt, sets, rows, size or 0)
    drop_written(members, dealt, sets)
    return links


def pairs_of_few(members: DataFrame) -> DataFrame:
    """(a, b): rows of one n-gram and different roots that may first meet there; those with its hub have been multiplied.

    ``members`` has key, hub, doc_id, root, size and i, of n-grams with FEW_ROWS rows at most.
    """
    side = lambda s: members.where("doc_id <> hub").select("key", *[F.col(c).alias(c + s) for c in ("doc_id", "root", "size", "i")])
    meet = side("_x").join(side("_y"), "key").where("doc_id_x < doc_id_y and root_x <> root_y").where(may_begin("size_x", "i_x", "size_y", "i_y"))
    return meet.select(F.col("doc_id_x").alias("a"), F.col("doc_id_y").alias("b")).distinct()


def class_links(texts: Texts, reps: DataFrame) -> DataFrame:
    """Links between classes of equal sets that connect all that are linked; ``reps`` has doc_id (the class's number), size and keys."""
    reps = written(reps, "join-reps")
    cells = reps.select("doc_id", "size", F.posexplode("keys").alias("i", "key"))
    buckets = written(with_hubs(cells, ("size", "i")), "join-buckets")
    stars = buckets.where("doc_id <> hub").where(may_begin("size", "i", "hub_size", "hub_i"))
    first = product_of_pairs(texts, stars.select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    # n-grams whose rows the first links don't connect
    roots = components(first)
    placed = buckets.join(roots, buckets["doc_id"] == roots["node"], "left").select("key", "hub", "doc_id", "size", "i", F.coalesce("root", "doc_id").alias("root"))
    placed = written(placed, "join-placed")
    several = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("rows")).where("low <> high").select("key", "rows")
    left = written(placed.join(several, "key"), "join-left")
    drop_written(reps, buckets, placed)
    out = first.union(product_of_pairs(texts, pairs_of_few(left.where(F.col("rows") <= FEW_ROWS))))
    many = left.where(F.col("rows") > FEW_ROWS)
    if not small_enough(many, 0):
        region = regions(many)
        inside = product_of_regions(texts, many.select("doc_id", "root", "size").dropDuplicates(["doc_id"]).join(region, "doc_id"))
        out = out.union(inside).union(product_of_pairs(texts, pairs_across(many.drop("rows").join(region, "doc_id"), "size", sizes_allow)))
    drop_written(left)
    return out


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document, one row per row of ``docs``.

    ``docs`` has doc_id and text. Words are runs of other characters than ASCII white
    space, A-Z lower-cased. Documents are linked if their sets of four-word shingles share
    at least 85 % of their union; a text of fewer words is one shingle. component_id is
    the smallest doc_id that links reach, the own one included.

    Null and empty texts, and texts of white space, have no shingles and are linked with
    nothing. A row without doc_id is linked with nothing and has no component_id. Each row
    is a document of its own, so rows of one doc_id with different texts go each with its
    own text's links. Very long texts are compared whole. An empty table gives an empty
    result. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    wanted = COUNTERS_A_DOCUMENT * docs.count()
    counters = min(MOST_COUNTERS, max(LEAST_COUNTERS, 1 << wanted.bit_length()))
    table = written(described(docs, counters), "join-sets")
    steps = docs.sparkSession.sparkContext.broadcast(frequency_steps(table.where("segment is not null"), counters))  # MOST_COUNTERS bytes at most

    def links(names: DataFrame, usable: DataFrame, unique: bool) -> DataFrame:
        classes = names.join(usable.select("id", "text_hash", F.col("n_shingles").alias("size")).distinct(), ["id", "text_hash"]).where(F.col("size") >= LEAST_SIZE)
        reps = keyed(docs, steps).join(classes, ["id", "text_hash"])
        reps = reps if unique else reps.dropDuplicates(["id", "text_hash"])
        return class_links(Texts(docs, names, SHINGLE, unique), reps.select("doc_id", "size", "keys"))

    return with_components(table.where("segment is null"), links).select("doc_id", "n_shingles", "component_id")


def query(spark, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))


ORACLE = oracle(SHINGLE, LEAST_HUNDREDTHS)
