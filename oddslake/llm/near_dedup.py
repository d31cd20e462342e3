"""Near-duplicate documents by b-bit MinHash.

Documents with the same shingle set form a class, of which one stands for all. Band keys over MinHash minima gather candidate classes. Of the minima only the low b
bits are kept, packed in 64-bit words; equal lanes, counted by bit operations and corrected
for chance, estimate similarity and drop candidates that are far off. What is left is
confirmed on the full shingle sets.

Candidates of a band bucket are first compared with one member of the bucket. Members that
the confirmed links already connect need no further comparison. In a bucket with members
in different components, the members outside its largest component are compared with all
others. A pair at the least similarity shares no band with a probability of about 5e-6.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import bound_batches, drop_written, give_back_memory, read_table, slices, small_enough, written

#: Words of a shingle.
SHINGLE = 5
#: Minima, bands (of MINIMA / BANDS minima each) and bits kept of each minimum.
MINIMA, BANDS, BITS = 128, 32, 4
#: Least similarity of a link, in hundredths of the union.
LEAST_HUNDREDTHS = 75
#: A candidate goes on if its estimate is at most so much below the least similarity: five standard errors.
SLACK = 0.20
#: Copies of a class row, so that a class with very many documents is joined by many tasks.
SALTS = 32
#: Buckets of ids that a broadcast names at most (8 bytes each).
ID_BUCKETS = 1 << 20
#: Documents in a part of a region; a task holds two parts with their sets.
BLOCK = 512
#: Fewer buckets than this are so full that their hub is broadcast (16 bytes each).
MOST_FULL = 20_000
#: Regions or buckets of several roots whose shape is broadcast at most (40 bytes each).
MOST_SHAPES = 500_000
#: Words whose hashes one Python worker keeps.
MOST_KEPT = 150_000

_RANDOM = np.random.default_rng(20240117)
_MASK = _RANDOM.integers(0, 2**32, MINIMA, np.uint32)[:, None]
_FACTOR = (_RANDOM.integers(0, 2**32, MINIMA, np.uint32) | np.uint32(1))[:, None]
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > MOST_KEPT:
            self.clear()
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found


_WORDS = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words_each: int = SHINGLE) -> np.ndarray:
    """The sorted 64-bit hashes of the text's distinct shingles; empty without words."""
    words = text.encode().lower().split() if text else []  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    width = min(words_each, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _MIX + hashes[k : len(hashes) - width + 1 + k]
    return np.unique(_mixed(out))


def minima(items: np.ndarray) -> np.ndarray:
    """MINIMA minima of 32-bit hashes of the items, of which there is at least one."""
    low = (items >> np.uint64(32)).astype(np.uint32)[None, :]
    out = np.full(MINIMA, 2**32 - 1, np.uint32)
    for start in range(0, low.shape[1], 4096):
        x = (low[:, start : start + 4096] ^ _MASK) * _FACTOR
        x ^= x >> np.uint32(15)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def packed(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of each minimum, packed into 64-bit words. One row of minima for each document."""
    lanes = (least & np.uint32(2**BITS - 1)).astype(np.uint64).reshape(len(least), -1, 64 // BITS)
    return (lanes << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(axis=2, dtype=np.uint64).view(np.int64)


def band_keys(least: np.ndarray) -> np.ndarray:
    rows = least.reshape(len(least), BANDS, -1).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), rows.shape[:2])
    for k in range(rows.shape[2]):
        keys = _mixed(keys * _MIX + rows[:, :, k])
    return keys.view(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set hash (hi, lo), packed bits (sig), band keys and text hash of every document."""
    schema = "doc_id long, n_shingles long, hi long, lo long, sig array<long>, bands array<long>, text_hash long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for whole in batches:
            for batch in slices(whole, "text"):
                n = batch.num_rows
                sizes, digests, least = np.zeros(n, np.int64), [], np.zeros((n, MINIMA), np.uint32)
                for k, text in enumerate(batch.column("text").to_pylist()):
                    items = shingles(text)
                    sizes[k] = len(items)
                    digests.append(xxhash.xxh3_128_digest(items.tobytes()))
                    if len(items):
                        least[k] = minima(items)
                halves = np.frombuffer(b"".join(digests), np.int64).reshape(n, 2)
                lists = [pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * x.shape[1], np.ascontiguousarray(x).ravel()) for x in (packed(least), band_keys(least))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *lists, batch.column("text_hash")], names=["doc_id", "n_shingles", "hi", "lo", "sig", "bands", "text_hash"])
        _WORDS.clear()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def equal_lanes(a: str, b: str) -> Column:
    """How many of the MINIMA lanes of two packed signatures are equal."""
    out = F.lit(0)
    for k in range(MINIMA * BITS // 64):
        x = F.col(a)[k].bitwiseXOR(F.col(b)[k])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        out = out + (64 // BITS - F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111))))
    return out


def may_link(a: str, b: str) -> Column:
    """Whether the estimated similarity, corrected for lanes equal by chance, is near enough to the least."""
    chance = 2.0**-BITS
    return (equal_lanes(a, b) / F.lit(float(MINIMA)) - chance) / (1 - chance) >= LEAST_HUNDREDTHS / 100 - SLACK


class Texts(NamedTuple):
    """The documents, and the one that stands for each class: names has doc_id (the class's number), id and text_hash."""

    docs: DataFrame
    names: DataFrame
    words_each: int = SHINGLE
    #: Whether no two rows of ``docs`` with words are equal in id and text.
    unique: bool = False

    def shingle_sets(self, ids: DataFrame) -> DataFrame:
        """(doc_id, items) for the distinct class numbers in ``ids``: the full shingle sets, as bytes of sorted 64-bit hashes.

        Texts of other documents are left out before the shuffle by a broadcast of buckets
        of ids and texts, at most ID_BUCKETS of them, and then exactly.
        """
        names = written(self.names.join(ids.distinct(), "doc_id", "left_semi"), "near-names")
        bucket = lambda i: F.pmod(F.xxhash64(i, "text_hash"), F.lit(ID_BUCKETS)).alias("bucket")
        wanted = F.broadcast(names.select(bucket("id")).distinct())
        texts = self.docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("text_hash"))
        texts = texts.select("*", bucket("id")).join(wanted, "bucket", "left_semi").drop("bucket").join(names, ["id", "text_hash"])
        words_each = self.words_each

        def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text"):
                    sets = [shingles(t, words_each).tobytes() for t in batch.column("text").to_pylist()]
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["doc_id", "items"])
            _WORDS.clear()

        sets = texts.select("doc_id", "text").mapInArrow(to_sets, "doc_id long, items binary")
        return written(sets if self.unique else sets.dropDuplicates(["doc_id"]), "near-sets")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= LEAST_HUNDREDTHS * (len(x) + len(y) - both)


def confirmed(texts: Texts, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of class numbers whose full shingle sets are similar enough."""
    pairs = written(pairs, "near-candidates")
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "x"):
                sets = zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)
                similar = [_linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in sets]
                yield batch.select(["a", "b"]).filter(pa.array(similar, pa.bool_()))

    sets = texts.shingle_sets(ids)
    joined = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("items").alias("x")), "a")
    joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("items").alias("y")), "b")
    links = written(joined.select("a", "b", "x", "y").mapInArrow(compare, "a long, b long"), "near-links")
    drop_written(pairs, sets)
    return links


def block_links(table: pa.Table) -> pa.Table:
    """Links inside one block: columns i, j, sub, doc_id, root, sig and items.

    Compares the documents of part i with those of part j (or part i with itself), first
    by estimate, then by their full sets. Pairs that one root already holds are passed over.
    """
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    sub, doc, root = (table.column(c).to_numpy() for c in ("sub", "doc_id", "root"))
    sig = np.array(table.column("sig").to_pylist(), np.int64).view(np.uint64).reshape(len(doc), -1)
    items = [np.frombuffer(x, np.uint64) for x in table.column("items").to_pylist()]
    left, right = np.flatnonzero(sub == i), np.flatnonzero(sub == j)
    x = sig[left][:, None, :] ^ sig[right][None, :, :]
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    equal = MINIMA - np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=2, dtype=np.int64)
    chance = 2.0**-BITS
    near = (equal / MINIMA - chance) / (1 - chance) >= LEAST_HUNDREDTHS / 100 - SLACK
    near &= root[left][:, None] != root[right][None, :]
    if i == j:
        near &= doc[left][:, None] < doc[right][None, :]
    at, to = np.nonzero(near)
    if len(at) < 500:
        kept = [_linked(items[left[p]], items[right[q]]) for p, q in zip(at, to, strict=True)]
        at, to = at[kept], to[kept]
    else:
        both = _overlaps([items[k] for k in left], [items[k] for k in right])
        sizes = np.array([len(x) for x in items])
        union = sizes[left][:, None] + sizes[right][None, :] - both
        at, to = np.nonzero(near & (100 * both >= LEAST_HUNDREDTHS * union))
    give_back_memory()
    return pa.table({"a": doc[left[at]], "b": doc[right[to]]})


def _overlaps(xs: list[np.ndarray], ys: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of 0-1 matrices over slices of the items."""
    values = np.unique(np.concatenate([*xs, *ys]))
    out = np.zeros((len(xs), len(ys)), np.int64)
    places = [[np.searchsorted(values, s) for s in side] for side in (xs, ys)]
    for start in range(0, len(values), width):
        parts = []
        for side in places:
            m = np.zeros((len(side), width), np.float32)
            for k, p in enumerate(side):
                lo, hi = np.searchsorted(p, (start, start + width))
                m[k, p[lo:hi] - start] = 1
            parts.append(m)
        out += (parts[0] @ parts[1].T).astype(np.int64)
    return out


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes of ``links`` (a, b) but the roots: each component's smallest node.

    Alternates two contractions, each of which links neighbours to the smallest of them,
    until every node hangs on its root. Steps are written to the shared folder; their
    number grows with the logarithm of a component's size.
    """
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "near-edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = edges.select(F.col("v").alias("u"), F.col("u").alias("v")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        before, edges = edges, written(small.distinct(), "near-edges")
        drop_written(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document, one row per row of ``docs``.

    ``docs`` has doc_id and text. Words are runs of other characters than ASCII white
    space, A-Z lower-cased. Documents are linked if their sets of five-word shingles share
    at least 75 % of their union; a text of fewer words is one shingle. component_id is
    the smallest doc_id that links reach, kept whether it is the own one.

    Null and empty texts, and texts of white space, have no shingles and are linked with
    nothing. A row without doc_id is linked with nothing, has no component_id and is
    kept. Each row is a document of its own, so rows of one doc_id with different texts go
    each with its own text's links. An empty table gives an empty result. Other columns are not
    read.
    """
    return _components_of(docs).select("doc_id", "n_shingles", "component_id", "kept")


def _components_of(docs: DataFrame) -> DataFrame:
    bound_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    table = written(signatures(docs), "near-signatures")

    def links(names: DataFrame, usable: DataFrame, unique: bool) -> DataFrame:
        reps = usable.join(names, ["id", "text_hash"])
        reps = reps if unique else reps.dropDuplicates(["id", "text_hash"])
        return class_links(Texts(docs, names, unique=unique), reps.select("doc_id", "sig", "bands"))

    return with_components(table, links)


def with_components(table: DataFrame, links: Callable[[DataFrame, DataFrame, bool], DataFrame]) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and the group's number (null for rows that are a group alone) of all rows.

    ``table`` has doc_id, n_shingles, text_hash and the hash (hi, lo) of each row's set.
    ``links`` gives links (a, b) between classes of equal sets from their names (doc_id,
    the class's number, with the id and text_hash of the row that stands for it), the
    rows of ``table`` that have words and an id, and whether each of those is alone with its
    id and text.
    """
    usable = table.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = usable.groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").alias("id"), "text_hash")).alias("rep"), F.count("*").alias("n"))
    classes = written(classes.select("hi", "lo", "rep.*", "n", F.monotonically_increasing_id().alias("class")), "near-classes")  # numbers are fixed from here on
    names = classes.select(F.col("class").alias("doc_id"), "id", "text_hash")
    unique = small_enough(usable.groupBy("doc_id", "text_hash").count().where("count > 1"), 0)
    roots = components(links(names, usable.withColumnRenamed("doc_id", "id"), unique))
    linked = classes.join(roots, classes["class"] == roots["node"], "left").withColumn("group", F.coalesce("root", "class"))
    heads = linked.join(roots.select(F.col("root").alias("group")).distinct(), "group").groupBy("group").agg(F.min("id").alias("head"))
    named = linked.join(heads, "group", "left")
    shared = named.where((F.col("n") > 1) | F.col("head").isNotNull()).select("hi", "lo", "group", F.coalesce("head", "id").alias("head"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = table.select("doc_id", "n_shingles", "hi", "lo", "text_hash", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int").alias("salt"))
    out = salted.join(shared, ["hi", "lo", "salt"], "left").withColumn("alone", (F.col("n_shingles") == 0) | F.col("doc_id").isNull())
    component = F.when(F.col("alone"), F.col("doc_id")).otherwise(F.coalesce("head", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(~F.col("alone"), F.col("group")).alias("group"), "text_hash")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def class_links(texts: Texts, reps: DataFrame) -> DataFrame:
    """Confirmed links between classes that connect all that are linked.

    ``reps`` has doc_id (the class's number, once), sig and bands.
    """
    reps = written(reps, "near-reps")
    buckets = written(with_hubs(reps.select(F.explode("bands").alias("key"), "doc_id")), "near-buckets")
    sig = reps.select("doc_id", "sig")
    stars = buckets.where("doc_id <> hub").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = stars.join(sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sa")), "a").join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sb")), "b")
    first = confirmed(texts, stars.where(may_link("sa", "sb")).select("a", "b"))
    roots = components(first)
    # buckets whose members the first links don't connect
    placed = buckets.join(roots, buckets["doc_id"] == roots["node"], "left").select("key", "hub", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    placed = written(placed, "near-placed")
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    left = written(placed.join(mixed, "key", "left_semi").join(sig, "doc_id"), "near-mixed")
    region = regions(left)
    inside = _links_in_regions(texts, left.select("doc_id", "root", "sig").dropDuplicates(["doc_id"]).join(region, "doc_id"))
    across = written(pairs_across(left.join(region, "doc_id")), "near-across")
    out = first.union(inside).union(confirmed(texts, across))
    drop_written(reps, buckets, placed, left, across)
    return out


def with_hubs(cells: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """``cells`` (key, doc_id and more) of the buckets with two members or more, and hub, the smallest member, with its ``carried`` columns.

    Hubs of the fullest buckets are broadcast to their members, which so are not gathered in
    one task. ``cells`` is read several times.
    """
    of_hub = [F.min_by(c, "doc_id").alias(f"hub_{c}") for c in carried]
    hubs = written(cells.groupBy("key").agg(F.min("doc_id").alias("hub"), *of_hub, F.count("*").alias("members")).where("members > 1"), "near-hubs")
    full = cells.count() / MOST_FULL  # fewer than MOST_FULL buckets have more members
    hot, other = (hubs.where(x).drop("members") for x in (F.col("members") > full, F.col("members") <= full))
    return cells.join(F.broadcast(hot), "key").unionByName(cells.join(F.broadcast(hot.select("key")), "key", "left_anti").join(other, "key"))


def regions(cells: DataFrame) -> DataFrame:
    """(doc_id, region): documents of one near-copy group mostly share a region, the smallest hub within two steps."""
    own = cells.groupBy("doc_id").agg(F.min("hub").alias("region"))
    keyed = cells.select("key", "doc_id").join(own, "doc_id").groupBy("key").agg(F.min("region").alias("region"))
    return written(cells.select("key", "doc_id").join(keyed, "key").groupBy("doc_id").agg(F.min("region").alias("region")), "near-regions")


def beside(members: DataFrame, shape: DataFrame, key: str) -> DataFrame:
    """``members`` joined with ``shape``, one row a ``key``: by broadcast while that is small, so that full groups are not gathered."""
    shape = written(shape, "near-shape")
    return members.join(F.broadcast(shape) if small_enough(shape, MOST_SHAPES) else shape, key)


def largest(members: DataFrame, group: str, part: str) -> DataFrame:
    """(group, main, n): the most frequent ``part`` of each group and the group's size, for groups of several parts; on ties the smallest."""
    counts = members.groupBy(group, part).agg(F.count("*").alias("own"))
    return counts.groupBy(group).agg(F.min(F.struct((-F.col("own")).alias("less"), F.col(part).alias("part")))["part"].alias("main"), F.sum("own").alias("n"), F.count("*").alias("parts")).where("parts > 1").drop("parts")


def pairs_across(members: DataFrame, mark: str = "sig", may: Callable[[str, str], Column] = may_link) -> DataFrame:
    """(a, b): pairs of a bucket's members from different regions and roots that may be linked, but for those with its hub, which have been compared.

    ``members`` has key, hub, doc_id, root, region and ``mark``, which ``may`` compares. All members of a bucket stand
    once, in parts of about BLOCK; only those outside its largest region go to every part.
    So the work on a bucket is its size times the number of strangers in it.
    """
    members = beside(members, largest(members, "key", "region"), "key").withColumn("parts", F.ceil(F.col("n") / BLOCK))
    x = members.withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts"))
    y = members.where(F.col("region") != F.col("main")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    columns = lambda df, s: df.select("key", "part", *(F.col(c).alias(c + s) for c in ("doc_id", "root", "region", mark)))
    x, y = columns(x.where("doc_id <> hub"), "_x"), columns(y.where("doc_id <> hub"), "_y")
    other = (F.col("region_x") != F.col("region_y")) & (F.col("root_x") != F.col("root_y"))
    pairs = x.join(y, ["key", "part"]).where(other & may(f"{mark}_x", f"{mark}_y"))
    return pairs.select(F.least("doc_id_x", "doc_id_y").alias("a"), F.greatest("doc_id_x", "doc_id_y").alias("b")).distinct()


def _links_in_regions(texts: Texts, members: DataFrame) -> DataFrame:
    """All links inside regions between different roots.

    Members are cut into parts of about BLOCK, those of the region's largest root apart
    from the others. Parts of that root are held against the others' parts only, so the
    work on a region is its size times the number of its members with other roots.
    """
    members = written(members, "near-members")
    shape = largest(members, "region", "root")
    own = beside(members, shape.select("region", "main"), "region").withColumn("is_main", F.col("root") == F.col("main"))
    counts = own.groupBy("region").agg(F.ceil(F.count_if("is_main") / BLOCK).alias("main_parts"), F.ceil(F.count_if(~F.col("is_main")) / BLOCK).alias("other_parts"))
    parts = beside(own, counts, "region").join(texts.shingle_sets(own.select("doc_id")), "doc_id")
    slot = F.xxhash64("doc_id")
    parts = parts.withColumn("sub", F.when(F.col("is_main"), F.col("other_parts") + F.pmod(slot, "main_parts")).otherwise(F.pmod(slot, "other_parts")))
    every = F.when(F.col("is_main"), F.col("other_parts")).otherwise(F.col("other_parts") + F.col("main_parts"))
    dealt = parts.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), every - 1)))
    dealt = dealt.select("region", F.least("sub", "other").alias("i"), F.greatest("sub", "other").alias("j"), "sub", "doc_id", "root", "sig", "items")
    return written(dealt.groupBy("region", "i", "j").applyInArrow(block_links, "a long, b long"), "near-links")


def keep_one(docs: DataFrame, most_broadcast: int = 1_000_000) -> DataFrame:
    """The rows of ``docs`` that near_duplicates keeps, one of each group; all columns are kept, whatever their names.

    Rows are told apart by doc_id and text. Of several rows with the smallest doc_id of a
    group, the one of the smallest text hash stays, and of rows equal in both one row. Rows
    without doc_id, and null, empty and blank texts, are linked with nothing and all stay.
    Very long texts are compared whole. An empty table gives an empty result.
    """
    found = written(_components_of(docs).where("group is not null"), "near-kept")
    heads = found.where("kept").groupBy("group").agg(F.min("text_hash").alias("first"), F.count("*").alias("rows")).where("rows > 1").drop("rows")
    again = written(found.where("kept").join(heads, "group").select("doc_id", "text_hash", "first"), "near-again")  # ids that stand on several rows of a group
    several = written(again.where("text_hash = first").select("doc_id", "text_hash").distinct(), "near-several")
    spare = again.where("text_hash <> first").select("doc_id", "text_hash")
    gone = written(found.where(~F.col("kept")).select("doc_id", "text_hash").union(spare).distinct(), "near-gone")
    columns = [f"c{k}" for k in range(len(docs.columns))]  # names that can't clash
    doc_id, text = (docs.columns.index(c) for c in ("doc_id", "text"))
    rows = docs.toDF(*columns).withColumns({"_id": F.col(f"c{doc_id}").cast("long"), "_hash": F.xxhash64(f"c{text}")})
    key = (F.col("_id") == F.col("doc_id")) & (F.col("_hash") == F.col("text_hash"))
    stay = rows.join(F.broadcast(gone) if small_enough(gone, most_broadcast) else gone, key, "left_anti")  # 16 bytes a row
    if small_enough(several, 0):
        return stay.select(*columns).toDF(*docs.columns)
    alone = stay.join(several, key, "left_anti")
    once = stay.join(several, key, "left_semi").dropDuplicates(["_id", "_hash"])
    return alone.unionByName(once).select(*columns).toDF(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def oracle(words: int, least: int) -> str:
    """The same components with all pairs of documents that share a shingle, for small tables."""
    return rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(list_transform(range(1, greatest(2, len(words) - {words} + 2)), lambda k: array_to_string(words[k:k + {words - 1}], ' '))) AS items
  FROM w WHERE len(words) > 0),
i AS (SELECT doc_id, hash(unnest(items)) AS item FROM s),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM i x JOIN i y ON x.item = y.item AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM o JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b
  WHERE 100 * shared >= {least} * (len(x.items) + len(y.items) - shared)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(len(s.items), 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN s ON s.doc_id = d.doc_id LEFT JOIN c ON c.doc_id = d.doc_id
"""


ORACLE = f"SELECT *, doc_id = component_id AS kept FROM ({oracle(SHINGLE, LEAST_HUNDREDTHS)})"
