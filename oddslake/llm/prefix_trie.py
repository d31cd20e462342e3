"""Prefix trie of conversations by chained SHA-256 digests.

Every turn has a digest of its role and text, and every prefix of a conversation the digest
of its turns, chained: conversations share a node where depth and digest are equal. A
chain is cut into blocks of STRIDE turns. Digests of whole blocks are chained in their
turn, so no task walks through a conversation of any length, and a digest still depends
on nothing but the turns up to it.

Sums over subtrees come from nodes exploded to all their ancestors, in strides likewise:
to those of their own block, and the sums of whole blocks on to the block before. A node
of one conversation has one leaf below it and saves nothing, so only shared nodes go up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddslake.llm.common import read_table, written

#: Turns of a block.
STRIDE = 64
#: A conversation begins with up to HEADS - 1 turns of the first one of its family of FAMILY ids.
FAMILY, HEADS = 5, 9
#: Members of a node that are joined to one text at a time.
ENDS_A_CHUNK = 4096
#: Nodes that are broadcast to their children: those with more than one MOST_HUBS-th of all children (about 60 bytes each).
MOST_HUBS = 20_000

_NONE = hashlib.sha256(b"").hexdigest()


def _hash(*parts: Column) -> Column:
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _digested(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, digest, bytes, row) of all turns: the digest of role and text, the text's UTF-8 bytes and a number."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    content = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    turns = conversations.select(F.col("conv_id").cast("long"), "turn", F.unhex(F.sha2(content, 256)).alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    return written(turns.where("conv_id is not null").withColumn("row", F.monotonically_increasing_id()), "trie-turns")


def _numbered(turns: DataFrame) -> DataFrame:
    """(part, conv_id, local, digest, bytes): turns in order, numbered from 1 within their conversation and range of rows.

    Ranges are cut anywhere, so a conversation of any length is spread over many tasks.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "digest", "row"]

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            local = np.arange(1, len(ids) + 1) - np.repeat(starts, np.diff([*starts, len(ids)]))
            if ids[0] == last:
                local[: starts[1] if len(starts) > 1 else len(ids)] += count
            last, count = ids[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([batch.column("part"), batch.column("conv_id"), pa.array(local, pa.int64()), batch.column("digest"), batch.column("bytes")], names=["part", "conv_id", "local", "digest", "bytes"])

    ranged = turns.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.select(F.spark_partition_id().alias("part"), "conv_id", "digest", "bytes").mapInArrow(number, "part int, conv_id long, local long, digest binary, bytes long"), "trie-numbered")


def _rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations (conv_id, size), and their turns (conv_id, i from 0, digest, bytes, ends)."""
    numbered = _numbered(_digested(conversations))
    counts = numbered.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    so_far = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = written(counts.withColumn("before", F.coalesce(F.sum("rows").over(so_far), F.lit(0))), "trie-counts")
    sizes = counts.groupBy("conv_id").agg(F.sum("rows").alias("n"))
    convs = sizes.withColumns({"h": F.crc32(F.col("conv_id").cast("string")) % HEADS, "leader": F.col("conv_id") - F.col("conv_id") % FAMILY})
    convs = convs.join(sizes.select(F.col("conv_id").alias("leader"), F.col("n").alias("leader_n")), "leader", "left")
    convs = convs.withColumn("k", F.least("h", F.coalesce("leader_n", F.lit(0)))).withColumn("size", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = written(convs.select("conv_id", "leader", "h", "k", "size"), "trie-conversations")
    # a conversation's turns meet its numbers range by range, so a long one is not gathered
    placed = numbered.join(counts.join(convs, "conv_id").drop("rows"), ["conv_id", "part"]).withColumn("at", F.col("local") + F.col("before"))
    placed = written(placed.select("conv_id", "at", "h", "k", "size", "digest", "bytes"), "trie-placed")
    columns = ["conv_id", "i", "digest", "bytes", (F.col("i") + 1 == F.col("size")).alias("ends")]
    own = placed.where("at > h").withColumn("i", F.col("at") - F.col("h") + F.col("k") - 1).select(*columns)
    heads = placed.where(f"conv_id % {FAMILY} = 0 and at < {HEADS}").select(F.col("conv_id").alias("leader"), "at", "digest", "bytes")
    led = convs.join(heads, "leader").where("at <= k").withColumn("i", F.col("at") - 1).select(*columns)
    return convs, own.union(led)


def chained(items: DataFrame, most: int) -> DataFrame:
    """``items`` with prefix, the chained digest of a conversation's items up to each, and parent, the one before (null at the first).

    ``items`` has conv_id, i (from 0 without gaps, ``most`` at most) and digest.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            prefixes, parents = [], []
            for conv, block, digest in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "block", "digest")), strict=True):
                if (conv, block) != at:
                    at, last = (conv, block), None
                parents.append(last)
                last = digest if last is None else hashlib.sha256(last + digest).digest()
                prefixes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prefixes, pa.binary()), pa.array(parents, pa.binary())], names=[*batch.schema.names, "prefix", "parent"])

    blocks = items.withColumn("block", F.floor(F.col("i") / STRIDE))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in blocks.schema) + ", prefix binary, parent binary"
    walked = blocks.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "i").mapInArrow(walk, schema)
    if most < STRIDE:
        return walked.drop("block")
    walked = written(walked, "trie-blocks")
    whole = walked.where(F.col("i") % STRIDE == STRIDE - 1).select("conv_id", F.col("block").alias("i"), F.col("prefix").alias("digest"))
    upper = chained(whole, most // STRIDE)
    tail = F.when(F.col("parent").isNull(), F.col("digest")).otherwise(_hash("parent", "digest"))
    upper = upper.select("conv_id", (F.col("i") + 1).alias("block"), F.col("prefix").alias("head"), tail.alias("tail"))
    joined, first = walked.join(upper, ["conv_id", "block"], "left"), F.col("head").isNull()
    parent = F.when(first, F.col("parent")).when(F.col("parent").isNull(), F.col("tail")).otherwise(_hash("head", "parent"))
    return joined.withColumns({"prefix": F.when(first, F.col("prefix")).otherwise(_hash("head", "prefix")), "parent": parent}).select(*items.columns, "prefix", "parent")


def subtree_sums(own: DataFrame, paths: DataFrame, most: int) -> DataFrame:
    """(i, node, n_leaves, saved, conv_id): sums over the subtree of each node at depth i; conv_id is some member of it.

    ``own`` has i, node, n_leaves, saved and conv_id, a member; ``paths`` has the nodes
    (conv_id, i, node) of all members, i up to ``most`` at least.
    """
    sums = [F.sum(c).alias(c) for c in ("n_leaves", "saved")] + [F.min("conv_id").alias("conv_id")]
    ways = paths.select("conv_id", F.floor(F.col("i") / STRIDE).alias("block"), F.col("i").alias("up"), F.col("node").alias("ancestor"))

    def explode(rows: DataFrame) -> DataFrame:
        return rows.join(ways, ["conv_id", "block"]).where("up <= i").select("conv_id", F.col("up").alias("i"), F.col("ancestor").alias("node"), "n_leaves", "saved")

    near = explode(own.withColumn("block", F.floor(F.col("i") / STRIDE))).groupBy("i", "node").agg(*sums)
    if most < STRIDE:
        return near
    near = written(near, "trie-sums")
    fold = lambda rows, *more: rows.where(F.col("i") % STRIDE == 0).select(*more, "conv_id", F.floor(F.col("i") / STRIDE).alias("i"), "node")
    tops = subtree_sums(fold(near, "n_leaves", "saved"), fold(paths), most // STRIDE).where("i > 0")
    carried = explode(tops.select("conv_id", (F.col("i") * STRIDE).alias("i"), "n_leaves", "saved", (F.col("i") - 1).alias("block")))
    return near.unionByName(carried).groupBy("i", "node").agg(*sums)


def _ends(ends: DataFrame) -> DataFrame:
    """(depth, node, ends_sha256) of rows (depth, node, conv_id): the hash of each node's ids in order, joined by commas.

    Ids are put in order and joined to chunks range by range, however many a node has; one
    hash then runs through a node's chunks in order, of which it holds one at a time.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "conv_id")), range(batch.num_rows), strict=True)
            found = [(*key, ids[0], ",".join(map(str, ids)).encode()) for (*key, _), own in groupby(rows, lambda r: (r[0], r[1], r[3] // ENDS_A_CHUNK)) for ids in [[r[2] for r in own]]]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found, strict=True), (pa.int64(), pa.binary(), pa.int64(), pa.binary()), strict=True)] if found else [pa.array([], t) for t in (pa.int64(), pa.binary(), pa.int64(), pa.binary())], names=["depth", "node", "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        out = lambda rows: pa.RecordBatch.from_arrays([pa.array([d for (d, _), _ in rows], pa.int64()), pa.array([n for (_, n), _ in rows], pa.binary()), pa.array([x for _, x in rows], pa.string())], names=["depth", "node", "ends_sha256"])
        for batch in batches:
            done = []
            for depth, node, ids in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "ids")), strict=True):
                if (depth, node) == at:
                    held.update(b"," + ids)
                    continue
                if at is not None:
                    done.append((at, held.hexdigest()))
                at, held = (depth, node), hashlib.sha256(ids)
            yield out(done)
        if at is not None:
            yield out([(at, held.hexdigest())])

    ends = written(ends, "trie-ends")
    order = ["depth", "node", "conv_id"]
    chunks = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, node binary, first long, ids binary")
    return chunks.repartition("depth", "node").sortWithinPartitions("depth", "node", "first").mapInArrow(digest, "depth long, node binary, ends_sha256 string")


def _with_parents(nodes: DataFrame) -> DataFrame:
    """``nodes`` with parent_conv_id; nodes with very many children are broadcast to them, so that these are not gathered."""
    parents = nodes.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    much = F.col("n_children") * MOST_HUBS > nodes.count()  # fewer than MOST_HUBS nodes, as children are nodes themselves
    hubs, others = F.broadcast(parents.where(much).drop("n_children")), parents.where(~much).drop("n_children")
    key = ["depth", "parent"]
    below = nodes.where("depth > 0")
    top = nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return below.join(hubs, key).unionByName(below.join(hubs, key, "left_anti").join(others, key)).unionByName(top)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix trie of all rebuilt conversations.

    ``conversations`` has conv_id, turn, role and text. Turns go by turn, null first; turns
    of one number go by the digest of role and text. Null roles and texts count as empty.
    Conversation c is rebuilt from the first h turns of conversation c - c % 5 (all if it
    has fewer, none if there is none) and its own turns after the first h, where h is the
    CRC-32 of c's decimal text modulo 9. Remainders have the sign of c.

    Returns for each node conv_id (its smallest member), depth, parent_conv_id, n_convs
    (members), n_children, n_leaves and saved_tokens (sums over its subtree), and
    ends_sha256 (of the ids of conversations that end there).

    Rows without conv_id belong to no conversation and are left out. Repeated rows are
    turns of their own. Texts of any length count whole, and conversations may have any
    number of turns. A conversation that is rebuilt to no turns is a member of the root.
    An empty table has no nodes. Other columns are not read.
    """
    convs, turns = _rebuilt(conversations)
    most = convs.agg(F.max("size")).first()[0] or 0
    root = F.lit(b"")
    depth = lambda c: F.col(c).cast("long").alias("depth")
    paths = chained(turns, most).select("conv_id", (F.col("i") + 1).cast("long").alias("depth"), F.col("prefix").alias("node"), F.coalesce("parent", root).alias("parent"), "bytes", "ends")
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"), (F.col("size") == 0).alias("ends"))
    paths = written(paths.union(tops), "trie-paths")
    nodes = paths.groupBy("depth", "node", "parent").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"))
    nodes = written(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("node")).agg(F.count("*").alias("n_children"), F.count_if(F.col("n_convs") == 1).alias("lone"))
    nodes = written(nodes.join(children, ["depth", "node"], "left").fillna(0, ["n_children", "lone"]), "trie-shape")

    shared = nodes.where("n_convs > 1").select("conv_id", F.col("depth").alias("i"), "node", (F.col("lone") + (F.col("n_children") == 0).cast("long")).alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("bytes")).alias("saved"))
    deepest = shared.agg(F.max("i")).first()[0] or 0
    sums = subtree_sums(shared, paths.where(F.col("depth") <= deepest).select("conv_id", F.col("depth").alias("i"), "node"), deepest).select(depth("i"), "node", "n_leaves", "saved")
    ends = _ends(paths.where("ends").select("depth", "node", "conv_id"))
    out = _with_parents(nodes).join(sums, ["depth", "node"], "left").join(ends, ["depth", "node"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(_NONE)).alias("ends_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


#: The same trie with whole prefixes in place of chained digests; CRC-32 bit by bit.
ORACLE = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS leader FROM t GROUP BY conv_id),
c AS (
  SELECT s.*, coalesce(l.n, 0) AS leader_n,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(s.conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 9 AS h
  FROM s LEFT JOIN s l ON l.conv_id = s.leader),
r AS (
  SELECT c.conv_id, least(h, leader_n) + pos - h AS d, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h
  UNION ALL
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.leader AND pos <= h),
l AS (SELECT conv_id, list(strlen(role) || ':' || role || strlen(text) || ':' || text ORDER BY d) AS turns, list(strlen(text) ORDER BY d) AS sizes FROM r GROUP BY conv_id),
a AS (SELECT s.conv_id, coalesce(turns, []) AS turns, coalesce(sizes, []) AS sizes FROM s LEFT JOIN l ON l.conv_id = s.conv_id),
e AS (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM a),
p AS (
  SELECT conv_id, d, CASE WHEN d > 0 THEN sha256(array_to_string(turns[1:d], '')) ELSE '' END AS node,
         CASE WHEN d > 1 THEN sha256(array_to_string(turns[1:d - 1], '')) WHEN d = 1 THEN '' END AS parent,
         CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS bytes, d = len(turns) AS ends
  FROM e),
n AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM n LEFT JOIN k ON k.d = n.d AND k.node = n.node),
u AS (
  SELECT p.d, p.node, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.bytes) AS saved
  FROM m JOIN p ON p.conv_id = m.conv_id AND p.d <= m.d GROUP BY p.d, p.node)
SELECT m.conv_id, m.d AS depth, o.conv_id AS parent_conv_id, m.n_convs, m.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN u ON u.d = m.d AND u.node = m.node LEFT JOIN n o ON o.d = m.d - 1 AND o.node = m.parent
"""
