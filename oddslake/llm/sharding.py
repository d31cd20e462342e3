"""Sharding by a consistent-hash ring with virtual nodes and bounded loads (DataFrame functions only).

The ring is a fixed grid of hash cells. Each shard owns the cells up to its virtual nodes;
a cell's documents belong to the owner of the next virtual node clockwise. A shard takes
units only while it stays within its capacity, so what overflows continues clockwise to
the next shard with room. A unit is a cell, or a part of one: all copies of a text are in
one part. Only groups of copies that weigh a good part of a shard are split, by document. Only sums by cell, by heavy group and by unit (numbers bounded by the parameters)
are brought together to walk the ring; documents never are.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddslake.llm.common import read_table, text_or_empty, written

#: Law that this method holds.
LAW = "bytes"
#: Bits of the ring grid: 2^GRID_BITS cells.
GRID_BITS = 14
#: Virtual nodes of each shard.
VIRTUAL_NODES = 128
#: A unit is cut until it holds about 1 / UNITS_A_SHARD of a shard's mean load.
UNITS_A_SHARD = 1024
#: Copies of a text are split only if they weigh more than 1 / GROUPS_A_SHARD of a shard's mean load, then into halves of that.
GROUPS_A_SHARD = 8
#: A shard takes no unit that would bring it above the mean load by more than this part, while another has room.
SLACK = 0.0005
#: Rows in a block of slots, which is numbered by one task.
SLOT_ROWS = 4096


def ring_owners(shards: int, virtual_nodes: int = VIRTUAL_NODES, grid_bits: int = GRID_BITS) -> list[int]:
    """The owner of every grid cell: the shard of the first virtual node at or after it, clockwise.

    A virtual node's place depends on its shard and number and on the nodes of smaller
    shards alone, so a further shard only takes cells for itself. Where a cell has a node
    already, the next free one clockwise is taken, so every shard owns as many nodes.
    """
    cells = 1 << grid_bits
    if shards < 1 or virtual_nodes < 1 or shards * virtual_nodes > cells:
        raise ValueError("a ring needs 1 to 2^grid_bits virtual nodes")
    at: dict[int, int] = {}
    for shard in range(shards):
        for node in range(virtual_nodes):
            digest = hashlib.blake2b(f"{shard}:{node}".encode(), digest_size=8).digest()
            cell = int.from_bytes(digest, "big") >> (64 - grid_bits)
            while cell in at:
                cell = (cell + 1) % cells
            at[cell] = shard
    owners, owner = [0] * cells, at[min(at)]
    for cell in range(cells - 1, -1, -1):
        owner = at.get(cell, owner)
        owners[cell] = owner
    return owners


def place_units(units: list[tuple[int, int, int]], owners: list[int], shards: int, slack: float = SLACK) -> dict[tuple[int, int], int]:
    """Shard of each (cell, part, bytes) unit under bounded loads.

    Larger units are placed first, each at its owner or, where it would overfill, at the
    next owner clockwise with room. Only where no shard has room does a unit go to the least
    loaded one, which holds no more than the mean. So no shard ends above the greater of
    mean * (1 + slack) and the mean and one unit.
    """
    capacity = math.ceil(sum(x[2] for x in units) / shards * (1 + slack))
    stretches = [c for c in range(len(owners)) if c == 0 or owners[c] != owners[c - 1]]  # where an owner's cells begin
    load, out = [0] * shards, {}
    for cell, part, size in sorted(units, key=lambda x: (-x[2], x[0], x[1])):
        shard = owners[cell]
        if load[shard] + size > capacity:
            here = bisect.bisect_right(stretches, cell)
            clockwise = (owners[c] for c in itertools.chain(stretches[here:], stretches[:here]))
            shard = next((s for s in clockwise if load[s] + size <= capacity), None) if min(load) + size <= capacity else None
            if shard is None:
                shard = min(range(shards), key=lambda s: (load[s], s))
        load[shard] += size
        out[cell, part] = shard
    return out


def shard(docs: DataFrame, shards: int = 40, virtual_nodes: int = VIRTUAL_NODES, slack: float = SLACK) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of every document.

    ``docs`` has doc_id and text. Size is the text's UTF-8 bytes plus 16. The ring key is
    the text, so all copies of a text are in one shard, unless the group weighs more than
    1 / GROUPS_A_SHARD of a shard's mean load; such a group is split by doc_id, and rows of
    one id by count. Units are placed by size, the large ones first, so no shard ends above
    the mean load by more than the greater of ``slack`` of it and one of the units that
    found no room, the smallest as a rule.

    A null text counts as an empty one. Null and repeated ids are placed like others and
    get slots of their own. Slots count from 0 without gaps in each shard. An empty table
    gives an empty result. Other columns are not read.
    """
    text = text_or_empty()
    slim = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("key"),
    )
    slim = slim.groupBy(*slim.columns).agg(F.count("*").alias("n")).withColumn("cell", F.shiftrightunsigned("key", 64 - GRID_BITS).cast("int"))
    slim = written(slim, "shard-slim")
    spark = docs.sparkSession
    load = F.sum(F.col("size") * F.col("n")).alias("bytes")
    total, rows = slim.agg(load, F.sum("n")).first()
    if total is None:
        return spark.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, size long, text_crc32 long, shard int, slot long")
    grain = max(1, total // (shards * UNITS_A_SHARD))
    groups = slim.groupBy("key").agg(load, F.sum("n").alias("n"))
    portion = max(1, total // (shards * GROUPS_A_SHARD * 2))
    heavy = groups.where((F.col("bytes") > 2 * portion) & (F.col("n") > 1)).select("key", F.ceil(F.col("bytes") / portion).alias("portions"))
    unit = slim.join(F.broadcast(written(heavy, "shard-heavy")), "key", "left")  # at most shards * (GROUPS_A_SHARD + 1) rows of 16 bytes
    light = F.col("portions").isNull()
    parts = unit.where(light).groupBy("cell").agg(F.ceil(F.sum(F.col("size") * F.col("n")) / grain).alias("parts"))
    unit = unit.join(F.broadcast(parts), "cell", "left")  # at most 2^GRID_BITS rows of 12 bytes
    unit = _portions(unit, portion)
    own = F.pmod(F.xxhash64("key", F.lit(1)), "parts")
    split = F.pmod(F.xxhash64("key", F.pmod("inner", "portions")), F.lit(1 << 40)) + (1 << 40)  # apart from the cell's other parts
    unit = unit.withColumn("part", F.when(light, own).otherwise(split)).select("doc_id", "size", "text_crc32", "inner", "n", "cell", "part")
    by_unit = unit.groupBy("cell", "part").agg(load).collect()  # at most 2 * 2^GRID_BITS + shards * (UNITS_A_SHARD + 4 * GROUPS_A_SHARD) rows
    chosen = place_units([(r["cell"], r["part"], r["bytes"]) for r in by_unit], ring_owners(shards, virtual_nodes), shards, slack)
    placed = spark.createDataFrame([(c, p, s) for (c, p), s in chosen.items()], "cell int, part long, shard int")
    return _with_slots(unit.join(F.broadcast(placed), ["cell", "part"]), max(8, math.ceil(rows / (shards * SLOT_ROWS))))


def _portions(unit: DataFrame, portion: int) -> DataFrame:
    """Rows of one id and text, in a heavy group, in parts of at most ``portion`` bytes; ``inner`` is a hash of id, text and part."""
    most = F.greatest(F.lit(1).cast("long"), F.least(F.lit(SLOT_ROWS).cast("long"), F.floor(F.lit(portion) / F.col("size"))))
    most = F.when(F.col("portions").isNull(), F.col("n")).otherwise(most)
    cut = unit.withColumn("most", most).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.col("most"))))
    inner = F.xxhash64("key", "doc_id", "start")
    return cut.withColumn("inner", inner).withColumn("n", F.least(F.col("most"), F.col("n") - F.col("start"))).drop("most", "start")


def _with_slots(placed: DataFrame, blocks: int) -> DataFrame:
    """Slots without one large sort a shard: blocks are counted, their starts summed, rows numbered in their block."""
    placed = placed.withColumn("block", F.pmod(F.xxhash64("inner", F.lit(1)), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.sum("n").alias("n"))
    starts = counts.select("shard", "block", (F.sum("n").over(Window.partitionBy("shard").orderBy("block")) - F.col("n")).alias("start"))
    order = Window.partitionBy("shard", "block").orderBy("doc_id", "text_crc32", "size", "inner").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.select("doc_id", "size", "text_crc32", "shard", "block", "n", (F.sum("n").over(order) - F.col("n")).alias("before"))
    first = F.col("start") + F.col("before")
    slots = F.explode(F.sequence(first, first + F.col("n") - 1))
    return numbered.join(starts, ["shard", "block"]).select("doc_id", "size", "text_crc32", "shard", slots.alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    placed = shard(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
