"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only).

Every document has a 63-bit hash: of its id, and then of its row, which tells rows with one
id or none apart. A histogram of sizes by source and leading hash bits
finds, for each source, the bucket in which its remaining budget runs out; only that bucket
is split further by the next bits, until the hash is used up. The result is one threshold
per source: documents below it are taken once more. Of rows that are still equal at the
threshold, so many are taken as come nearest. Nothing is sorted or ranked by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddslake.llm.common import SPACE_CLASS, read_table, renamed, small_enough, written

#: Bits of the document hash that each histogram level resolves; together 63, of which ROW_BITS are the row's.
LEVELS = (11, 11, 10, 11, 10, 10)
ROW_BITS = 31
#: Equal rows that one task repeats at a time.
ROWS_A_BLOCK = 1_000
#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)
#: Most source rows that are broadcast to the documents (about 100 bytes each).
MOST_BROADCAST_SOURCES = 50_000


def word_count(column: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(column), F.lit("[^ \\t-\\r]+")), F.lit(0)).cast("long")


def id_hash(column: str) -> Column:
    """The first 32 bits of the MD5 of an id's decimal text (null: of the empty text)."""
    digest = F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def row_hash(docs: DataFrame, columns: list[str]) -> Column:
    """The id's hash, and below it ROW_BITS bits of a hash of ``columns`` (without those that hold maps)."""
    hashed = [docs[c] for c in columns if not any(x in docs.schema[c].dataType.simpleString() for x in ("map<", "variant"))]
    return F.shiftleft(id_hash("doc_id"), ROW_BITS).bitwiseOR(F.shiftrightunsigned(F.xxhash64(*hashed), 64 - ROW_BITS))


def source_targets(sizes: DataFrame, share: float, most_repeats: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Targets by water-filling: ``sizes`` has (source, source_size), one row a source.

    Sources take ``share`` of all sizes by weight, each at most ``most_repeats`` times its
    own size. A source meets its cap when the common level passes cap / weight, so in order
    of that ratio the level follows from running sums. The table has one row per source and
    is worked out in one task, which holds for thousands of sources, not for millions.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").asc_nulls_last())
    ratio_order = every.orderBy("ratio", F.col("source").asc_nulls_last())
    before = ratio_order.rowsBetween(Window.unboundedPreceding, -1)
    weight_at = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    out = (
        sizes.withColumn("weight", weight_at)
        .withColumn("cap", F.col("source_size").cast("double") * most_repeats)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("is_capped", F.col("ratio") <= F.col("level"))
        .withColumn("final_level", F.min(F.when(~F.col("is_capped"), F.struct("ratio", "source", "level"))).over(every)["level"])
    )
    return out.select("source", "source_size", F.when(F.col("is_capped"), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("final_level") * F.col("weight"))).alias("target"))


def thresholds(slim: DataFrame, targets: DataFrame, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(source, source_size, target, repeats, threshold, edge): hashes below the threshold are taken once more.

    So are ``edge`` of the rows whose hash is the threshold; it is above 0 only where
    several rows share that hash and some but not all of them are to be taken. ``slim`` has (source, size, hash). Each level sums sizes in the sources' boundary
    buckets only, so its table has at most 2^bits rows a source.
    """
    whole = F.floor(F.col("target") / F.col("source_size"))
    plan = targets.withColumn("repeats", F.when(F.col("source_size") > 0, whole).otherwise(0).cast("long"))
    plan = plan.withColumn("rest", F.col("target") - F.col("repeats") * F.col("source_size"))
    state = plan.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("edge"))
    done_bits, all_bits = 0, sum(levels)
    for bits in levels:
        left = all_bits - done_bits - bits
        boundary = state.select(F.col("source").alias("s"), "prefix", "rest", "below")
        keyed = slim.withColumn("own", F.shiftright("hash", left + bits)).withColumn("bucket", F.shiftright("hash", left))
        inside = keyed.join(_maybe_broadcast(boundary), F.col("source").eqNullSafe(F.col("s")) & (F.col("own") == F.col("prefix")))
        counts = inside.groupBy("source", "bucket").agg(F.sum("size").alias("n"), F.count("*").alias("rows"), F.first("rest").alias("rest"), F.first("below").alias("below"))
        order = Window.partitionBy("source").orderBy("bucket")
        running = counts.withColumn("upto", F.col("below") + F.sum("n").over(order)).withColumn("prior", F.col("upto") - F.col("n"))
        taken = F.col("upto") <= F.col("rest")
        # rows of the last level's open bucket are equal: so many are taken as come nearest
        nearest = F.ceil((F.col("rest") - F.col("prior")) * F.col("rows") / F.col("n") - 0.5)
        part = F.lit(0) if left else F.when(F.col("n") > 0, F.least(F.col("rows"), F.greatest(F.lit(0), nearest))).otherwise(0)
        # the first bucket that is not wholly taken; past the last bucket if all are
        cut = running.groupBy("source").agg(
            F.min(F.when(~taken, F.struct("bucket", part.cast("long").alias("part"), "rows"))).alias("open"),
            F.max("bucket").alias("last_bucket"),
            F.max(F.when(taken, F.col("upto"))).alias("taken_upto"),
            F.first("below").alias("below"),
        )
        all_of_it = F.lit(False) if left else F.col("open.part") == F.col("open.rows")
        step = cut.select(
            F.col("source").alias("s"),
            F.coalesce(F.col("open.bucket") + F.when(all_of_it, 1).otherwise(0), F.col("last_bucket") + 1).alias("new_prefix"),
            F.when(all_of_it, 0).otherwise(F.coalesce(F.col("open.part"), F.lit(0))).cast("long").alias("new_edge"),
            F.coalesce(F.col("taken_upto"), F.col("below")).alias("new_below"),
        )
        # a source whose boundary bucket is empty has no rows left to refine: its threshold stands
        state = state.join(step, F.col("source").eqNullSafe(F.col("s")), "left").select(
            "source",
            "rest",
            F.coalesce("new_prefix", F.shiftleft("prefix", bits)).alias("prefix"),
            F.coalesce("new_below", "below").alias("below"),
            F.coalesce("new_edge", F.lit(0).cast("long")).alias("edge"),
        )
        state = written(state, "mix-threshold")
        done_bits += bits
    found = state.select(F.col("source").alias("s"), F.col("prefix").alias("threshold"), "edge")
    return plan.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")


def _maybe_broadcast(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if small_enough(sources, MOST_BROADCAST_SOURCES) else sources


def _plan(docs: DataFrame, columns: list[str], share: float, most_repeats: int, weights: tuple[int, ...]) -> tuple[DataFrame, DataFrame]:
    """The written sizes and hashes of ``docs``, and the thresholds of its sources."""
    slim = written(docs.select("doc_id", "source", word_count("text").alias("size"), row_hash(docs, columns).alias("hash")), "mix-sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes, share, most_repeats, weights), "mix-targets")
    return slim, written(thresholds(slim, targets), "mix-plan")


def _with_copies(joined: DataFrame, plan: DataFrame, columns: list[str], most_repeats: int, hashed: Column) -> DataFrame:
    """``columns`` of ``joined`` and its _copies; it holds _mix_source, _mix_repeats, _mix_threshold and _mix_edge of each row's source.

    Equal rows at a threshold are counted, and as many of them as the plan says get one copy more.
    """
    repeats = F.col("_mix_repeats")
    once_more = (repeats < most_repeats) & (hashed < F.col("_mix_threshold"))
    copies = lambda more: F.least(F.lit(most_repeats).cast("long"), repeats + F.when(more, 1).otherwise(0))
    if not plan.where((F.col("_mix_edge") > 0) & (repeats < most_repeats)).limit(1).count():
        return joined.select(*columns, copies(once_more).alias("_copies"))
    at_edge = (F.col("_mix_edge") > 0) & (repeats < most_repeats) & (hashed == F.col("_mix_threshold"))
    clear = joined.where(~at_edge).select(*columns, copies(once_more).alias("_copies"))
    equal = joined.where(at_edge).groupBy(*columns, "_mix_source", "_mix_repeats", "_mix_edge").agg(F.count("*").alias("_n"))
    # rows of one hash that differ after all are few
    orderable = [c for c in columns if not any(x in joined.select(c).schema[0].dataType.simpleString() for x in ("map<", "variant"))]
    order = Window.partitionBy("_mix_source").orderBy(*orderable)
    before = F.sum("_n").over(order) - F.col("_n")
    equal = equal.withColumn("_more", F.least(F.col("_n"), F.greatest(F.lit(0).cast("long"), F.col("_mix_edge") - before)))
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(ROWS_A_BLOCK).cast("long")))
    blocks = equal.withColumn("_start", block).repartition(F.xxhash64("_start", "_mix_source"))
    end = F.least(F.col("_n"), F.col("_start") + ROWS_A_BLOCK) - 1
    numbered = blocks.withColumn("_at", F.explode(F.sequence(F.col("_start"), end)))
    return clear.unionByName(numbered.select(*columns, copies(F.col("_at") < F.col("_more")).alias("_copies")))


def _named(plan: DataFrame) -> DataFrame:
    return plan.select(*[F.col(c).alias(f"_mix_{c}") for c in ("source", "source_size", "target", "repeats", "threshold", "edge")])


def mix(docs: DataFrame, share: float = 1.5, most_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Each document with the copies that the mix takes of it.

    ``docs`` has doc_id, text and source. Returns doc_id, source, size (words), source_size,
    target (of its source), copies (0 to ``most_repeats``) and taken (copies * size), one
    row per row of ``docs``.

    Null texts and texts without words have size 0. Null sources form a source of their
    own, the last in order. Rows with null or repeated ids are told apart by their texts,
    and of rows with one id and text so many are taken as bring the source nearest to its
    target, so reruns agree. A source whose sizes are all 0 has target 0 and no copies. An empty table gives an empty result.
    Columns other than the three are not read.
    """
    slim, plan = _plan(docs, ["doc_id", "text"], share, most_repeats, weights)
    plan = _named(plan)
    joined = slim.join(_maybe_broadcast(plan), F.col("source").eqNullSafe(F.col("_mix_source")))
    columns = ["doc_id", "source", "size", "_mix_source_size", "_mix_target"]
    joined = _with_copies(joined, plan, columns, most_repeats, F.col("hash")).withColumnsRenamed({"_mix_source_size": "source_size", "_mix_target": "target", "_copies": "copies"})
    return joined.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, most_repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it; all columns are kept, and tell rows with one id apart.

    Null and empty texts count as texts without words: they are taken as their hash says
    and change no size. Null sources are a source of their own. Very long texts are taken or
    left whole. Rows equal in all columns are counted, and so many are taken as come
    nearest. An empty table gives an empty result.
    """
    given = docs.columns
    docs, _ = renamed(docs, ("doc_id", "source", "text"))
    _, plan = _plan(docs, docs.columns, share, most_repeats, weights)
    plan = _named(plan)
    joined = docs.join(_maybe_broadcast(plan), docs["source"].eqNullSafe(F.col("_mix_source")))
    joined = joined.withColumn("_mix_hash", row_hash(docs, docs.columns))
    taken = _with_copies(joined, plan, docs.columns, most_repeats, F.col("_mix_hash")).where("_copies > 0")
    return taken.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select(*docs.columns).toDF(*given)


def query(spark, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix with window functions over documents, for the small SQL check.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^ \t-\r]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
         source_size * 2.0::DOUBLE AS cap FROM s),
r AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS capped_before,
         sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0::DOUBLE) AS weight_left,
         sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (budget - capped_before) / weight_left AS lev, ratio <= (budget - capped_before) / weight_left AS is_capped FROM r),
t AS (
  SELECT source, source_size,
         CASE WHEN is_capped THEN cap
              ELSE least(cap, (SELECT arg_min(lev, ratio) FROM l WHERE NOT is_capped) * weight) END AS target
  FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
c AS (
  SELECT d.doc_id, d.size, p.source_size, p.target, p.repeats,
         p.target - p.repeats * p.source_size AS rest,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS upto,
         CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS DOUBLE) AS own
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, repeats + CASE WHEN repeats < 2 AND upto + upto - own < 2 * rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
