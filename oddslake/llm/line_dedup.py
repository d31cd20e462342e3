"""Line dedup with two Bloom filters: once-seen and twice-seen hashes of line keys.

Each partition adds the keys of its documents to a once-seen filter, and those that it had
seen before to a twice-seen filter. Merging two partitions moves what both saw once to the
twice-seen filter. Only keys that the merged twice-seen filter suspects leave their
partition, as counts by 128-bit hash; the counts confirm which keys really are in enough
documents. A filter may suspect too much, never too little.

The filters grow with the number of lines up to a bound. Beyond it more keys are suspected
and shuffled, with the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake.llm.common import SPACE_CHARS, bound_batches, read_table, renamed, slices, text_or_empty, written

#: Filter bits for each line, and the least and most bits of a filter (64 MB).
BITS_A_LINE, LEAST_BITS, MOST_BITS = 12, 1 << 16, 1 << 29
#: Bits that a key sets.
PROBES = 4
#: A filter is merged in so many parts.
SEGMENTS = 16
#: Repeated keys that are broadcast at most (32 bytes each). Of more, the frequent ones are broadcast and the others meet their lines by a shuffle.
MOST_KEYS = 2_000_000

_KEY = np.dtype([("hi", "<i8"), ("lo", "<i8")])
#: Column of the line numbers that the shuffle has found.
_GONE = "_gone_lines"


class Bloom:
    """A Bloom filter over pairs of 64-bit halves of a hash."""

    def __init__(self, bits: int, held: bytes | None = None):
        self.bits = bits
        self.words = np.frombuffer(held, np.uint8).copy() if held is not None else np.zeros(bits // 8, np.uint8)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        first, step = keys["lo"].view(np.uint64), keys["hi"].view(np.uint64) | np.uint64(1)
        return (first[:, None] + step[:, None] * np.arange(PROBES, dtype=np.uint64)) & np.uint64(self.bits - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = self._places(keys)
        return (self.words[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=1)

    def add(self, keys: np.ndarray) -> None:
        at = self._places(keys).ravel()
        np.bitwise_or.at(self.words, (at >> np.uint64(3)).astype(np.int64), (1 << (at & np.uint64(7))).astype(np.uint8))


class Lines:
    """The lines of a batch of texts, and the keys of those that count."""

    def __init__(self, texts: pa.Array, least_chars: int):
        import xxhash

        split = pc.split_pattern(texts.cast(pa.large_string()).fill_null(""), "\n")
        self.lines = split.flatten()
        self.per_doc = np.diff(split.offsets.to_numpy())
        keys = pc.ascii_lower(pc.ascii_trim(self.lines, SPACE_CHARS))
        self.counts = pc.greater_equal(pc.utf8_length(keys), max(1, least_chars)).to_numpy(zero_copy_only=False)
        digest = xxhash.xxh3_128_digest
        self.keys = np.frombuffer(b"".join([digest(x) for x in keys.cast(pa.large_binary()).to_pylist()]), _KEY)
        self.doc = np.repeat(np.arange(len(self.per_doc)), self.per_doc)
        self.number = np.arange(len(self.doc)) - np.repeat(np.cumsum(self.per_doc) - self.per_doc, self.per_doc)

    def firsts(self) -> np.ndarray:
        """Places of the first line of each counting key in each document."""
        at = np.flatnonzero(self.counts)
        order = at[np.lexsort((at, self.keys["lo"][at], self.keys["hi"][at], self.doc[at]))]
        same = np.zeros(len(order), bool)
        same[1:] = (self.keys[order[1:]] == self.keys[order[:-1]]) & (self.doc[order[1:]] == self.doc[order[:-1]])
        return order[~same]


def _filter_bits(docs: DataFrame) -> int:
    lines = docs.agg(F.sum(F.regexp_count(text_or_empty(), F.lit("\n")) + 1)).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, 1 << (int(BITS_A_LINE * lines) - 1).bit_length()))


def twice_seen(docs: DataFrame, least_chars: int) -> Bloom:
    """A filter that has the keys found in at least two documents, and few others."""
    bits = _filter_bits(docs)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        once, twice = Bloom(bits), Bloom(bits)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Lines(batch.column("text"), least_chars)
                keys, counts = np.unique(found.keys[found.firsts()], return_counts=True)
                twice.add(keys[(counts > 1) | once.has(keys)])
                once.add(keys)
        pack = zstandard.ZstdCompressor(level=1).compress
        part = bits // 8 // SEGMENTS
        for k in range(SEGMENTS):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([pack(x.words[k * part : (k + 1) * part].tobytes())], pa.binary()) for x in (once, twice))], names=["segment", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack, once, twice, segment = zstandard.ZstdDecompressor().decompress, 0, 0, None
        for batch in batches:
            for k, o, t in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
                o, t = (np.frombuffer(unpack(x), np.uint8) for x in (o, t))
                segment, twice, once = k, twice | t | (once & o), once | o
        if segment is not None:
            yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(twice.tobytes())], pa.binary())], names=["segment", "twice"])

    parts = docs.select("text").mapInArrow(build, "segment int, once binary, twice binary").repartitionById(SEGMENTS, F.col("segment"))
    merged = parts.mapInArrow(merge, "segment int, twice binary").collect()  # one filter, at most MOST_BITS
    import zstandard

    held = b"".join(zstandard.ZstdDecompressor().decompress(r["twice"]) for r in sorted(merged, key=lambda r: r["segment"]))
    return Bloom(bits, held if merged else None)


def repeated_keys(docs: DataFrame, held: Broadcast, least_docs: int, least_chars: int) -> DataFrame:
    """(hi, lo, n_docs, first) of the keys found in at least ``least_docs`` documents; first is (doc_id, line number).

    ``held`` is a filter that has all keys of two documents or more, or None.
    """

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found, doc_ids = Lines(batch.column("text"), least_chars), batch.column("doc_id").cast(pa.int64())
                at = found.firsts()
                if held.value is not None:
                    at = at[held.value.has(found.keys[at])]
                keys = found.keys[at]
                columns = [pa.array(keys["hi"]), pa.array(keys["lo"]), doc_ids.take(pa.array(found.doc[at])), pa.array(found.number[at].astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, names=["hi", "lo", "doc_id", "line"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(suspected, "hi long, lo long, doc_id long, line long")
    counted = rows.groupBy("hi", "lo").agg(F.count("*").alias("n_docs"), F.min(F.struct("doc_id", "line")).alias("first"))
    return counted.where(F.col("n_docs") >= least_docs)


def dedup_lines(docs: DataFrame, least_docs: int = 10, least_chars: int = 1, keep: str = "none") -> DataFrame:
    """``docs`` without the lines whose key is found in at least ``least_docs`` documents.

    A line's key is the line without white space at both ends and with A-Z lower-cased;
    keys under ``least_chars`` code points never count. With ``keep`` "none" all lines of a
    repeated key go; with "first" the line in the document of smallest doc_id (nulls first,
    then the smallest line number) stays. Returns the columns of ``docs``, text with the
    lines that stay joined by line ends, and n_lines (before) and n_dropped (long), which
    replace columns of these names. All other columns come back as they are, whatever
    their names.

    A null or empty text is one empty line and comes back empty. Very long texts are worked
    on whole. Rows are documents, so
    repeated rows and repeated or null ids count each; rows equal in id and text keep and
    lose the same lines, so with "first" each of them keeps the line. doc_id is an integer;
    ids of other types raise a ValueError. An empty table gives an empty result.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is none or first")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise ValueError("doc_id is not an integer")
    given = docs.columns
    docs, inside = renamed(docs, ("doc_id", "text", "n_lines", "n_dropped"))
    out = _dedup_lines(docs, least_docs, least_chars, keep)
    names = dict(zip(inside, given, strict=True))
    return out.toDF(*[names.get(c, c) for c in out.columns])


def _dedup_lines(docs: DataFrame, least_docs: int, least_chars: int, keep: str) -> DataFrame:
    bound_batches(docs.sparkSession)
    suspects = docs.sparkSession.sparkContext.broadcast(twice_seen(docs, least_chars) if least_docs > 1 else None)  # at most MOST_BITS
    found = written(repeated_keys(docs, suspects, least_docs, least_chars), "repeated-lines")
    total, places = found.agg(F.count("*"), F.sum("n_docs")).first()
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    out = docs.select(*others).withColumns({"n_lines": F.lit(None).cast("long"), "n_dropped": F.lit(0).cast("long")})
    if total <= MOST_KEYS:
        return _without(out, found, least_chars, keep)
    frequent = F.col("n_docs") * MOST_KEYS > places  # fewer than MOST_KEYS, as each has more than its share of the places
    return _without(_with_marks(out, found.where(~frequent), suspects, least_chars, keep), found.where(frequent), least_chars, keep).drop(_GONE)


def _held(keys: DataFrame) -> Broadcast:
    """A broadcast of at most MOST_KEYS keys in order, with the document and line of the first of each."""
    rows = keys.select("hi", "lo", F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line")).toPandas()
    table = np.empty(len(rows), _KEY)
    table["hi"], table["lo"] = rows["hi"], rows["lo"]
    order = np.argsort(table)
    kept_doc = rows["doc_id"].astype("Int64").to_numpy(dtype=np.int64, na_value=-(2**63))[order]
    kept_line = rows["line"].to_numpy(np.int64)[order] if len(rows) else np.empty(0, np.int64)
    return keys.sparkSession.sparkContext.broadcast((table[order], kept_doc, kept_line))


def _with_marks(docs: DataFrame, keys: DataFrame, suspects: Broadcast, least_chars: int, keep: str) -> DataFrame:
    """``docs`` with the numbers of the lines that have one of ``keys``, in a column _GONE (null without any).

    Keys and suspected lines meet by a shuffle of hashes; no key is in many documents, as the frequent
    ones are dealt with by broadcast. Rows of one doc_id and text lose the same lines, so
    the pair names them.
    """
    name = [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("_id"), F.xxhash64("text").alias("_hash"), F.octet_length("text").alias("_size")]
    schema = "_id long, _hash long, _size int, hi long, lo long, line int"

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Lines(batch.column("text"), least_chars)
                at = np.flatnonzero(found.counts)
                if suspects.value is not None:
                    at = at[suspects.value.has(found.keys[at])]
                doc = pa.array(found.doc[at])
                columns = [*(batch.column(c).take(doc) for c in ("_id", "_hash", "_size")), pa.array(found.keys["hi"][at]), pa.array(found.keys["lo"][at]), pa.array(found.number[at].astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["_id", "_hash", "_size", "hi", "lo", "line"])

    lines = docs.select("text", *name).mapInArrow(listed, schema).join(keys.select("hi", "lo", "first"), ["hi", "lo"])
    if keep == "first":
        kept = (F.col("_id") == F.coalesce("first.doc_id", F.lit(-(2**63)))) & (F.col("line") == F.col("first.line"))
        lines = lines.where(~kept)
    marks = lines.groupBy("_id", "_hash", "_size").agg(F.collect_set("line").alias(_GONE))  # at most a document's lines
    marks = written(marks, "line-marks").select(*[F.col(c).alias(f"_m{c}") for c in ("_id", "_hash", "_size")], _GONE)
    same = (name[0] == F.col("_m_id")) & name[1].eqNullSafe(F.col("_m_hash")) & name[2].eqNullSafe(F.col("_m_size"))
    return docs.join(marks, same, "left").select(*docs.columns, _GONE)


def _without(docs: DataFrame, keys: DataFrame, least_chars: int, keep: str) -> DataFrame:
    """``docs`` without the lines of ``keys``, at most MOST_KEYS of them, and without those numbered in a column _GONE."""
    held = _held(keys)
    marked = _GONE in docs.columns

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kept_docs, kept_lines = held.value
        for whole in batches:
            for batch in slices(whole, "text"):
                found = Lines(batch.column("text"), least_chars)
                gone = np.zeros(len(found.keys), bool)
                if len(known) and len(found.keys):
                    at = np.minimum(np.searchsorted(known, found.keys), len(known) - 1)
                    gone = (known[at] == found.keys) & found.counts
                    if keep == "first":
                        ids = batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
                        gone &= (kept_docs[at] != ids[found.doc]) | (kept_lines[at] != found.number)
                if marked:
                    starts = np.cumsum(found.per_doc) - found.per_doc
                    for start, lines in zip(starts, batch.column(_GONE).to_pylist(), strict=True):
                        if lines:
                            gone[start + np.array(lines)] = True
                yield _replaced(batch, found, gone)

    return docs.mapInArrow(drop, docs.schema)


def _replaced(batch: pa.RecordBatch, found: Lines, gone: np.ndarray) -> pa.RecordBatch:
    n_docs = len(found.per_doc)
    dropped = np.bincount(found.doc[gone], minlength=n_docs)
    texts = batch.column("text").fill_null("")
    if gone.any():
        stay = found.lines.filter(pa.array(~gone))
        offsets = np.concatenate([[0], np.cumsum(found.per_doc - dropped)])
        joined = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), stay), pa.scalar("\n", pa.large_string()))
        texts = joined.cast(texts.type)
    new = {"text": texts, "n_lines": pa.array(found.per_doc.astype(np.int64)), "n_dropped": pa.array(dropped.astype(np.int64))}
    return pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in batch.schema.names], names=batch.schema.names)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS row_no, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT row_no, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM d),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row_no) >= 10),
f AS (SELECT k.*, r.key IS NOT NULL AS gone FROM k LEFT JOIN r ON k.key = r.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '')) AS kept_sha256
FROM f GROUP BY row_no
"""
