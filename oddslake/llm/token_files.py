"""Token-id files of independent zstandard frames with a trailing seek table.

A file holds, in order: data frames, each a complete zstandard frame of the ids (unsigned
32-bit, little-endian) of some consecutive documents; one index frame that names every
document, its number of ids and its data frame; and a skippable frame with the seek table
of the public zstandard seekable format: compressed size, plain size and checksum (low 32
bits of XXH64) of each frame. A reader takes the table from the end of the file, then the
index, and decompresses only the frames of the documents asked for.

Spark deals documents to files by ranges of doc_id, so files in order are documents in order;
a task encodes the documents of its range and writes them at once.
"""

from __future__ import annotations

import functools
import os
import re
import struct
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake.llm.common import bound_batches, fresh_path, read_table, slices
from oddslake.llm.pieces import tokenizer_path

#: Of the seekable format (fixed values).
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
#: Plain bytes after which a data frame ends; a longer document has a frame of its own.
FRAME_BYTES = 256 * 1024
#: Documents in a file, about, and ranges of ids at most; beyond that a range is written as several files.
FILE_DOCS, MOST_RANGES = 8192, 20_000
#: Words kept by one Python worker.
MOST_KEPT = 600_000
LONGEST_KEPT = 48

_INDEX = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("n", "<u4"), ("frame", "<u4")])
#: Letters then marks, without apostrophes: the library cuts such a word between the two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


class BrokenFile(ValueError):
    """A token file whose checksums, sizes or magic numbers are wrong."""


class FileWriter:
    """Writes documents one after another; holds no more than one frame and the index."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes = sink, frame_bytes
        self.compress = zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.waiting: list[bytes] = []
        self.size = 0
        self.table: list[tuple[int, int, int]] = []
        self.index: list[tuple[int, int, int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.waiting and self.size + len(ids) > self.frame_bytes:
            self._end_frame()
        self.index.append((doc_id or 0, doc_id is not None, len(ids) // 4, len(self.table)))
        self.waiting.append(ids)
        self.size += len(ids)

    def _end_frame(self) -> None:
        self._frame(b"".join(self.waiting))
        self.waiting, self.size = [], 0

    def _frame(self, plain: bytes) -> None:
        import xxhash

        packed = self.compress(plain)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.sink.write(packed)

    def finish(self) -> None:
        if self.waiting:
            self._end_frame()
        self._frame(np.array(self.index, _INDEX).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class FileReader:
    """Reads documents from an open random-access file."""

    def __init__(self, source, size: int):
        self.source = source
        footer = self._at(size - 9, 9)
        count, flags, magic = struct.unpack("<IBI", footer)
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise BrokenFile("no seek table")
        start = size - 9 - 12 * count - 8
        if start < 0:
            raise BrokenFile("the seek table is longer than the file")
        raw = self._at(start, 8 + 12 * count)
        if struct.unpack("<II", raw[:8]) != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise BrokenFile("the seek table is damaged")
        self.table = np.frombuffer(raw[8:], "<u4").reshape(-1, 3)
        self.offsets = np.concatenate([[0], np.cumsum(self.table[:, 0], dtype=np.int64)])
        if self.offsets[-1] != start:
            raise BrokenFile("the frames don't fill the file")
        self.index = np.frombuffer(self.frame(count - 1), _INDEX)
        self.frames_read = 0

    def _at(self, offset: int, length: int) -> bytes:
        if offset < 0:
            raise BrokenFile("the file is too short")
        self.source.seek(offset)
        out = self.source.read(length)
        if len(out) != length:
            raise BrokenFile("the file is too short")
        return out

    def frame(self, k: int) -> bytes:
        """The plain bytes of frame ``k``, after its checksum."""
        import xxhash
        import zstandard

        packed, plain, checksum = (int(x) for x in self.table[k])
        try:
            out = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), packed), max_output_size=plain)
        except zstandard.ZstdError as error:
            raise BrokenFile(f"frame {k}: {error}") from error
        if len(out) != plain or xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != checksum:
            raise BrokenFile(f"frame {k} fails its checksum")
        self.frames_read = getattr(self, "frames_read", 0) + 1
        return out

    def documents(self, wanted: Iterable[int] | None = None) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in this file, its ids) of all documents, or of those with ids in ``wanted``."""
        counts = self.index["n"].astype(np.int64)
        starts = np.cumsum(counts) - counts
        rows = np.arange(len(self.index))
        if wanted is not None:
            rows = rows[np.isin(self.index["doc_id"], np.fromiter(wanted, np.int64)) & (self.index["known"] == 1)]
        held, plain, first = -1, b"", 0
        for k in rows:
            frame = int(self.index["frame"][k])
            if frame != held:
                held, plain = frame, self.frame(frame)
                first = int(starts[np.searchsorted(self.index["frame"], frame)])
            at = 4 * (int(starts[k]) - first)
            doc_id = int(self.index["doc_id"][k]) if self.index["known"][k] else None
            yield doc_id, int(starts[k]), plain[at : at + 4 * int(counts[k])]


class WordEncoder:
    """The tokenizers library over words that are kept: white space never joins ids here.

    Texts are cut at blanks, tabs and line ends. Words of Latin letters and marks go
    straight to the library's merge model in the form its normalizer and splitter give
    them; all others go through the whole library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.words: dict[str, bytes] = {"": b""}
        self.runs: dict[str, bytes] = {"": b""}
        self.specials = tuple(x.content for x in self.library.get_added_tokens_decoder().values())
        self.byte_char = _byte_chars()

    def _run(self, run: str) -> bytes:
        found = self.runs.get(run)
        if found is None:
            mapped = run if run.isascii() else "".join([self.byte_char[b] for b in run.encode()])
            found = np.array([x.id for x in self.model.tokenize(mapped)], "<u4").tobytes()
            if len(run) <= LONGEST_KEPT:
                self.runs[run] = found
        return found

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        out, others = {}, []
        for word in words:
            plain = _PLAIN.fullmatch(word)
            if plain and not any(s in word for s in self.specials):
                out[word] = self._run(plain[1].lower()) + self._run(plain[2])
            else:
                others.append(word)
        for word, found in zip(others, self.library.encode_batch(others, add_special_tokens=False), strict=True):
            out[word] = np.array(found.ids, "<u4").tobytes()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [x.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for x in texts]
        unknown: set[str] = set()
        for words in split:
            unknown.update(set(words).difference(self.words))
        long = {}
        if unknown:
            learnt = self._learn(unknown)
            if len(self.words) + len(learnt) > MOST_KEPT:
                self.words = {"": b""}
                learnt |= self._learn(set().union(*split) - learnt.keys() - self.words.keys())
            if len(self.runs) > MOST_KEPT:
                self.runs = {"": b""}
            long = {w: x for w, x in learnt.items() if len(w) > LONGEST_KEPT}
            self.words.update(learnt)
        out = [b"".join(map(self.words.__getitem__, words)) for words in split]
        for word in long:
            del self.words[word]
        return out


def _byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in printable]
    return [chr(b) if b in printable else chr(256 + other.index(b)) for b in range(256)]


@functools.lru_cache(maxsize=2)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class TokenFile(NamedTuple):
    """A finished file: its range and its number in it, and how many documents and ids it holds."""

    part: int
    number: int
    path: str
    n_docs: int
    n_ids: int


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, file_docs: int = FILE_DOCS) -> list[TokenFile]:
    """Encode ``docs`` (doc_id, text) and write them to token files in ``folder``, in ascending doc_id order.

    ``folder`` is a URI that all executors reach. Every document's ids end with ``end_id``.
    A null text counts as an empty one. Null ids come first. Rows with the same id are
    ordered by a hash of their texts, so they may be many: Spark cuts the ranges by id and
    hash, and rows equal in both wherever it likes. Each attempt of a task writes files of
    its own, and only the files of the attempts that succeeded are returned, one short row
    each. An empty table gives no files. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    rows = docs.count()
    if not rows:
        return []
    ranges = min(MOST_RANGES, max(1, -(-rows // file_docs)))

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end, part = _encoder(tokenizer), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        done, writer, sink = [], None, None

        def finish() -> None:
            writer.finish()
            sink.close()
            done.append({"part": part, "number": len(done), "path": path, "n_docs": len(writer.index), "n_ids": sum(x[2] for x in writer.index)})

        for whole in batches:
            for batch in slices(whole, "text"):
                found = encoder.encode([x or "" for x in batch.column("text").to_pylist()])
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), found, strict=True):
                    if writer is not None and len(writer.index) >= 2 * file_docs:
                        finish()
                        writer = None
                    if writer is None:
                        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.zst"
                        system, inner = fs.FileSystem.from_uri(path)
                        system.create_dir(os.path.dirname(inner), recursive=True)
                        sink = system.open_output_stream(inner, compression=None)
                        writer = FileWriter(sink)
                    writer.add(doc_id, ids + end)
        if writer is not None:
            finish()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("part", pa.int32()), ("number", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("doc_id").asc_nulls_first(), "text_hash", "row"]
    ordered = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "text")
    done = ordered.mapInArrow(filed, "part int, number int, path string, n_docs long, n_ids long").collect()  # a row a file
    return sorted(TokenFile(*r) for r in done)


def read(spark: SparkSession, files: list[TokenFile], wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, ids) from token files: ids as their bytes, start the ids of all documents before it.

    With ``wanted``, only the frames that hold those documents are decompressed. Damaged
    files raise BrokenFile. No files give an empty result.
    """
    before, rows = 0, []
    for x in files:
        rows.append((x.path, before))
        before += x.n_ids
    numbered = [(k, *row) for k, row in enumerate(rows)]
    table = spark.createDataFrame(numbered, "k int, path string, before long").repartitionById(min(MOST_RANGES, max(1, len(rows))), F.col("k") % MOST_RANGES).drop("k")

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, offset in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, inner = fs.FileSystem.from_uri(path)
                with system.open_input_file(inner) as source:
                    held, size = [], 0
                    for doc_id, start, ids in FileReader(source, source.size()).documents(wanted):
                        held.append((doc_id, offset + start, ids))
                        size += len(ids)
                        if size > 4_000_000:
                            yield _batch(held)
                            held, size = [], 0
                    if held:
                        yield _batch(held)

    return table.mapInArrow(load, "doc_id long, start long, ids binary")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "ids"])


def query(spark, sf_dir: str) -> DataFrame:
    files = write(read_table(spark, sf_dir, "documents"), _uri(fresh_path(spark, "tokens")), tokenizer_path("word_bpe_49k.json"), end_id=1)
    return read(spark, files).select(
        "doc_id",
        "start",
        F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


def _uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
