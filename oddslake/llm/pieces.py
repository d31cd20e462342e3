"""SentencePiece encoding and decoding for merge-type vocabularies.

The encoder keeps an agenda of adjacent symbol pairs ordered by score: the best-scored pair
(on ties the leftmost) is merged, its new neighbours join the agenda, until no pair is a
piece. A text is first cut where no piece can reach across, which leaves the merges as
they are and makes the parts short and frequent, so each part is merged once and kept.
The new short parts of a slice are merged side by side, each with its own agenda as a
column of one array; longer ones have a heap. Decoding works on ids alone.

Work is done in Arrow batches. In every batch these are compared with the sentencepiece
library, and a difference raises an error: the parts met for the first time, one whole
text, and the decoding of that text and of all texts with bytes beyond ASCII among their
pieces or with blanks or marks at an end. Texts that repeat within a slice of a batch are
encoded once.
"""

from __future__ import annotations

import functools
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddslake.llm.common import bound_batches, read_table, slices

#: The mark that stands for a blank in pieces.
BLANK = "▁"
#: Parts kept by one Python worker (about 250 bytes each); beyond it those not met lately are forgotten.
MOST_KEPT = 200_000
#: Longer parts are merged in each slice that they occur in and not kept.
LONGEST_KEPT = 48
#: Parts merged side by side.
MOST_ABREAST = 20_000
#: An agenda's entry is a pair's place in the order of scores times this, so that its place in the part can be added.
PLACES = 64
#: The entry of a pair that is no piece; more than all others.
NEVER = 1 << 30


class PieceVocabulary:
    """A merge-type vocabulary with byte fallback, as a sentencepiece model file holds it.

    Expected: a dummy blank before each text, blanks written as the mark, no other change
    to the text, no user-defined or unused pieces, and no piece with a mark after another
    character. ValueError otherwise.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        #: Scores of the pieces, negated: the agenda takes the least first.
        self.rank: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte_id: dict[int, int] = {}
        self.surface: list[bytes] = []
        for i in range(lib.get_piece_size()):
            piece = lib.id_to_piece(i)
            if lib.is_unused(i):
                raise ValueError("unused pieces are not supported")
            if lib.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif lib.is_control(i):
                self.surface.append(b"")
            elif lib.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.rank[piece], self.id[piece] = -lib.get_score(i), i
                self.surface.append(piece.replace(BLANK, " ").encode())
        if len(self.byte_id) != 256 or any(BLANK in p.lstrip(BLANK) or "\n" in p for p in self.rank):
            raise ValueError("byte pieces, and blanks and line ends apart from other characters, are needed")
        self.is_byte = np.zeros(len(self.surface), bool)
        self.is_byte[list(self.byte_id.values())] = True
        self.is_high = np.zeros(len(self.surface), bool)
        self.is_high[[i for b, i in self.byte_id.items() if b >= 128]] = True
        self.text = [x.decode() if not self.is_byte[i] else "" for i, x in enumerate(self.surface)]
        #: Characters that stand side by side in some piece; a text may be cut between any others.
        self.joined = {p[k : k + 2] for p in self.rank for k in range(len(p) - 1)}
        self._number_pairs()

    def _number_pairs(self) -> None:
        """Number the symbols that can occur, and tabulate the pairs of them that are pieces."""
        #: Pieces and their characters; a symbol's number is its place.
        self.symbols = list(dict.fromkeys([*self.rank, *(c for p in self.rank for c in p)]))
        number = {x: i for i, x in enumerate(self.symbols)}
        #: The number of each code point, less than -1 for those in no piece (-1 is no symbol at all).
        self.number_of_point = -2 - np.arange(0x110000, dtype=np.int32)
        for x, i in number.items():
            if len(x) == 1:
                self.number_of_point[ord(x)] = i
        #: Ids by number, -1 for characters that are no pieces.
        self.id_of_number = np.array([self.id.get(x, -1) for x in self.symbols], np.int32)
        place = {score: i for i, score in enumerate(sorted(set(self.rank.values())))}
        if (len(place) + 1) * PLACES >= NEVER:
            raise ValueError("too many scores")
        pairs = sorted(
            (number[p[:k]] * len(number) + number[p[k:]], place[score] * PLACES, number[p])
            for p, score in self.rank.items()
            for k in range(1, len(p))
            if p[:k] in number and p[k:] in number
        ) or [(-1, NEVER, -1)]
        keys, entries, whole = zip(*pairs, strict=True)
        self.pair_keys, self.pair_entries, self.pair_whole = np.array([*keys, -1], np.int64), np.array([*entries, NEVER], np.int32), np.array([*whole, -1], np.int32)
        #: The piece with a place in the order of scores, -1 if several have it.
        self.whole_of_place = np.full(len(place) + 1, -1, np.int32)
        for piece, score in self.rank.items():
            self.whole_of_place[place[score]] = number[piece] if self.whole_of_place[place[score]] == -1 else -2
        #: Open addressing: the pair in each slot, the last one (no pair) in empty slots.
        self.slots = np.full(1 << max(12, len(keys).bit_length() + 3), len(keys), np.int32)
        waiting = np.arange(len(keys), dtype=np.int32)
        at = self._slot(self.pair_keys[:-1])
        while len(waiting):
            empty = self.slots[at] == len(keys)
            self.slots[at[empty]] = waiting[empty]
            left = self.slots[at] != waiting
            waiting, at = waiting[left], (at[left] + 1) % len(self.slots)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(65 - len(self.slots).bit_length())).astype(np.int64)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For each pair of symbols its place in the table of pairs; the last one for those that are no pieces."""
        keys = left.astype(np.int64) * len(self.symbols) + right
        keys[(left < 0) | (right < 0)] = -1
        at = self._slot(keys)
        found = self.slots[at]
        none = len(self.pair_keys) - 1
        wrong = np.flatnonzero((self.pair_keys[found] != keys) & (found != none))
        while len(wrong):
            at[wrong] = (at[wrong] + 1) % len(self.slots)
            found[wrong] = self.slots[at[wrong]]
            wrong = wrong[(self.pair_keys[found[wrong]] != keys[wrong]) & (found[wrong] != none)]
        return found

    def merge_abreast(self, parts: list[str]) -> np.ndarray:
        """The symbols of parts of one length, at most LONGEST_KEPT, when no adjacent pair is a piece any more.

        A column of numbers for each part, filled up with -1. In each round every part
        merges its best-scored pair, the leftmost on ties.
        """
        width = len(parts[0])
        symbols = self.number_of_point[np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32)].reshape(-1, width).T.copy()
        if width == 1:
            return symbols
        agenda = self.pair_entries[self._pairs(symbols[:-1].ravel(), symbols[1:].ravel())].reshape(width - 1, -1)
        places = np.arange(width - 1, dtype=np.int32)[:, None]
        merged, own = symbols.copy(), np.arange(len(parts))
        while len(own):
            best = (agenda + places).min(axis=0)
            live = best < NEVER
            if not live.all():
                merged[:, own[~live]] = symbols[:, ~live]
                symbols, agenda, own, best = symbols[:, live], agenda[:, live], own[live], best[live]
            at, column = best % PLACES, np.arange(len(own))
            whole = self.whole_of_place[best // PLACES]
            if (tied := np.flatnonzero(whole < 0)).size:
                whole[tied] = self.pair_whole[self._pairs(symbols[at[tied], tied], symbols[at[tied] + 1, tied])]
            later = places > at
            np.copyto(symbols[:-1], symbols[1:], where=later)
            symbols[-1] = -1
            symbols[at, column] = whole
            np.copyto(agenda[:-1], agenda[1:], where=later[:-1])
            agenda[-1] = NEVER
            right, left = np.flatnonzero(at < width - 1), np.flatnonzero(at > 0)
            firsts, columns = np.concatenate([at[right], at[left] - 1]), np.concatenate([right, left])
            agenda[firsts, columns] = self.pair_entries[self._pairs(symbols[firsts, columns], symbols[firsts + 1, columns])]
        return merged

    def _symbol(self, number: int) -> str:
        return self.symbols[number] if number >= 0 else chr(-2 - number)

    def merge(self, part: str) -> list[str]:
        """The symbols of ``part`` when no adjacent pair is a piece any more."""
        if len(part) > LONGEST_KEPT:
            return self._merge_long(part)
        return [self._symbol(i) for i in self.merge_abreast([part])[:, 0].tolist() if i != -1]

    def _merge_long(self, part: str) -> list[str]:
        rank = self.rank.get
        symbols = list(part)
        n = len(symbols)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        agenda = [(s, i, i + 1, pair) for i, pair in enumerate(map(str.__add__, part, part[1:])) if (s := rank(pair)) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, pair = heappop(agenda)
            if after[left] != right or not symbols[left] or symbols[left] + symbols[right] != pair:
                continue  # one of the two has been merged since
            symbols[left], symbols[right] = pair, ""
            after[left] = after[right]
            if (r := after[left]) >= 0:
                before[r] = left
                if (s := rank(longer := pair + symbols[r])) is not None:
                    heappush(agenda, (s, left, r, longer))
            if (p := before[left]) >= 0 and (s := rank(longer := symbols[p] + pair)) is not None:
                heappush(agenda, (s, p, left, longer))
        return [x for x in symbols if x]

    def _spelt(self, symbols: list[str]) -> bytes:
        """Ids, as bytes of 32-bit integers, of symbols; those that are no pieces as their bytes."""
        return array("i", [i for x in symbols for i in ([self.id[x]] if x in self.id else map(self.byte_id.__getitem__, x.encode()))]).tobytes()

    def ids(self, part: str) -> list[int]:
        return np.frombuffer(self.ids_of_each([part])[0], np.int32).tolist()

    def ids_of_each(self, parts: list[str]) -> list[bytes]:
        """Ids, as bytes of 32-bit integers, of each part."""
        out: list[bytes] = [b""] * len(parts)
        of_length: dict[int, list[int]] = {}
        for k, part in enumerate(parts):
            of_length.setdefault(len(part), []).append(k)
        blocks = []
        for length, own in of_length.items():
            if length > LONGEST_KEPT:
                for k in own:
                    out[k] = self._spelt(self._merge_long(parts[k]))
            else:
                blocks += [own[i : i + MOST_ABREAST] for i in range(0, len(own), MOST_ABREAST)]
        for block in blocks:
            merged = self.merge_abreast([parts[k] for k in block]).T
            there = merged != -1
            ends = np.cumsum(there.sum(axis=1)) * 4
            flat = merged[there]
            known = np.full(len(flat), -1, np.int32)
            known[flat >= 0] = self.id_of_number[flat[flat >= 0]]
            packed = known.tobytes()
            for k, i, j in zip(block, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                out[k] = packed[i:j]
            if (known < 0).any():
                for row in np.unique(np.searchsorted(ends // 4, np.flatnonzero(known < 0), side="right")).tolist():
                    out[block[row]] = self._spelt([self._symbol(i) for i in merged[row].tolist() if i != -1])
        return out

    def needs_check(self, text: str, ids: np.ndarray) -> bool:
        """Whether decoding is more than putting pieces side by side: bytes beyond ASCII, or blanks or marks at an end."""
        return text[:1] in (" ", BLANK) or text[-1:] in (" ", BLANK) or bool(self.is_high[ids].any())

    def decode(self, ids: np.ndarray) -> str:
        """The text of ``ids``; the dummy blank goes. Bytes that form no character become U+FFFD, each."""
        if self.is_byte[ids].any():
            surface = self.surface
            text = b"".join([surface[i] for i in ids.tolist()]).decode(errors="one-mark-a-byte")
        else:
            text = "".join(map(self.text.__getitem__, ids.tolist()))
        return text[1:] if text.startswith(" ") else text


def _one_mark_a_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


class _Parts(dict):
    """Ids, as bytes of 32-bit integers, of the parts of texts; unknown parts are merged on demand.

    A key is a word with the blanks before it but the one that every word has; a key that
    starts with a line end has no such blank; a key of k blanks is k marks.
    """

    def __init__(self, vocabulary: PieceVocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        #: Parts met before those of this store; they return to it when they are met again.
        self.older: dict[str, bytes] = {}
        #: Parts met since the last check.
        self.fresh: list[str] = []
        #: Parts of this slice that are too long to keep.
        self.long: list[str] = []

    @staticmethod
    def marked(key: str) -> str:
        if key[0] == "\n":
            return key
        return BLANK + key if key[0] != " " else BLANK * len(key) if not key.strip(" ") else BLANK + key.replace(" ", BLANK)

    def _cut(self, part: str) -> bytes:
        """Ids of a long part, by the runs between which no piece can reach."""
        cuts = [k for k, pair in enumerate(map(str.__add__, part, part[1:]), 1) if pair not in self.vocabulary.joined]
        return b"".join(self.vocabulary.ids_of_each([part[i:k] for i, k in zip([0, *cuts], [*cuts, len(part)], strict=True)]))

    def add(self, keys: set[str]) -> None:
        """Make the parts ``keys`` known."""
        unknown = keys.difference(self)
        for key in unknown.intersection(self.older):
            self[key] = self.older[key]
        unknown.difference_update(self.older)
        self.long += [key for key in unknown if len(key) >= LONGEST_KEPT]
        self.fresh += unknown.difference((" ",))
        for key in self.long:
            self[key] = self._cut(self.marked(key))
        short = list(unknown.difference(self.long))
        self.update(zip(short, self.vocabulary.ids_of_each(list(map(self.marked, short))), strict=True))

    def bound(self) -> None:
        """Forget long parts, and, when the store is full, those not met since it was last full."""
        for key in self.long:
            del self[key]
        self.long.clear()
        if len(self) > MOST_KEPT // 2:
            self.older = dict(self)
            self.clear()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        split = []
        for text in texts:
            keys = text.replace(BLANK, " ").replace("\n", " \n").split(" ") if text else []
            split.append(_with_blanks(keys) if "" in keys else keys)
        self.add(set().union(*split))
        return [b"".join(map(self.__getitem__, keys)) for keys in split]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def check_fresh(self) -> None:
        """Compare the parts met since the last check with the library, then forget them."""
        fresh, self.fresh = self.fresh, []
        if not fresh:
            return
        fresh.sort(key=lambda key: key[0] == "\n")
        texts = [key if key[0] != " " or key.strip(" ") else key[1:] for key in fresh]
        own = self.vocabulary.library.encode(texts, num_threads=1)
        for k in range(bisect_left(fresh, True, key=lambda key: key[0] == "\n"), len(own)):
            del own[k][0]  # the library puts the dummy blank before a line end
        found = list(map(self.__getitem__, fresh))
        alike = [4 * len(x) for x in own] == list(map(len, found))
        if not alike or array("i", chain.from_iterable(own)).tobytes() != b"".join(found):
            key = next(key for key, ids, mine in zip(fresh, own, found, strict=True) if array("i", ids).tobytes() != mine)
            raise AssertionError(f"the part {key!r} differs from the library's encoding")


def _with_blanks(keys: list[str]) -> list[str]:
    out, waiting = [], 0
    for key in keys:
        if not key:
            waiting += 1
        elif key[0] == "\n":
            if waiting:
                out.append(" " * waiting)
            out.append(key)
            waiting = 0
        else:
            out.append(" " * waiting + key if waiting else key)
            waiting = 0
    if waiting:
        out.append(" " * waiting)
    return out


@functools.lru_cache(maxsize=2)
def _parts(path: str) -> _Parts:
    """One store for each worker process and vocabulary; tasks that follow each other share it."""
    import codecs

    codecs.register_error("one-mark-a-byte", _one_mark_a_byte)
    return _Parts(PieceVocabulary(path))


def encode(docs: DataFrame, model_path: str, decode: bool = False) -> DataFrame:
    """doc_id and ids (array<int>) of every document, with ``decode`` also ``decoded``, the text of those ids.

    ``docs`` has doc_id and text; other columns are not read. A null text counts as an
    empty one and has no ids. Null and repeated ids get a row for each input row. Texts
    are encoded whole, whatever their length. No begin or end ids, no sampling. An empty
    table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*fields, T.StructField("decoded", T.StringType())] if decode else fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _parts(model_path)
        vocabulary = parts.vocabulary
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = [x or "" for x in batch.column("text").to_pylist()]
                once = dict.fromkeys(texts)  # copies stand together more often than not
                for x, found in zip(once, parts.encode_all(list(once)), strict=True):
                    once[x] = np.frombuffer(found, np.int32)
                parts.check_fresh()
                parts.bound()
                ids = [once[x] for x in texts]
                if texts and vocabulary.library.encode(texts[0]) != ids[0].tolist():
                    raise AssertionError("a whole text differs from the library's encoding")
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                columns = [batch.column("doc_id"), pa.ListArray.from_arrays(offsets, np.concatenate(ids) if ids else np.empty(0, np.int32))]
                if decode:
                    decoded = {x: vocabulary.decode(own) for x, own in once.items()}
                    for k, (x, own) in enumerate(once.items()):
                        if (k == 0 or vocabulary.needs_check(x, own)) and vocabulary.library.decode(own.tolist()) != decoded[x]:
                            raise AssertionError("a whole text differs from the library's decoding")
                    columns.append(pa.array([decoded[x] for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    out = encode(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), decode=True)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )
