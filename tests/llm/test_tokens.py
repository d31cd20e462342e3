import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from oddslake.llm import pieces, token_files
from tokenizers import Tokenizer

from .conftest import prose

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  ", "\n", " \n x", "▁", "a▁b", "a  b   c\n\n d", "x ", " x", "don't we'll THE'S", "ΟΔΟΣ Σ", "é İ ﬁ ①Ⅷ", "a<|startoftext|>b", "a\x1cd\x85e f", "1234 12.5%", "word,word.word", "À×÷ª", "\r\n\tq", "!!'s ''", "ß ŉ", "😀😀", "Hello, WORLD... (yes)"]


def test_pieces_equal_the_library(make, odd_rows):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(ODD)]
    got = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids"], r["decoded"]) for r in pieces.encode(make(rows), MODEL, decode=True).collect())
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "")
        want.append((i is not None, i or 0, ids, library.decode(ids)))
    assert got == sorted(want)


#: Characters that are no symbols of the vocabulary and have high code points: Hangul, rare Han, full-width, mathematical, private use, emoji.
BEYOND = ["안녕하세요 세계", "Ａ", "𝒳", "龘", "🤖 robot", "\ue000", "x\U0010fffdy", "힣" * 100, "word龘" + "abc" * 30 + "🤖", "𝒳" + "long" * 40 + " 안녕"]


def test_characters_beyond_the_vocabulary(make):
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    points = [p for p in [*range(0x7B00, 0xD800, 97), *range(0xE000, 0x110000, 4099)]]
    texts = BEYOND + ["".join(map(chr, points[k::20])) for k in range(20)] + [chr(p) + "a " + "b" + chr(p) for p in points[::15]]
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in pieces.encode(make(list(enumerate(texts))), MODEL, decode=True).collect()}
    assert got == {k: (ids, library.decode(ids)) for k, t in enumerate(texts) for ids in [library.encode(t)]}


def test_merges_follow_scores_not_positions():
    vocabulary = pieces.PieceVocabulary(MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    for k in range(200):
        word = prose(k, 3).replace(" ", "")
        assert vocabulary.ids("▁" + word) == library.encode(word)


def test_decode_marks_broken_bytes():
    pieces._parts(MODEL)
    vocabulary = pieces.PieceVocabulary(MODEL)
    ids = np.array([vocabulary.byte_id[0xE6], vocabulary.id["a"]])
    assert vocabulary.decode(ids) == "�a"


def test_pieces_of_an_empty_table(make):
    assert pieces.encode(make([]), MODEL, decode=True).count() == 0


def encoded(rows):
    library, out, start = Tokenizer.from_file(WORDS), [], 0
    for i, t, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [1]
        out.append((i, start, np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_token_files_round_trip(spark, make, odd_rows, tmp_path):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(ODD)] + [(1000 + k, prose(k, 300)) for k in range(40)]
    files = token_files.write(make(rows), f"file://{tmp_path}", WORDS, 1, file_docs=16)
    assert len(files) > 2
    got = sorted(((r["doc_id"], r["start"], bytes(r["ids"])) for r in token_files.read(spark, files).collect()), key=lambda r: r[1])
    assert got == encoded(rows)
    some = {r["doc_id"]: bytes(r["ids"]) for r in token_files.read(spark, files, [105, 1010]).collect()}
    assert some == {i: x for i, _, x in encoded(rows) if i in (105, 1010)}


def test_token_files_of_one_id(spark, make, tmp_path):
    rows = [(None, prose(k % 50, 20)) for k in range(400)] + [(7, prose(k, 5)) for k in range(200)]
    files = token_files.write(make(rows), f"file://{tmp_path}", WORDS, 1, file_docs=40)
    assert len(files) > 5 and max(x.n_docs for x in files) <= 150
    got = sorted(((r["start"], r["doc_id"], bytes(r["ids"])) for r in token_files.read(spark, files).collect()), key=lambda r: r[0])
    assert [i for _, i, _ in got] == [None] * 400 + [7] * 200
    assert [s for s, *_ in got] == np.cumsum([0, *(len(x) // 4 for *_, x in got[:-1])]).tolist()
    assert Counter((i, x) for _, i, x in got) == Counter((i, x) for i, _, x in encoded(rows))


def test_readers_decompress_only_what_they_need_and_notice_damage(tmp_path):
    path = tmp_path / "x.zst"
    with path.open("wb") as sink:
        writer = token_files.FileWriter(sink, frame_bytes=64)
        for k in range(50):
            writer.add(k, np.arange(k, dtype="<u4").tobytes())
        writer.finish()
    with path.open("rb") as source:
        reader = token_files.FileReader(source, path.stat().st_size)
        assert len(reader.table) > 20
        assert [(i, s, len(x) // 4) for i, s, x in reader.documents([7])] == [(7, 21, 7)]
        assert reader.frames_read == 1
        assert [np.frombuffer(x, "<u4").tolist() for _, _, x in reader.documents()] == [list(range(k)) for k in range(50)]
    raw = bytearray(path.read_bytes())
    raw[int(reader.offsets[3]) + 8] ^= 0xFF
    path.write_bytes(bytes(raw))
    with path.open("rb") as source, pytest.raises(token_files.BrokenFile):
        list(token_files.FileReader(source, len(raw)).documents())
    path.write_bytes(bytes(raw[:-1]))
    with path.open("rb") as source, pytest.raises(token_files.BrokenFile):
        token_files.FileReader(source, len(raw) - 1)


def test_frames_are_plain_zstandard(tmp_path):
    import zstandard

    path = tmp_path / "x.zst"
    with path.open("wb") as sink:
        writer = token_files.FileWriter(sink)
        writer.add(5, b"\1\0\0\0")
        writer.finish()
    assert zstandard.ZstdDecompressor().decompress(path.read_bytes()[: writer.table[0][0]]) == b"\1\0\0\0"


def test_token_files_of_an_empty_table(spark, make, tmp_path):
    assert token_files.write(make([]), f"file://{tmp_path}", WORDS, 1) == []
    assert token_files.read(spark, []).count() == 0


def test_token_query(spark, sf_dir):
    rows = token_files.query(spark, sf_dir).orderBy("start").collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    want = encoded(list(docs.items()))
    assert [(r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in rows] == [(i, s, len(x) // 4, zlib.crc32(x)) for i, s, x in want]


def test_piece_query_on_every_document(spark, sf_dir):
    import hashlib

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = Counter((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) for i, text in docs.select("doc_id", "text").collect() for ids in [library.encode(text or "")])
    got = pieces.query(spark, sf_dir).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()
    assert Counter(map(tuple, got)) == want


def test_both_agendas_merge_alike():
    vocabulary = pieces.PieceVocabulary(MODEL)
    for k in range(300):
        part = "▁" + prose(k, 8).replace(" ", "")[: pieces.LONGEST_KEPT - 1]
        assert vocabulary.merge(part) == vocabulary._merge_long(part)


def test_the_list_of_fresh_parts_empties():
    parts = pieces._Parts(pieces.PieceVocabulary(MODEL))
    for k in range(4):
        parts.encode(f"{'x' * 60}{k} {'abc' * 40} word {prose(k, 30)}")
        assert parts.fresh
        parts.check_fresh()
        assert parts.fresh == []


def test_parts_merged_abreast_equal_those_merged_alone():
    vocabulary = pieces.PieceVocabulary(MODEL)
    parts = sorted({f"▁{x}{end}" for k in range(40) for x in prose(k, 20).split() for end in ("", "é", "\U0001f600", "\x00", "漢字", "▁▁")}, key=len)
    for length in {len(x) for x in parts}:
        own = [x for x in parts if len(x) == length]
        columns = vocabulary.merge_abreast(own).T.tolist()
        assert [[vocabulary._symbol(i) for i in c if i != -1] for c in columns] == [vocabulary._merge_long(x) for x in own]


def test_a_small_store_forgets_and_meets_parts_again(monkeypatch):
    monkeypatch.setattr(pieces, "MOST_KEPT", 40)
    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    parts = pieces._Parts(pieces.PieceVocabulary(MODEL))
    for k in range(12):
        texts = [prose(k % 3, 60), "", f"{'y' * 70}{k} {'abc' * 40}\n\n {prose(k, 30)}"]
        assert [np.frombuffer(x, np.int32).tolist() for x in parts.encode_all(texts)] == [library.encode(x) for x in texts]
        parts.check_fresh()
        parts.bound()
        assert len(parts) <= pieces.MOST_KEPT // 2 and not any(len(x) >= pieces.LONGEST_KEPT for x in parts)
