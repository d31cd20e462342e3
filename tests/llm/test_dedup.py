import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from oddslake.llm import line_dedup, near_dedup, ngram_join

from .conftest import prose


def plain_lines(rows, least_docs):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = Counter(k for _, t, *_ in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (key(x) and found[key(x)] >= least_docs)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines_equal_plain_python(make, odd_rows):
    common = [f"  Shared LINE {k} É" for k in range(6)]
    rows = odd_rows + [(100 + k, "\n".join([prose(k, 8), common[k % 6], "", common[(k + 1) % 6].upper().replace("É", "É") + "\t", prose(k, 3)])) for k in range(60)]
    got = line_dedup.dedup_lines(make(rows), least_docs=10).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, 10))


def test_lines_keep_the_first_and_short_keys(make):
    rows = [(k, f"same line\nown {k}\nok") for k in range(5)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(rows), least_docs=3, least_chars=3, keep="first").collect()}
    assert got[0] == "same line\nown 0\nok" and got[3] == "own 3\nok"


def test_lines_by_shuffle_and_with_a_full_filter(make, monkeypatch):
    rows = [(k, "\n".join(f"line {j}" for j in range(k % 7, k % 7 + 5)) + f"\nown {k}") for k in range(80)]
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 3)
    monkeypatch.setattr(line_dedup, "MOST_BITS", 1 << 8)
    monkeypatch.setattr(line_dedup, "LEAST_BITS", 1 << 8)
    got = line_dedup.dedup_lines(make(rows), least_docs=10).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, 10))


def plain_first_lines(rows, least_docs):
    """Rows (unique ids, keys as they stand): of a repeated line only the first, by id and line number, stays."""
    places = defaultdict(list)
    for i, t in sorted(rows):
        for n, x in enumerate(t.split("\n")):
            places[x].append((i, n))
    repeated = {x for x, at in places.items() if x and len({i for i, _ in at}) >= least_docs}
    out = []
    for i, t in rows:
        lines = t.split("\n")
        stay = [x for n, x in enumerate(lines) if x not in repeated or places[x][0] == (i, n)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def test_lines_keep_the_first_by_shuffle(make, monkeypatch):
    rows = [(k, "\n".join(f"line {j}" for j in range(k % 7, k % 7 + 5)) + f"\nown {k}\nline {k % 7 + 1}\n\nline {k % 3}") for k in range(80)]
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 3)
    got = line_dedup.dedup_lines(make(rows), least_docs=10, keep="first").select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(plain_first_lines(rows, 10))


def test_lines_of_odd_rows_by_shuffle(make, odd_rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "MOST_KEYS", 2)
    rows = odd_rows + [(None if k % 3 else k % 4, "\n".join(f"Line {j} " for j in range(k % 5, 9)) + f"\nown {k % 20}") for k in range(60)] + [(None, None)] * 3
    docs = make(rows)
    got = line_dedup.dedup_lines(docs, least_docs=10).select("doc_id", "text", "n_lines", "n_dropped").collect()
    assert Counter(map(tuple, got)) == Counter(plain_lines(rows, 10))
    assert [c for c in line_dedup.dedup_lines(docs).columns if c not in ("n_lines", "n_dropped")] == docs.columns


def test_lines_of_an_empty_table(make):
    assert line_dedup.dedup_lines(make([])).count() == 0


def test_line_query_equals_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    got = line_dedup.query(spark, sf_dir).select("doc_id", "n_lines", "n_dropped", "kept_sha256").collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(line_dedup.ORACLE).fetchall())


def test_bloom_never_forgets():
    rng = np.random.default_rng(0)
    keys = rng.integers(-(2**62), 2**62, 4000).view(line_dedup._KEY)
    bloom = line_dedup.Bloom(1 << 15)
    bloom.add(keys[:1000])
    assert bloom.has(keys[:1000]).all()
    assert bloom.has(keys[1000:]).mean() < 0.2


def plain_near(rows, width=5, least=75):
    """Components by comparing every two documents that share a shingle."""
    sets = {}
    for i, t in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    holders = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holders[g].append(i)
    for a, b in {(min(x, y), max(x, y)) for own in holders.values() for x in own for y in own if x != y}:
        both = len(sets[a] & sets[b])
        if 100 * both >= least * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i), find(i) == i) for i, s in sets.items()}


def near_rows():
    rng, rows = random.Random(5), []
    for k in range(40):
        rows.append((k, prose(k, rng.choice([1, 3, 4, 5, 20, 120]))))
    for group in range(6):
        base = prose(1000 + group, 150).split()
        for copy in range(12):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = prose(rng.randrange(10**6), 1)
            rows.append((1000 * (group + 1) + copy, " ".join(words).upper() if copy % 5 == 0 else "  ".join(words)))
    rows += [(20_000 + k, rows[k % 60][1]) for k in range(100)]
    return rows + [(90_000, None), (90_001, ""), (90_002, " \n\t"), (-5, prose(3, 20_000))]


def test_near_duplicates_equal_brute_force(make):
    rows = near_rows()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == plain_near(rows)


def test_near_duplicates_in_small_blocks(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 3)
    rows = near_rows()[40:112]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == plain_near(rows)


def test_near_duplicates_odd_rows(make, odd_rows):
    out = near_dedup.near_duplicates(make(odd_rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows)
    assert all(r["kept"] for r in out)
    assert next(r for r in out if r["doc_id"] is None)["component_id"] is None
    assert near_dedup.near_duplicates(make([])).count() == 0


def test_keep_one_keeps_columns(make):
    docs = make([(1, prose(1, 50), "en", "a"), (2, prose(1, 50), "en", "a"), (3, prose(2, 50), "en", "a")])
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_keep_one_drops_rows_not_ids(spark):
    x, lone, near = prose(1, 60), prose(2, 60), prose(1, 58)
    rows = [(1, x, 5), (4, x, 6), (4, lone, 7), (9, near, 8), (9, near, 8), (11, lone, 1), (12, prose(3, 40), 2), (12, prose(3, 40), 3), (None, x, 0), (None, x, 0), (20, "", 1), (20, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, gone long").withColumnsRenamed({}).selectExpr("doc_id", "text", "gone", "gone as kept", "gone as text_hash", "gone as _id")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in kept.collect())
    assert got == Counter([(1, x), (4, lone), (12, prose(3, 40)), (None, x), (None, x), (20, ""), (20, "")])


def test_strangers_are_held_against_all(make, monkeypatch):
    """A large group whose members are connected, and a few that reach it through another member than the hub."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    base = prose(50, 200).split()
    edit = lambda words, n, seed: [w if k % n else prose(1000 * seed + k, 1) for k, w in enumerate(words)]
    step = edit(base, 40, 1)
    rows = [(k, " ".join(base[: 200 - k % 4])) for k in range(30)] + [(100 + k, " ".join(edit(step, 45, k + 2))) for k in range(12)] + [(90, " ".join(step))]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == plain_near(rows)


def test_full_buckets_are_not_gathered(make, monkeypatch):
    monkeypatch.setattr(near_dedup, "MOST_FULL", 8)
    rows = near_rows()[40:]
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(make(rows)).collect()}
    assert got == plain_near(rows)


def test_estimates_are_near_the_truth():
    rng = np.random.default_rng(1)
    shared, total = 600, 800
    items = rng.integers(0, 2**63, total + 200, np.uint64)
    least = np.array([near_dedup.minima(np.unique(items[:total])), near_dedup.minima(np.unique(items[total - shared :]))])
    bits = near_dedup.packed(least)
    equal = sum((int(bits[0, w]) >> (4 * k)) & 15 == (int(bits[1, w]) >> (4 * k)) & 15 for w in range(bits.shape[1]) for k in range(16))
    estimate = (equal / 128 - 1 / 16) / (1 - 1 / 16)
    assert abs(estimate - shared / (total + 200)) < 0.2


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(100, 90), (90, 95)], "a long, b long")
    got = {r["node"]: r["root"] for r in near_dedup.components(links).collect()}
    assert got == {k: 0 for k in range(1, 51)} | {95: 90, 100: 90}


def test_hashes_are_stable():
    assert hashlib.sha256(near_dedup.shingles("One two three four five six").tobytes()).hexdigest() == hashlib.sha256(near_dedup.shingles("one\ttwo three  four five six").tobytes()).hexdigest()


def close_rows():
    """Groups of texts about the least similarity of each other, chains, boilerplate, and short sets with one shingle more or less."""
    rng, rows = random.Random(11), near_rows()
    for group in range(5):
        base = prose(3000 + group, 200).split()
        for copy in range(14):
            words = list(base)
            for k in rng.sample(range(200), rng.choice([1, 2, 3, 4, 5, 6])):  # one word costs four shingles on both sides: 4 are about the least
                words[k] = prose(rng.randrange(10**6), 1)
            rows.append((30_000 + 100 * group + copy, " ".join(words)))
        chain = list(base)
        for copy in range(12):
            for k in rng.sample(range(200), 3):
                chain[k] = prose(rng.randrange(10**6), 1)
            rows.append((40_000 + 100 * group + copy, " ".join(chain)))
    passage = prose(7777, 60)
    rows += [(50_000 + k, prose(8000 + k, 30) + " " + passage + " " + prose(9000 + k, 20)) for k in range(60)]  # share a passage, not near
    rows += [(60_000 + k, passage + " " + prose(9500 + k, 3)) for k in range(30)]
    for n in range(1, 24):
        words = prose(6000 + n, n + 4).split()
        rows += [(70_000 + 10 * n, " ".join(words[:n])), (70_001 + 10 * n, " ".join(words[: n + 1])), (70_002 + 10 * n, " ".join(words[1 : n + 1])), (70_003 + 10 * n, " ".join(words[: n + 2]))]
    return rows


def joined(docs):
    out = ngram_join.similar_documents(docs)
    assert out.columns == ["doc_id", "n_shingles", "component_id"]
    return Counter(map(tuple, out.collect()))


@pytest.mark.parametrize("block, full, shapes, few", [(1024, 20_000, 500_000, 64), (3, 20_000, 500_000, 2), (7, 8, 0, 5)])
def test_ngram_join_equals_brute_force(make, monkeypatch, block, full, shapes, few):
    monkeypatch.setattr(ngram_join, "FEW_ROWS", few)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "MOST_FULL", full)
    monkeypatch.setattr(near_dedup, "MOST_SHAPES", shapes)
    rows = close_rows()
    assert joined(make(rows)) == Counter(r[:3] for r in plain_near(rows, 4, 85))


def test_ngram_join_with_few_counters(make, monkeypatch):
    """All counters shared by many n-grams: the order says nothing, the result is the same."""
    monkeypatch.setattr(ngram_join, "LEAST_COUNTERS", 64)
    monkeypatch.setattr(ngram_join, "MOST_COUNTERS", 64)
    rows = close_rows()[-300:]
    assert joined(make(rows)) == Counter(r[:3] for r in plain_near(rows, 4, 85))


def test_ngram_join_odd_rows(make, odd_rows):
    got = joined(make(odd_rows))
    assert Counter(r[0] for r in got.elements()) == Counter(r[0] for r in odd_rows)
    assert all(r[2] == r[0] for r in got) and not joined(make([]))
    assert got[(4, 1, 4)] == 2 and got[(1, 0, 1)] == 1
    one_id = [(1, prose(1, 60)), (1, prose(2, 60)), (2, prose(2, 60)), (3, prose(1, 60)), (None, prose(1, 60)), (3, prose(1, 60))]
    assert joined(make(one_id)) == Counter([(1, 57, 1), (1, 57, 1), (2, 57, 1), (3, 57, 1), (None, 57, None), (3, 57, 1)])


def test_overlaps_are_products(monkeypatch):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60 if k % 2 else 4000, rng.integers(0, 90), np.uint64)) for k in range(50)]
    monkeypatch.setattr(ngram_join, "MOST_PRODUCTS", 37)
    for left, right in ((sets, sets[:20]), (sets[:1], sets), ([], sets), (sets, [])):
        x, y, n = ngram_join.overlaps(left, right)
        want = {(i, j): len(np.intersect1d(a, b)) for i, a in enumerate(left) for j, b in enumerate(right)}
        assert dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True)) == {k: v for k, v in want.items() if v}


def test_connected_nodes():
    rng = np.random.default_rng(4)
    for n, m in ((1, 0), (50, 20), (50, 60), (300, 299)):
        x, y = rng.integers(0, n, m), rng.integers(0, n, m)
        want = list(range(n))
        for _ in range(n):
            for a, b in zip(x, y, strict=True):
                want[a] = want[b] = min(want[a], want[b])
        assert ngram_join.connected(n, x, y).tolist() == want
    chain = np.arange(999)
    assert not ngram_join.connected(1000, chain, chain + 1).any()


def test_linked_sets_share_a_leading_ngram():
    rng, steps = np.random.default_rng(9), np.zeros(64, np.uint8)
    for _ in range(2000):
        n = int(rng.integers(1, 80))
        items = np.unique(rng.integers(0, 2**63, n + 20, np.uint64))
        a, b = items[: len(items) - int(rng.integers(0, 14))], items[int(rng.integers(0, 14)) :]
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and len(a) and not np.array_equal(a, b):
            assert len(np.intersect1d(ngram_join.leading(a, steps), ngram_join.leading(b, steps)))


def test_join_queries_equal_plain_python(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert Counter(map(tuple, ngram_join.query(spark, sf_dir).collect())) == Counter(r[:3] for r in plain_near(docs, 4, 85))
    assert set(map(tuple, near_dedup.query(spark, sf_dir).select("doc_id", "n_shingles", "component_id", "kept").collect())) == plain_near(docs)


def test_join_queries_equal_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    for module, columns in ((ngram_join, "doc_id, n_shingles, component_id"), (near_dedup, "doc_id, n_shingles, component_id, kept")):
        want = Counter(duckdb.sql(f"SELECT {columns} FROM ({module.ORACLE})").fetchall())
        assert Counter(map(tuple, module.query(spark, sf_dir).select(*columns.split(", ")).collect())) == want
