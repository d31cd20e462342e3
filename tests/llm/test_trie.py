import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from oddslake.llm import prefix_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """All nodes, by prefixes in full. ``rows`` has conv_id, turn, role, text."""
    turns = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            turns[c].append((n is not None, n or 0, key, role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in turns.items()}
    members, ends = defaultdict(set), defaultdict(set)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        leader = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        full = tuple(own.get(leader, [])[:h] + own[c][h:])
        for d in range(len(full) + 1):
            members[full[:d]].add(c)
        ends[full].add(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[x] for x in children[p]) if children[p] else 1
        saved[p] = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(saved[x] for x in children[p])
        digest = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves[p], saved[p], digest))
    return Counter(out)


def rows_of(spark, rows):
    """With columns whose names clash with what the operator adds."""
    full = [(*r, 1, b"x", 2.0, "y") for r in rows]
    return spark.createDataFrame(full, "conv_id long, turn long, role string, text string, depth int, node binary, n_convs double, ends string")


def trie_of(spark, rows):
    out = prefix_trie.trie(rows_of(spark, rows))
    assert out.columns == COLUMNS
    return Counter(map(tuple, out.collect()))


def some_rows():
    rng, rows = random.Random(7), []
    for c in range(-12, 60):
        for t in range(rng.choice([0, 1, 3, 8, 14])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"text {t} é" if rng.random() < 0.8 else rng.choice(["", None, "other", "x" * 5000])))
    rows += [(70, None, "user", "first"), (70, 1, "user", "second"), (70, None, "system", "before"), (71, 3, None, None), (71, 3, None, None), (71, 3, "", ""), (None, 0, "user", "nobody's")]
    rows += [(100 + 5 * k, t, "user", "alike") for k in range(30) for t in range(12)]  # copies of a whole conversation
    rng.shuffle(rows)
    return rows


def test_trie_equals_plain_python(spark):
    rows = some_rows()
    assert trie_of(spark, rows) == plain_trie(rows)


@pytest.mark.parametrize("stride", [2, 3])
def test_long_conversations_in_short_blocks(spark, monkeypatch, stride):
    """Chains and sums over three levels of blocks or more, chunks of few ids, every node with two children a hub or none."""
    monkeypatch.setattr(prefix_trie, "STRIDE", stride)
    monkeypatch.setattr(prefix_trie, "ENDS_A_CHUNK", 2)
    monkeypatch.setattr(prefix_trie, "MOST_HUBS", 60)
    rows = some_rows() + [(c, t, "user", f"long {t}" if t < 25 + c % 7 else f"own {c}") for c in (200, 201, 205, 210, 215) for t in range(40)]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_one_conversation_holds_most_rows(spark):
    rows = [(1000, t, "user", f"turn {t}") for t in range(4500)] + [(1005, t, "user", f"turn {t}") for t in range(4400)] + [(3, 0, "user", "turn 0")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_families_without_their_first_and_repeated_rows(spark):
    rows = [(11, t, "user", f"t{t}") for t in range(4)] * 3 + [(13, 0, "user", "only"), (2**62 + 1, 0, "user", "far")]
    assert trie_of(spark, rows) == plain_trie(rows)


def test_empty_tables(spark):
    assert not trie_of(spark, []) and not trie_of(spark, [(None, 1, "user", "x")])


def test_trie_query_equals_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = Counter(duckdb.sql(f"SELECT {', '.join(COLUMNS)} FROM ({prefix_trie.ORACLE})").fetchall())
    assert Counter(map(tuple, prefix_trie.query(spark, sf_dir).select(*COLUMNS).collect())) == want
