import hashlib
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from oddslake.llm import language_id, quality_model, top_k
from pyspark.sql import functions as F


def test_statistics_are_finite():
    for text in ("", " ", "\n", "a", "# | !", "é" * 5000, "word " * 70_000):
        assert np.isfinite(quality_model.statistics(text)).all()


def test_discriminant_separates_and_survives_constants():
    rng = np.random.default_rng(0)
    x = np.stack([rng.normal(0, 1, (400, 3)), rng.normal(2, 3, (400, 3))])
    x[:, :, 2] = 1.0  # one statistic never varies
    model = quality_model.fit(np.array([400.0, 400.0]), x.sum(axis=1), np.einsum("knd,kne->kde", x, x))
    means, own = x.mean(axis=1), np.array([np.cov(c.T) for c in x])
    lean = quality_model.POOLED + (1 - quality_model.POOLED) * 3 / 403
    shrunk = (1 - lean) * own + lean * own.mean(axis=0)
    room = quality_model.DIAGONAL * np.diag(np.diag(own.mean(axis=0)) + quality_model.FLOOR**2) + quality_model.FLOOR**2 * np.eye(3)
    for c in x:  # the same scores from plain densities
        logs = []
        for k in (0, 1):
            cov = (1 - quality_model.DIAGONAL) * shrunk[k] + room
            logs.append([-0.5 * (v - means[k]) @ np.linalg.solve(cov, v - means[k]) - 0.5 * np.linalg.slogdet(cov)[1] for v in c])
        assert np.allclose(model.score(c), 1 / (1 + np.exp(np.clip(np.subtract(*logs), -30, 30))))
    assert model.score(x[1]).mean() > 0.7 > 0.3 > model.score(x[0]).mean()
    alone = quality_model.fit(np.array([0.0, 9.0]), np.zeros((2, 3)), np.zeros((2, 3, 3)))
    assert alone.score(x[0]).min() == alone.score(x[0]).max() > 0.5


def test_quality_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    out = quality_model.query(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in out]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_quality_odd_rows(make, odd_rows, spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (6, 1, 0), (None, 1, 0), (7, None, 0), (9, 0, 1)], "doc_id long, quality int, toxic int")
    out = quality_model.classify(make(odd_rows), labels).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r["score"] <= 1 for r in out)
    assert quality_model.classify(make([]), labels).count() == 0
    none = quality_model.classify(make(odd_rows), labels.limit(0)).select("score").distinct().collect()
    assert [r["score"] for r in none] == [0.5]


def test_kept_rows_are_those_predicted(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    kept = quality_model.keep_good(docs, labels)
    want = quality_model.classify(docs, labels).where("predicted = 1")
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in want.collect()}


@pytest.mark.parametrize("most_broadcast", [quality_model.MOST_BROADCAST_LABELS, 0])
def test_kept_rows_with_repeated_odd_and_unknown_labels(spark, sf_dir, monkeypatch, most_broadcast):
    monkeypatch.setattr(quality_model, "MOST_BROADCAST_LABELS", most_broadcast)
    docs, labels = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "labels"))
    docs = docs.withColumn("label", F.lit("own")).union(docs.limit(30).withColumn("label", F.lit(None)))
    given = labels.select("doc_id", "quality")
    labels = given.union(given.limit(40)).union(spark.createDataFrame([(None, 1), (10**9, 0), (1, None), (2, 7)], given.schema))
    kept = quality_model.keep_good(docs, labels)
    want = quality_model.classify(docs, labels).where("predicted = 1")
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in want.collect())


def test_quality_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    x = {r["doc_id"]: np.array(quality_model.statistics(r["text"] or ""), np.float32).astype(float) for r in docs}
    crc = lambda i: zlib.crc32(str(i).encode()) % 5
    rows = [np.array([x[i] for i, y in labels.items() if y == k and crc(i) and i in x]) for k in (0, 1)]
    d, n = len(quality_model.FEATURES), [len(r) for r in rows]
    within = sum((r - r.mean(axis=0)).T @ (r - r.mean(axis=0)) for r in rows) / (sum(n) - 2)
    dense = []
    for k in (0, 1):
        lean = quality_model.POOLED + (1 - quality_model.POOLED) * d / (n[k] + d)
        cov = (1 - lean) * np.cov(rows[k], rowvar=False) + lean * within
        cov = (1 - quality_model.DIAGONAL) * cov + quality_model.DIAGONAL * np.diag(np.diag(within) + quality_model.FLOOR**2) + quality_model.FLOOR**2 * np.eye(d)
        inverse, log_det = np.linalg.inv(cov), np.linalg.slogdet(cov)[1]
        dense.append({i: -0.5 * (v - rows[k].mean(axis=0)) @ inverse @ (v - rows[k].mean(axis=0)) - 0.5 * log_det for i, v in x.items()})
    prior = np.log((n[1] + 0.5) / (n[0] + 0.5))
    got = {r["doc_id"]: r for r in quality_model.query(spark, sf_dir).collect()}
    assert set(got) == set(x)
    for i in x:
        want = 1 / (1 + np.exp(-np.clip(prior + dense[1][i] - dense[0][i], -30, 30)))
        assert got[i]["score"] == pytest.approx(want, abs=1e-4) and got[i]["predicted"] == (got[i]["score"] >= 0.3)
        assert got[i]["held_out"] == (crc(i) == 0)


def plain_grams(text):
    """n-gram hashes in plain integers, as the module's docstring and constants define them."""
    fold = lambda c: c if not c.isascii() or c.isalpha() else " "
    chars, out, mask = [ord(fold(c)) for c in f" {text.lower()} "], Counter(), 2**32 - 1
    for n in range(1, language_id.LONGEST + 1):
        for k in range(len(chars) - n + 1):
            h = n
            for c in chars[k : k + n]:
                h = (h + c) * 0x01000193 & mask
                h ^= h >> 15
            out[(h * 0x85EBCA6B & mask) >> (32 - language_id.BITS)] += 1
    return out


def test_language_query_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 4 for r in docs}
    grams = {r["doc_id"]: plain_grams(r["text"] or "") for r in docs}
    teach = [r for r in docs if fold[r["doc_id"]] != 2 and r["lang"] is not None]
    languages = sorted({r["lang"] for r in teach})
    seen = Counter(g for r in teach for g in grams[r["doc_id"]])
    idf = lambda g: np.log((1 + len(teach)) / (1 + seen[g])) + 1
    key = lambda r: hashlib.md5(f"{r['doc_id']}:{hashed[r['doc_id']]}".encode()).hexdigest()
    hashed = {r["doc_id"]: r["h"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    rows = []
    for r in sorted(teach, key=key):
        g = grams[r["doc_id"]]
        rows.append(({a: language_id.SCALE * c / sum(g.values()) * idf(a) for a, c in g.items()} | {-1: 1.0}, languages.index(r["lang"])))
    z, n = (defaultdict(lambda: np.zeros(len(languages))) for _ in range(2))

    def weight(a):
        step = (language_id.BETA + np.sqrt(n[a])) / language_id.ALPHA + language_id.L2
        return np.where(np.abs(z[a]) <= language_id.L1, 0.0, -(z[a] - np.sign(z[a]) * language_id.L1) / step)

    for _ in range(language_id.PASSES):
        for x, y in (row for k, row in enumerate(rows) if k % 5):
            w = {a: weight(a) for a in x}
            error = language_id.softmax(sum(v * w[a] for a, v in x.items()))
            error[y] -= 1
            for a, v in x.items():
                g = v * error
                z[a] += g - (np.sqrt(n[a] + g * g) - np.sqrt(n[a])) / language_id.ALPHA * w[a]
                n[a] += g * g
    got = {r["doc_id"]: r for r in language_id.query(spark, sf_dir).collect()}
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    for r in docs:
        i, g = r["doc_id"], grams[r["doc_id"]]
        assert got[i]["held_out"] == (fold[i] == 2)
        if not any(map(str.isalpha, r["text"] or "")):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        p = language_id.softmax((sum(language_id.SCALE * c / sum(g.values()) * idf(a) * weight(a) for a, c in g.items()) + weight(-1)) / model.temperature)
        assert got[i]["lang_pred"] == languages[int(p.argmax())] and got[i]["score"] == pytest.approx(p.max(), abs=2e-3)


def test_language_on_held_out_documents(spark, sf_dir):
    sf = sf_dir.replace("0.001", "0.01")
    out = language_id.query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r["lang_pred"] == r["lang"] for r in out]) >= 0.98
    assert all(0 <= r["score"] <= 1 for r in out)


def test_language_odd_rows(make, odd_rows):
    out = language_id.identify(make(odd_rows)).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in odd_rows)
    by_id = {r["doc_id"]: r for r in out}
    assert by_id[1]["lang_pred"] == by_id[2]["lang_pred"] == by_id[3]["lang_pred"] == "und"
    assert by_id[6]["lang_pred"] != "und"
    assert language_id.identify(make([])).count() == 0
    untaught = language_id.identify(make([(k, "some text", None, None) for k in range(9)]))
    assert [r["lang_pred"] for r in untaught.select("lang_pred").distinct().collect()] == ["und"]


def test_grams_do_not_depend_on_the_window(monkeypatch):
    text = "Some words, é and Ü " * 50
    whole = np.sort(np.concatenate(list(language_id.grams(text))))
    monkeypatch.setattr(language_id, "WINDOW", 64)
    assert (np.sort(np.concatenate(list(language_id.grams(text)))) == whole).all()


def test_weights_are_sparse(spark, sf_dir):
    model = language_id.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert (model.weights == 0).mean() > 0.5
    assert len(model.languages) == 4


def brute_top_k(rows, k, scale=64):
    usable = [(n, i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for own, q, a in usable:
        if q % 20 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for n, i, b in usable if n != own and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return sorted(out)


def vectors(seed, n, dims=16):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dims)) * rng.lognormal(0, 0.7, (n, 1)) / 4
    v[n // 3 : n // 2] = v[0]  # many equal vectors
    return v.astype(np.float32)


@pytest.fixture
def table(spark):
    return lambda rows: spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<float>, label int, score int")


def test_top_k_equals_brute_force(table, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 64)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 8)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(3, 900))]
    rows += [(2000, None), (2020, [1.0, None] * 8), (2040, [float("nan")] * 16), (2060, [float("inf")] * 16), (2080, [0.0] * 16), (None, [1.0] * 16), (2100, [1.0, 2.0]), (2101, [2.0, 1.0]), (-20, [0.5] * 16)]
    got = sorted(map(tuple, top_k.search(table(rows), F.col("vec_id") % 20 == 0, k=7).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 7)


def test_top_k_with_repeated_ids(table, monkeypatch):
    monkeypatch.setattr(top_k, "BLOCK", 16)
    monkeypatch.setattr(top_k, "QUERY_BLOCK", 4)
    v = vectors(4, 120, 8)
    rows = [(k // 2, v[k].tolist()) for k in range(100)] + [(20, v[0].tolist())] * 3 + [(40, v[101].tolist()), (40, v[101].tolist())]
    got = sorted(map(tuple, top_k.search(table(rows), F.col("vec_id") % 20 == 0, k=6).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 6)


def test_query_blocks_go_to_regions_and_are_never_broadcast(table, monkeypatch):
    for name, value in (("BLOCK", 32), ("QUERY_BLOCK", 4), ("REGIONS", 3)):
        monkeypatch.setattr(top_k, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(vectors(5, 700))] + [(1000 + k, v.tolist()) for k, v in enumerate(vectors(6, 300, 8) * 1e4)]
    found = top_k.search(table(rows), F.col("vec_id") % 20 == 0, k=7)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.select("query_id", "rank", "vec_id", "score").collect())) == brute_top_k(rows, 7)


@pytest.mark.parametrize("most, size", [(127, 1), (128, 2), (2**15, 4), (2**31, 8)])
def test_vectors_are_packed_in_the_narrowest_integers(most, size):
    v = np.array([[most, -1], [0, 1]], np.int64)
    assert top_k.narrow(v).itemsize == size and (top_k.narrow(v) == v).all()


def test_top_k_of_large_components(table):
    rows = [(k, [float(2**24 + 20 * k), -3.0]) for k in range(60)]  # products are beyond what doubles hold exactly
    got = sorted(map(tuple, top_k.search(table(rows), F.col("vec_id") % 20 == 0, k=5).select("query_id", "rank", "vec_id", "score").collect()))
    assert got == brute_top_k(rows, 5)


def test_blocks_of_a_grid():
    cells = [{"dims": 2, "cell": c, "n": n, "most": float(c)} for c, n in ((9, 3), (8, 4), (7, 5), (5, 25), (4, 1), (2, 9))]
    runs, places = top_k.runs_of(cells, 10)
    assert [(r.start, r.parts, r.most) for r in runs] == [(0, 1, 9.0), (1, 1, 7.0), (2, 3, 5.0), (5, 1, 4.0)]
    assert [p[1:] for p in places] == [(9, 0, 1), (8, 0, 1), (7, 1, 1), (5, 2, 3), (4, 5, 1), (2, 5, 1)]


def test_top_k_small_and_empty(table):
    rows = [(20, [1.0, 0.0]), (1, [1.0, 1.0])]
    assert [tuple(r) for r in top_k.search(table(rows), F.col("vec_id") % 20 == 0).collect()] == [(20, 1, 1, 4096)]
    assert top_k.search(table([]), F.col("vec_id") % 20 == 0).count() == 0


def test_pruning_never_drops_a_winner():
    rng = np.random.default_rng(7)
    v = rng.integers(-64, 64, (500, 24))
    norms = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms)
    v, norms = v[order], norms[order]
    pruned = 0
    for q in v[:60]:
        scores = v @ q
        for least in np.quantile(scores, [0.1, 0.6, 0.95, 0.99, 1.0]):
            at = top_k.candidates(q, float(np.sqrt((q.astype(float) ** 2).sum())), float(least), v, norms)
            found = set(range(len(v))) if at is None else set(at.tolist())
            assert set(np.flatnonzero(scores >= least).tolist()) <= found
            pruned += len(v) - len(found)
    assert pruned > 0


def test_top_k_query_equals_sql(spark, sf_dir):
    duckdb.sql(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = top_k.query(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(top_k.ORACLE).fetchall())


def test_language_sample_is_bounded_with_repeated_ids(make):
    rows = [(7, f"{lang} {k} words", lang, "a") for lang in ("en", "fr") for k in range(90)]
    rows += [(None, "one text for all", "de", "a")] * 70 + [(None, f"without an id {k}", "it", "a") for k in range(5)]
    found = Counter(lang for *_, lang in language_id.sample(make(rows), 40, 1000))
    assert found == {"en": 40, "fr": 40, "de": 40, "it": 5}
    assert len(language_id.sample(make(rows), 40, 30)) == 30
