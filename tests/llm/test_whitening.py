import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from oddslake.llm import whitening

COLUMNS = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def plain_fit(vectors, scale=256):
    """x of each usable vector, and n, sums, exact covariance and its components over the distinct ones."""
    usable = {}
    for k, v in enumerate(vectors):
        if v and all(c is not None and np.isfinite(c) for c in v):
            usable[k] = tuple(int(np.floor(scale * float(c))) for c in v)
    fit = sorted(set(usable.values()))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    y = [[n * x[j] - sums[j] for j in range(d)] for x in fit]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(d)] for i in range(d)]
    values, vecs = np.linalg.eigh(np.array([[float(c) for c in row] for row in cov]))
    return usable, n, sums, cov, values[::-1], vecs[:, ::-1]


def check(rows, vectors, most=4):
    """``rows`` of the operator against plain Python; ids are places in ``vectors``."""
    usable, n, sums, cov, values, vecs = plain_fit(vectors)
    d = len(sums)
    live = [k for k in range(min(most, d)) if values[k] > 1e-12 * max(values[0], 1e-300)]
    assert Counter((r["vec_id"], r["component"]) for r in rows) == Counter((i, k + 1) for i in usable for k in live)
    trace = float(sum(cov[j][j] for j in range(d)))
    signs = {}
    for r in rows:
        x, k = usable[r["vec_id"]], r["component"] - 1
        apart = [n * x[j] - sums[j] for j in range(d)]
        deviation = sum(a * a for a in apart)
        assert r["n"] == n and r["deviation"] == (deviation if deviation < 2**63 else None)
        want = sum(float(Fraction(a, n)) * vecs[j, k] for j, a in enumerate(apart)) / np.sqrt(values[k])
        sign = signs.setdefault(k, 1 if r["whitened"] * want >= 0 else -1) if abs(want) > 1e-3 else signs.get(k, 1)
        assert abs(sign * r["whitened"] - want) < 1e-6 + (1 if abs(want) <= 1e-3 else 0) * 2e-3
        assert abs(r["explained"] / (values[k] / trace) - 1) < 1e-6 and r["identity_error"] < 1e-4


def collected(spark, vectors, kind="float"):
    """Vectors in a table with clashing columns."""
    rows = [(k, v and [None if c is None else float(c) for c in v], 1, 2.0, b"z") for k, v in enumerate(vectors)]
    out = whitening.whiten(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, n int, whitened double, x binary"))
    assert out.columns == COLUMNS
    return out.collect()


def test_whitening_equals_plain_python(spark):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(300, 6)) * [3, 2, 1.5, 1, 0.4, 0.2]).astype(np.float32).astype(float).tolist()
    vectors += [vectors[0]] * 50 + [None, [1.0, None, 0, 0, 0, 0], [float("nan")] * 6, [float("inf"), 0, 0, 0, 0, 0], [-0.0] * 6, [1e-9, -1e-9, 0, 0, 0, 0]]
    check(collected(spark, vectors), vectors)


def test_few_dimensions_and_components_without_variance(spark):
    vectors = [[float(k % 5), 2.0] for k in range(20)]
    rows = collected(spark, vectors)
    check(rows, vectors)
    assert {r["component"] for r in rows} == {1}
    assert collected(spark, [[1.0, 2.0]] * 3) == [] and collected(spark, []) == [] and collected(spark, [[], None]) == []


def test_dimensions_are_fitted_apart(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(40, 3)).tolist(), rng.normal(size=(30, 5)).tolist()
    rows = collected(spark, a + b, "double")
    check([r for r in rows if r["vec_id"] < 40], a)
    check([r for r in rows if r["vec_id"] >= 40], [None] * 40 + b)


def test_large_entries_stay_exact(spark):
    rng = random.Random(5)
    vectors = [[rng.uniform(-1, 1) * 2.0**e for e in (50, 51, 49, 47)] for _ in range(60)]
    check(collected(spark, vectors, "double"), vectors)
    rows = collected(spark, [[1e300, 0.0], [-1e300, 1.0], [5.0, 2.0]], "double")  # stop at the ends of 64 bits
    assert len(rows) > 0 and all(r["deviation"] is None or r["deviation"] >= 0 for r in rows)


@pytest.mark.parametrize("bits", [3, 19, 30, 61, 90])
def test_products_of_limbs_are_exact(bits):
    rng = random.Random(bits)
    y = np.array([[rng.randint(-(2**bits), 2**bits) for _ in range(5)] for _ in range(200)], np.int64 if bits < 62 else object)
    assert (whitening.gram(y) == np.array(y, object).T @ np.array(y, object)).all()
    full = np.full((whitening.BLOCK, 2), 2**40 - 1, np.int64)  # the largest limbs in a whole block
    assert (whitening.gram(full) == whitening.BLOCK * (2**40 - 1) ** 2).all()


def test_whitening_query(spark, sf_dir):
    vectors = {r["vec_id"]: r["embedding"] for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    got = whitening.query(spark, sf_dir).collect()
    order = sorted(vectors)
    assert order == list(range(len(order)))
    check(got, [vectors[k] for k in order])
