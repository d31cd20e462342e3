"""Whitening of embeddings by an exact covariance.

Components become integers x = floor(scale * c), and the covariance is that of the
distinct x vectors. It is worked out without rounding: each vector is centred as the
integers n * x - S (n vectors, sums S), these are cut into limbs of LIMB bits, and the
limbs of a block of vectors are multiplied by BLAS in doubles, in which all their sums are
exact. Products of limbs are put together as big integers, added up over blocks, tasks and
the whole table, and only the result is divided and decomposed.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import read_table, written

#: Components of the whitened vectors at most.
COMPONENTS = 4
#: Bits of a limb and vectors of a product: 2 * LIMB + log2(BLOCK) bits are exact in doubles.
LIMB, BLOCK = 20, 4096
#: Bits of the digits in which big integers travel; so many of them add up in 64 bits that no number of tasks can overflow.
DIGIT = 32
#: A component counts if its eigenvalue is above this share of the largest one, times the number of dimensions.
LEAST_SHARE = 2.0**-50

_PACKED = "vec_id long, dims int, x binary"


def packed_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, dims, x): integer vectors as bytes, in the narrowest of 16, 32 and 64 bits that holds all of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("embedding")
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries are NaN here
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(sizes)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
            good = np.flatnonzero((bad[ends] == bad[ends - sizes]) & lists.is_valid().to_numpy(zero_copy_only=False))
            with np.errstate(invalid="ignore", over="ignore"):
                real = np.floor(values * scale)
                x = np.where(real >= 2.0**63, 2**63 - 1, np.where(real <= -(2.0**63), -(2**63), np.where(np.isfinite(real) & (np.abs(real) < 2.0**63), real, 0).astype(np.int64)))
            narrow = [_narrow(x[ends[k] - sizes[k] : ends[k]]).tobytes() for k in good]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(good)), pa.array(sizes[good], pa.int32()), pa.array(narrow, pa.binary())], names=["vec_id", "dims", "x"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, _PACKED)


def _narrow(x: np.ndarray) -> np.ndarray:
    most = max(int(x.max()), -int(x.min()) - 1) if len(x) else 0
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def blocks_of(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, places, vectors as 64-bit integers) of a batch of packed vectors: vectors of one width, BLOCK of them at most."""
    dims, x = batch.column("dims").to_numpy(), batch.column("x").to_pylist()
    sizes = np.array([len(b) for b in x])
    for d, size in sorted(set(zip(dims.tolist(), sizes.tolist(), strict=True))):
        if d:
            own = np.flatnonzero((dims == d) & (sizes == size))
            for start in range(0, len(own), BLOCK):
                places = own[start : start + BLOCK]
                yield d, places, np.frombuffer(b"".join([x[k] for k in places]), f"<i{size // d}").reshape(len(places), d).astype(np.int64)


class Centre(NamedTuple):
    """The number n of fitted vectors and their sums."""

    n: int
    sums: list[int]

    def apart(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exactly: 64-bit integers, or Python's where those may not do."""
        most = max(int(x.max()), -int(x.min()))
        if self.n * most + max(map(abs, self.sums)) < 2**62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Matrices of doubles, each below 2^LIMB in size, with y = sum of limb k times 2^(LIMB * k)."""
    sign, rest, out = np.where(y < 0, -1, 1), abs(y), []
    while True:
        out.append((sign * (rest & (2**LIMB - 1))).astype(np.float64))
        rest = rest >> LIMB
        if not (rest > 0).any():
            return out


def gram(y: np.ndarray) -> np.ndarray:
    """The exact matrix y^T y, of Python's integers, for at most BLOCK vectors."""
    parts = limbs(y)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for a, left in enumerate(parts):
        for b in range(a, len(parts)):
            product = (left.T @ parts[b]).astype(np.int64).astype(object)
            out += (product if a == b else product + product.T) << (LIMB * (a + b))
    return out


def _digits(values: np.ndarray) -> list[list[int]]:
    """Signed digits of a vector of big integers, the lowest first: one list for each place."""
    sign, rest, out = [-1 if v < 0 else 1 for v in values], [abs(v) for v in values], []
    while not out or any(rest):
        out.append([s * (r & (2**DIGIT - 1)) for s, r in zip(sign, rest, strict=True)])
        rest = [r >> DIGIT for r in rest]
    return out


def exact_sums(table: DataFrame, width: int, work: Callable[[int, np.ndarray], np.ndarray]) -> dict[int, list[np.ndarray]]:
    """Sums over all packed vectors of ``work``, which gives a matrix of big integers for a block; the rows by number of dimensions.

    Tasks add up their blocks and send rows in digits; the digits are added up row by row.
    What reaches the driver is one matrix for each number of dimensions.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in blocks_of(batch):
                part = work(d, x)
                held[d] = held[d] + part if d in held else part
        for d, matrix in held.items():
            rows = [(d, k, place, digits) for k, row in enumerate(matrix) for place, digits in enumerate(_digits(row))]
            yield _as_rows(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for *key, digits in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, digits = tuple(key), np.array(digits, np.int64)
                held[key] = held[key] + digits if key in held else digits
        yield _as_rows([(*key, digits) for key, digits in held.items()])

    schema = "dims int, line int, place int, digits array<long>"
    found = table.mapInArrow(add, schema).repartition(width, "dims", "line").mapInArrow(merge, schema).collect()
    out: dict[int, list[np.ndarray]] = {}
    for r in sorted(found, key=lambda r: (r["dims"], r["line"])):
        rows = out.setdefault(r["dims"], [])
        if len(rows) == r["line"]:
            rows.append(np.zeros(len(r["digits"]), object))
        rows[r["line"]] = rows[r["line"]] + (np.array(r["digits"], object) << (DIGIT * r["place"]))
    return out


def _as_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)], names=["dims", "line", "place", "digits"])


class Fit(NamedTuple):
    """A covariance's centre, its first components (unit columns), their eigenvalues and shares of the trace."""

    centre: Centre
    components: np.ndarray
    eigenvalues: np.ndarray
    explained: np.ndarray

    def whitened(self, apart: np.ndarray) -> np.ndarray:
        return (apart / self.centre.n).astype(np.float64) @ self.components / np.sqrt(self.eigenvalues)


def decomposed(centre: Centre, products: list[np.ndarray], most: int) -> Fit:
    """``products`` are the sums of products of n * x - S, so n^3 times the covariance."""
    covariance = np.array([[v / centre.n**3 for v in row] for row in products], np.float64)  # rounded once, at the end
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values[-1], 0.0) * LEAST_SHARE * len(values)]
    trace = sum(int(products[k][k]) for k in range(len(products))) / centre.n**3
    return Fit(centre, vectors[:, order], values[order], values[order] / trace if trace else values[order])


def fitted(distinct: DataFrame, most: int = COMPONENTS) -> dict[int, Fit]:
    """The fit of each number of dimensions to ``distinct`` packed vectors."""
    width = max(1, distinct.agg(F.max("dims")).first()[0] or 0)
    sums = exact_sums(distinct, 1, lambda d, x: np.array([[len(x), *x.astype(object).sum(axis=0)]], object))
    centres = {d: Centre(int(line[0]), [int(v) for v in line[1:]]) for d, (line,) in sums.items()}
    held = distinct.sparkSession.sparkContext.broadcast(centres)  # one row for each number of dimensions
    products = exact_sums(distinct, min(width, 64), lambda d, x: gram(held.value[d].apart(x)))
    return {d: decomposed(centres[d], products[d], most) for d in centres}


def identity_errors(distinct: DataFrame, fits, most: int) -> dict[int, float]:
    """The largest entry of the whitened fit vectors' covariance minus the identity, for each number of dimensions."""
    names = [f"w{k}" for k in range(most)]

    def whiten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, _, x in blocks_of(batch):
                fit = fits.value[d]
                w = fit.whitened(fit.centre.apart(x))
                columns = [pa.array(w[:, k]) if k < w.shape[1] else pa.nulls(len(x), pa.float64()) for k in range(most)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), d, np.int32)), *columns], names=["dims", *names])

    pairs = [(a, b) for a in range(most) for b in range(a, most)]
    schema = ", ".join(["dims int", *(f"{c} double" for c in names)])
    found = distinct.mapInArrow(whiten, schema).groupBy("dims").agg(*[F.covar_pop(names[a], names[b]).alias(f"c{a}_{b}") for a, b in pairs]).collect()  # a row for each number of dimensions
    return {r["dims"]: max((abs(r[f"c{a}_{b}"] - (a == b)) for a, b in pairs if r[f"c{a}_{b}"] is not None), default=0.0) for r in found}


def whiten(vectors: DataFrame, scale: int = 256, most: int = COMPONENTS) -> DataFrame:
    """The whitened coordinates of all vectors: one row for each vector and component.

    ``vectors`` has vec_id and embedding. Entries c, as doubles, become floor(scale * c);
    those beyond 64 bits become the ends of that range. The covariance is over the distinct
    integer vectors, each once, with their number n as divisor. Returns vec_id, component
    (from 1, by falling eigenvalue, ``most`` at most), n, deviation (the sum of
    (n * x - S)^2 over dimensions, exact, null where 64 bits don't hold it), whitened,
    explained (the eigenvalue's share of the trace) and identity_error (the largest entry
    of the whitened fit vectors' covariance minus the identity).

    Vectors that are null, or hold a null or non-finite entry, and empty vectors have no
    rows. A vector of fewer dimensions has as many components; components without variance
    have no rows, so one distinct vector gives none. Vectors of different numbers of
    dimensions are fitted apart. Repeated rows and null or repeated ids give rows each. An
    empty table gives an empty result. Other columns are not read.
    """
    rows = written(packed_vectors(vectors, scale), "whiten-rows")
    spark = vectors.sparkSession
    distinct = written(rows.select("dims", "x").where("dims > 0").distinct(), "whiten-fit")
    fits = fitted(distinct, most)
    held = spark.sparkContext.broadcast(fits)  # dims^2 numbers for each number of dimensions
    errors = identity_errors(distinct, held, most)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, places, x in blocks_of(batch):
                fit = held.value[d]
                apart = fit.centre.apart(x)
                w, k = fit.whitened(apart), len(fit.eigenvalues)
                squares = [s if s < 2**63 else None for s in (sum(int(v) * int(v) for v in row) for row in apart)] if apart.dtype == object or int(np.abs(apart).max()) ** 2 * d >= 2**63 else (apart * apart).sum(axis=1)
                repeat = lambda values: pa.array(values, pa.int64()).take(pa.array(np.repeat(np.arange(len(x)), k)))
                tile = lambda values, t: pa.array(np.tile(values, len(x)), t)
                every = lambda value, t: pa.array(np.full(len(x) * k, value), t)
                columns = [batch.column("vec_id").take(pa.array(np.repeat(places, k))), tile(np.arange(1, k + 1), pa.int32()), every(fit.centre.n, pa.int64()), repeat(squares), pa.array(w.ravel()), tile(fit.explained, pa.float64()), every(errors[d], pa.float64())]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def query(spark, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
