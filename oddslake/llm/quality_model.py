"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a shrinkage covariance; a document's score is the logistic of the
difference of the two Mahalanobis log-densities, from Cholesky factors that are computed
once. Training needs only counts, sums and sums of products by class, which Spark adds up
over all labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddslake.llm.common import bound_batches, drop_written, read_table, remainder_of_id, slices, small_enough, written

#: Part of the pooled covariance, and of its diagonal, in each class covariance.
POOLED, DIAGONAL = 0.2, 0.05
#: Least standard deviation of a statistic.
FLOOR = 0.02
#: Log-density differences are held within this bound.
MOST_LOGIT = 30.0
THRESHOLD = 0.3
#: Labels that are broadcast at most (12 bytes each).
MOST_BROADCAST_LABELS = 1_000_000

FEATURES = ("log_words", "mean_word", "long_words", "short_words", "symbols", "bars", "marks", "stops", "upper", "doubled", "distinct", "repeats", "line_words", "non_ascii", "white")

_UPPER, _SYMBOL = np.zeros(256), np.zeros(256)
_UPPER[65:91] = 1
_SYMBOL[[ord(c) for c in "#*$%&<>^~"]] = 1


def statistics(text: str) -> list[float]:
    """The transformed statistics of one text, in the order of FEATURES; all finite, also for an empty one."""
    raw = text.encode()
    n = max(1, len(raw))
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    pairs = set(zip(words, words[1:], strict=False))
    lines = [x for x in text.split("\n") if x]
    return [
        np.log1p(len(words)),
        np.log1p(sizes.mean()),
        np.sqrt((sizes > 12).mean()),
        np.sqrt(((sizes > 0) & (sizes <= 3)).mean()),
        np.log1p(20 * (counts @ _SYMBOL) / w),
        np.log1p(20 * counts[124] / w),
        np.log1p(10 * (counts[33] + counts[63]) / w),
        np.log1p(5 * (counts[46] + counts[44]) / w),
        np.sqrt((counts @ _UPPER) / n),
        np.sqrt(sum(map(str.__eq__, words, words[1:])) / w),
        np.log((len(set(words)) + 1) / (w**0.8 + 1)),
        np.sqrt(max(0, len(words) - 1 - len(pairs)) / w),
        np.log1p(len(words) / max(1, len(lines))),
        np.sqrt(counts[128:].sum() / n),
        np.sqrt((counts[32] + counts[9:14].sum()) / n),
    ]


class Discriminant(NamedTuple):
    """A fitted model: for each class its mean, the inverse of its Cholesky factor, its log-determinant; and the prior logit."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.means):
            return np.full(len(x), 1 / (1 + np.exp(-self.prior)))
        density = [-0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) - d for m, w, d in zip(self.means, self.whiten, self.log_det, strict=True)]
        return 1 / (1 + np.exp(-np.clip(self.prior + density[1] - density[0], -MOST_LOGIT, MOST_LOGIT)))


def fit(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pooled: float = POOLED, diagonal: float = DIAGONAL) -> Discriminant:
    """The model from counts (2), sums (2, d) and sums of products (2, d, d) of classes 0 and 1.

    With an empty class there is no density to compare: every score is the share of class 1
    (0.5 without labels).
    """
    prior = float(np.log((counts[1] + 0.5) / (counts[0] + 0.5)))
    if counts.min() < 1:
        return Discriminant(np.empty((0, 0)), np.empty((0, 0, 0)), np.empty(0), prior)
    means = sums / counts[:, None]
    scatter = products - counts[:, None, None] * means[:, :, None] * means[:, None, :]
    within = scatter.sum(axis=0) / max(1, counts.sum() - 2)
    floor = np.diag(np.maximum(np.diag(within), 0) + FLOOR**2)
    whiten, log_det = [], []
    for n, s in zip(counts, scatter, strict=True):
        lean = pooled + (1 - pooled) * s.shape[1] / (n + s.shape[1])  # few rows lean on the pooled covariance
        own = (1 - lean) * s / max(1, n - 1) + lean * within
        factor = np.linalg.cholesky((1 - diagonal) * own + diagonal * floor + FLOOR**2 * np.eye(len(own)))
        whiten.append(np.linalg.inv(factor))
        log_det.append(np.log(np.diag(factor)).sum())
    return Discriminant(means, np.array(whiten), np.array(log_det), prior)


def _statistics_of(texts: pa.Array) -> np.ndarray:
    return np.array([statistics(t or "") for t in texts.to_pylist()], np.float32).reshape(-1, len(FEATURES))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of every whole text; a null text counts as an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _statistics_of(batch.column("text"))
                lists = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES), x.ravel())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES)).astype(np.float64)


def train(labelled: DataFrame) -> Discriminant:
    """Fit to ``labelled``: label (0 or 1) and x, or else text. Only sums by class reach the driver, their number fixed by FEATURES.

    Statistics of texts are taken and summed in one pass: a task that took them in one step
    of Python and summed them in another would hold two Python workers.
    """
    d = len(FEATURES)
    given = "x" if "x" in labelled.columns else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, 1 + d + d * d))
        for whole in batches:
            for batch in slices(whole, "text") if given == "text" else [whole]:
                x = _statistics_of(batch.column("text")).astype(np.float64) if given == "text" else _matrix(batch.column("x"))
                y = batch.column("label").to_numpy(zero_copy_only=False)
                for k in (0, 1):
                    own = x[y == k]
                    totals[k] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        for k in (0, 1):
            yield pa.RecordBatch.from_arrays([pa.array([k] * totals.shape[1], pa.int32()), pa.array(range(totals.shape[1]), pa.int32()), pa.array(totals[k])], names=["label", "at", "v"])

    sums = np.zeros((2, 1 + d + d * d))
    for r in labelled.select(given, "label").mapInArrow(run, "label int, at int, v double").groupBy("label", "at").agg(F.sum("v").alias("v")).collect():
        sums[r["label"], r["at"]] = r["v"]
    return fit(sums[:, 0], sums[:, 1 : 1 + d], sums[:, 1 + d :].reshape(2, d, d))


def score(table: DataFrame, model: Discriminant) -> DataFrame:
    """``table`` (doc_id, x) as (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(_matrix(batch.column("x"))))], names=["doc_id", "score"])

    return table.select("doc_id", "x").mapInArrow(run, f"doc_id {table.schema['doc_id'].dataType.simpleString()}, score double")


def learn(docs: DataFrame, labels: DataFrame, folds: int = 5) -> tuple[DataFrame, Discriminant]:
    """The statistics of all ``docs`` (a written table of doc_id and x), and the model of those labelled outside fold 0.

    ``docs`` has doc_id and text, ``labels`` doc_id and quality. Rows whose id's crc32 is a
    multiple of ``folds`` never train; nor do null ids or labels other than 0 and 1. A
    document labelled several times trains with each label.
    """
    table = written(features(docs), "quality-statistics")
    return table, train(table.join(_training_labels(labels, folds), "doc_id"))


def _training_labels(labels: DataFrame, folds: int) -> DataFrame:
    usable = F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder_of_id("doc_id", folds) != 0)
    return labels.where(usable).select("doc_id", F.col("quality").cast("int").alias("label"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, one row per row of ``docs``.

    Null and empty texts have statistics of 0 and a score like others. Ids decide only
    which labels train. Columns other than those named are not read. An empty table gives
    an empty result; without labels of both classes all scores are equal.
    """
    bound_batches(docs.sparkSession)
    table, model = learn(docs, labels, folds)
    return score(table, model).select("doc_id", (remainder_of_id("doc_id", folds) == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, folds: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` with a score of at least ``threshold``; all columns are kept, whatever their names.

    Null and empty texts are scored as empty ones, very long ones whole; repeated rows and
    ids fare alike, as only texts count. Without labels of both classes all rows have the
    same score. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    known = _training_labels(labels, folds)
    if small_enough(known, MOST_BROADCAST_LABELS):
        model = train(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    else:  # statistics of all documents are smaller to shuffle than texts
        table, model = learn(docs, labels, folds)
        drop_written(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                x = _statistics_of(batch.column("text"))
                yield batch.filter(pa.array(model.score(x.astype(np.float64)) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
