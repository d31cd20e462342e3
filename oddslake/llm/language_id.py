"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

N-grams of one to three characters are hashed to a fixed number of features. Inverse
document frequencies count all training documents. Weights are learnt by follow-the-
regularised-leader with an elastic-net penalty, which leaves most of them at zero, from a
bounded sample of documents; a temperature fitted to a part of the sample kept aside
calibrates the probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddslake.llm.common import bound_batches, read_table, remainder_of_id, slices, small_enough, text_or_empty, written

#: Hash bits of a feature, and the longest n-gram.
BITS, LONGEST = 15, 3
#: The sample that the weights are learnt from: documents of a language, and of all.
SAMPLE_A_LANGUAGE, SAMPLE = 400, 2000
#: Languages whose bounds are broadcast at most (40 bytes each).
MOST_BROADCAST_LANGUAGES = 100_000
#: Follow-the-regularised-leader: step, its start, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 0.5, 1.0, 0.02, 0.01, 4
#: Features of a text sum to about SCALE times their mean inverse frequency.
SCALE = 50.0
#: Label of texts without letters.
UNKNOWN = "und"
#: Characters hashed at a time.
WINDOW = 1 << 18

_SIZE = 1 << BITS
_FOLD = np.arange(128, dtype=np.uint32)
_FOLD[[c for c in range(128) if not chr(c).isalpha()]] = 32
_PRIME = (np.uint32(1), np.uint32(0x01000193), np.uint32(0x85EBCA6B))


def grams(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of the n-grams of a text, a window of characters at a time.

    Letters are lower-cased; other ASCII characters count as blanks; a blank stands at both ends.
    """
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), WINDOW):
        c = codes[start : start + WINDOW + LONGEST - 1]
        c = np.where(c < 128, _FOLD[np.minimum(c, 127)], c)
        parts = []
        for n in range(1, LONGEST + 1):
            h = np.full(max(0, min(WINDOW, len(codes) - start - n + 1)), n, np.uint32)
            for k in range(n):
                h = (h + c[k : k + len(h)]) * _PRIME[1]
                h ^= h >> np.uint32(15)
            parts.append((h * _PRIME[2]) >> np.uint32(32 - BITS))
        yield np.concatenate(parts)


def counts(text: str) -> np.ndarray:
    out = np.zeros(_SIZE, np.int64)
    for idx in grams(text):
        out += np.bincount(idx, minlength=_SIZE)
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Model(NamedTuple):
    """Fitted weights: one row a feature, one column a language, with inverse frequencies multiplied in."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        if not has_letter(text) or not self.languages:
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for idx in grams(text):
            total += self.weights[idx].sum(axis=0, dtype=np.float64)
            n += len(idx)
        p = softmax((SCALE * total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best])


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(samples: list[tuple[np.ndarray, np.ndarray, int]], languages: list[str], idf: np.ndarray) -> Model:
    """Learn from (features, shares, language number) in the order given; every fifth sets the temperature."""
    n_languages = len(languages)
    if not n_languages:
        return Model([], np.zeros((_SIZE, 0), np.float32), np.zeros(0), 1.0)
    z, n = np.zeros((_SIZE + 1, n_languages)), np.zeros((_SIZE + 1, n_languages))

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        step = (BETA + np.sqrt(n[at])) / ALPHA + L2
        return np.where(np.abs(own) <= L1, 0.0, -(own - np.sign(own) * L1) / step)

    ready = [(np.append(at, _SIZE), np.append(SCALE * share * idf[at], 1.0), y) for at, share, y in samples]  # the last is the bias
    learn, aside = [x for k, x in enumerate(ready) if k % 5], ready[::5]
    for _ in range(PASSES):
        for at, x, y in learn:
            w = weights(at)
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(np.arange(_SIZE + 1))
    logits = np.array([x @ w[at] for at, x, _ in aside]).reshape(-1, n_languages)
    truth = np.array([y for *_, y in aside], int)

    # targets leave room for one error more than was seen, as a sample without errors proves no certainty
    target = np.full((len(truth), n_languages), 1 / ((len(truth) + 2) * max(1, n_languages - 1)))
    target[np.arange(len(truth)), truth] = (len(truth) + 1) / (len(truth) + 2)

    def loss(t: float) -> float:
        return -(target * np.log(np.maximum(softmax(logits / t), 1e-300))).sum(axis=1).mean()

    temperature = min(np.geomspace(0.05, 20, 121), key=loss) if len(truth) else 1.0
    return Model(languages, (w[:-1] * idf[:, None]).astype(np.float32), w[-1], float(temperature))


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """For each feature, the documents among all ``docs`` that have it; the last entry is the number of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_SIZE + 1, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for text in batch.column("text").to_pylist():
                    seen = np.zeros(_SIZE, bool)
                    for idx in grams(text or ""):
                        seen[idx] = True
                    total[:-1] += seen
                    total[-1] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["at", "n"])

    out = np.zeros(_SIZE + 1, np.int64)
    for r in docs.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():  # at most 2^BITS + 1 rows
        out[r["at"]] = r["n"]
    return out


def sample(docs: DataFrame, a_language: int = SAMPLE_A_LANGUAGE, most: int = SAMPLE) -> list[tuple[np.ndarray, np.ndarray, str]]:
    """Features and shares of a sample of ``docs`` (doc_id, text, lang), in hash order: at most ``a_language`` of each language and ``most`` of all.

    Rows are picked by a hash of id and text, so null and repeated ids have no part in how
    many there are; equal rows count each, but are read once. A bound on the hash, from the
    number of hashes of each language, leaves few more than ``a_language`` to be ranked.
    """
    order = F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.xxhash64(text_or_empty()).cast("string")).cast("binary"))
    keyed = docs.withColumn("h", order)
    distinct = written(keyed.groupBy("lang", "h").agg(F.count("*").alias("n")), "language-hashes")
    room = a_language + 8 * int(a_language**0.5) + 16  # eight standard deviations more than are wanted
    bound = F.lpad(F.hex(F.floor(F.lit(float(1 << 52)) * F.least(F.lit(1.0), room / F.col("hashes")))), 14, "0")  # as are the first 13 of 32 digits, and one before
    bounds = distinct.groupBy("lang").agg(F.count("*").alias("hashes")).select("lang", F.lower(bound).alias("bound"))
    bounds = written(bounds, "language-bounds")
    few = distinct.join(F.broadcast(bounds) if small_enough(bounds, MOST_BROADCAST_LANGUAGES) else bounds, "lang").where(F.concat(F.lit("0"), F.substring("h", 1, 13)) < F.col("bound")).drop("bound")
    by_hash = Window.partitionBy("lang").orderBy("h")
    first = few.withColumn("rank", F.row_number().over(by_hash)).where(F.col("rank") <= a_language)
    upto = F.least(F.sum("n").over(by_hash), F.lit(a_language))
    before = F.sum("n").over(by_hash) - F.col("n")
    ranked = first.select("lang", "h", before.alias("before"), upto.alias("upto")).where("before < upto")
    each = ranked.select("lang", "h", F.explode(F.sequence(F.col("before"), F.col("upto") - 1)).alias("rank"))  # at most ``a_language`` a language
    chosen = {(r["lang"], r["h"]): r["n"] for r in each.orderBy("rank", "h", "lang").limit(most).groupBy("lang", "h").agg(F.count("*").alias("n")).collect()}
    picked = docs.sparkSession.createDataFrame(list(chosen), "lang string, h string")  # at most ``most`` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = []
                for text in batch.column("text").to_pylist():
                    c = counts(text or "")
                    at = np.flatnonzero(c)
                    rows.append((at.astype(np.int32).tobytes(), (c[at] / c.sum()).astype(np.float32).tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("lang"), *(pa.array([r[k] for r in rows], pa.binary()) for k in (0, 1))], names=["h", "lang", "at", "share"])

    texts = keyed.join(F.broadcast(picked), ["lang", "h"]).select("h", "lang", "text").dropDuplicates(["h", "lang"])
    rows = texts.mapInArrow(run, "h string, lang string, at binary, share binary").collect()
    rows.sort(key=lambda r: (r["h"], r["lang"]))
    found = [(np.frombuffer(r["at"], np.int32), np.frombuffer(r["share"], np.float32), r["lang"]) for r in rows]
    return [x for r, x in zip(rows, found, strict=True) for _ in range(chosen[r["lang"], r["h"]])]


def train(docs: DataFrame, a_language: int = SAMPLE_A_LANGUAGE, most: int = SAMPLE) -> Model:
    """A model from ``docs`` (doc_id, text, lang); rows without lang teach nothing.

    Rows without an id teach like others. Frequencies are those of all rows; ``a_language`` and ``most`` bound the sample for the weights.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    found = sample(docs, a_language, most)
    languages = sorted({lang for *_, lang in found})
    frequency = document_frequencies(docs)
    idf = np.log((1 + frequency[-1]) / (1 + frequency[:-1])) + 1
    number = {x: k for k, x in enumerate(languages)}
    return fit([(at, share, number[lang]) for at, share, lang in found], languages, idf)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score, the calibrated probability, of every whole text; texts without letters are ``und``, 0."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [held.value.predict(t) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def identify(docs: DataFrame, folds: int = 4, held_fold: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document, one row per row of ``docs``.

    ``docs`` has doc_id, text and lang. Rows whose id's crc32 leaves ``held_fold`` modulo
    ``folds`` are held out of training; ids and lang have no part in a prediction. Null
    texts and texts without a letter are ``und`` with score 0, as are all if no row has a
    lang. Repeated rows train and are predicted each. An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    rest = remainder_of_id("doc_id", folds)
    model = train(docs.where(rest != held_fold))
    return predict(docs, model).select("doc_id", (rest == held_fold).alias("held_out"), "lang_pred", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read_table(spark, sf_dir, "documents"))
