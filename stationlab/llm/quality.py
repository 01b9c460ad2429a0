"""Quality classifier: naive Bayes support vectors (n-gram indicators scaled by log-count ratios).

Features are the distinct one- and two-word runs of a text, the marks left of its words
without letters, and how often a word follows itself, hashed to 2^bits.  Class counts of every feature cover all training rows; r is the log ratio of the
smoothed class shares.  A text's vector is r at its features, scaled to length 1, so texts of any
length weigh alike.  A linear hinge-loss model is fitted by dual coordinate descent on a sample of
at most about ``sample_rows`` training rows, picked by id hash, and its margin is turned into a
probability on a fifth of that sample which the descent has not seen.

Defined results: null and empty texts have no features and score by the bias alone; without
training rows of both classes every score is the share of label 1 (0.5 without any); rows with null
labels are not learned from; repeated rows score alike; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, ship, table, written
from .features import mixed, word_hashes
from .toxicity import labelled, platt

BITS = 18
SAMPLE_ROWS = 12_000
C = 1.0
# a text whose share of two-word runs of one word is above these has a feature for each
REPEATS = (0.02, 0.1, 0.3)
ROUNDS = 12
_BI = np.uint64(0x9E3779B97F4A7C15)
_MARK = np.uint64(0xC2B2AE3D27D4EB4F)
_LETTERS = bytes(c for c in range(256) if chr(c).isalnum() or c >= 128)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    words = text.lower().encode("utf-8", "surrogatepass").split() if text else []
    if not words:
        return np.empty(0, dtype=np.int32)
    h = word_hashes(words)
    # what is left of the words without letters and digits: their marks
    marks = b" ".join(words).translate(None, _LETTERS).split(b" ")
    m = word_hashes([b"\0" + x for x in set(marks)])
    same = (h[1:] == h[:-1]).mean() if len(h) > 1 else 0.0
    again = np.array([i for i, share in enumerate(REPEATS) if same > share], dtype=np.uint64)
    both = np.concatenate((h, (h[:-1] * _BI) ^ h[1:], m ^ _MARK, again))
    return np.unique(mixed(both) >> np.uint64(64 - bits)).astype(np.int32)


class Model:
    def __init__(self, weights: np.ndarray, ratios: np.ndarray, bias: float, slope: float, shift: float, bits: int):
        self.weights, self.ratios, self.bias, self.slope, self.shift, self.bits = weights, ratios, bias, slope, shift, bits

    def margin(self, at: np.ndarray) -> float:
        r = self.ratios[at]
        norm = float(np.sqrt(r @ r))
        return float(self.weights[at] @ r / norm + self.bias) if norm > 0 else self.bias

    def score(self, text: str | None) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text, self.bits)) + self.shift, -500, 500))))


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, c: float = C, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Dual coordinate descent of the hinge loss; classes weigh alike.  ``y`` is -1 or 1."""
    w, bias = np.zeros(len(ratios)), 0.0
    values = []
    for at in rows:
        r = ratios[at]
        norm = np.sqrt(r @ r)
        values.append(r / norm if norm > 0 else r)
    square = np.array([v @ v for v in values]) + 1.0
    share = {s: max((y == s).mean(), 1e-9) for s in (-1, 1)}
    upper = np.array([c * 0.5 / share[s] for s in y])
    alpha = np.zeros(len(rows))
    random = np.random.RandomState(7)
    for _ in range(rounds):
        for i in random.permutation(len(rows)):
            at, v = rows[i], values[i]
            gradient = y[i] * (w[at] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), upper[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * v
                bias += step
                alpha[i] = new
    return w, bias


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", bits: int = BITS, sample_rows: int = SAMPLE_ROWS) -> Model:
    """The model over the training rows.  What comes to the driver is bounded: 2^bits counts, weights."""
    ship(docs.sparkSession)
    size = 1 << bits

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [features(t, bits) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.list_(pa.int32())), batch.column(2)], ["id", "at", "y"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, size), dtype=np.int64)
        for batch in batches:
            lists, y = batch.column(0), np.repeat(batch.column(1).to_numpy(), np.diff(batch.column(0).offsets.to_numpy()))
            at = lists.flatten().to_numpy()
            for k in (0, 1):
                n[k] += np.bincount(at[y == k], minlength=size)
        used = np.flatnonzero(n.sum(axis=0)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[0][used]), pa.array(n[1][used])], ["at", "n0", "n1"])

    rows = written(labelled(docs, labels, label).selectExpr("id", "text", "cast(y as int) y")
                   .mapInArrow(extract, "id long, at array<int>, y int"))
    n, n1 = rows.agg(F.count(F.lit(1)), F.sum("y")).first()
    if not n or not n1 or n1 == n:
        share = n1 / n if n else 0.5
        bias = float(np.log(max(share, 1e-6) / max(1 - share, 1e-6)))
        return Model(np.zeros(size), np.zeros(size), bias, 1.0, 0.0, bits)
    counts = rows.select("at", "y").mapInArrow(count, "at int, n0 long, n1 long").groupBy("at").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    got = counts.toPandas()
    table_ = np.ones((2, size))
    table_[0][got["at"]] += got["n0"]
    table_[1][got["at"]] += got["n1"]
    ratios = np.log(table_[1] / table_[1].sum()) - np.log(table_[0] / table_[0].sum())
    seen = np.zeros(size, dtype=bool)
    seen[got["at"]] = True
    ratios[~seen] = 0.0
    sample = rows
    if n > sample_rows:
        scale = 1 << 20
        sample = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(scale)) < int(scale * sample_rows / n))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, at, y = [], [], []
        for batch in batches:
            ids += batch.column(0).to_pylist()
            at += [np.asarray(x, dtype=np.int32) for x in batch.column(1).to_numpy(zero_copy_only=False)]
            y += batch.column(2).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(at[i])))
        at, y = [at[i] for i in order], np.array([2 * y[i] - 1 for i in order])
        apart = np.arange(len(at)) % 5 == 0
        learn = [i for i in range(len(at)) if not apart[i]]
        w, bias = descend([at[i] for i in learn], y[learn], shared.value)
        model = Model(w, shared.value, bias, 1.0, 0.0, bits)
        test = np.flatnonzero(apart)
        margins = np.array([model.margin(at[i]) for i in test])
        both = len(test) >= 20 and abs(y[test].mean()) < 1
        slope, shift = platt(margins, (y[test] > 0).astype(float)) if both else (1.0, 0.0)
        used = np.flatnonzero(w).astype(np.int32)
        where = np.concatenate((np.array([-3, -2, -1], dtype=np.int32), used))
        value = np.concatenate(([bias, slope, shift], w[used]))
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(value)], ["at", "w"])

    fitted = sample.repartition(1).mapInArrow(train, "at int, w double").toPandas()
    weights = np.zeros(size)
    tail = dict(zip(fitted["at"][:3], fitted["w"][:3])) if len(fitted) else {-3: 0.0, -2: 1.0, -1: 0.0}
    weights[fitted["at"][3:]] = fitted["w"][3:]
    return Model(weights, ratios, tail[-3], tail[-2], tail[-1], bits)


def scorer(spark: SparkSession, model: Model) -> Column:
    """A function of a text column: the probability of label 1."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in text], dtype="float64")

    return score


def op7_nb_support_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", scorer(spark, model)(F.col("text")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
