"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x): one weight vector for all grades,
ordered thresholds between them. x are hashed features of the text: the shares
of its byte trigrams, and a bucket of its repetition (distinct words to words)
at its length. The model gives the expected grade and the tail probability
P(grade >= least), by which rows are selected.

It is fit on at most ``PER_GRADE`` learnable rated rows of each grade (their
whole texts), picked by a hash of the id.

Null or empty text: the features of an empty text. Very long texts are read
whole. Grades may be any integers; null grades are not learned from. Without
ratings, or with one grade only, tail probabilities are 1 and all is kept.
Ties, repeated rows and empty tables need no rule: rows don't affect each
other. Columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, chunks, held_out, learnable
from .textscan import BUCKETS, buckets, join

#: Bound on the rated rows that the model is fit on, for each grade.
PER_GRADE = 2000
SHAPES = 11 * 24
SCALE = 30.0
LEAST_TAIL = 0.35
SCORES = "doc_id long, expected_grade double, tail_probability double"


@dataclass
class OrdinalModel:
    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray


def _scan(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets, the bounds of each text's, and its shape bucket."""
    data, starts = join(texts)
    space = (data == 32) | ((data >= 9) & (data <= 13)) | (data == 0)
    lo, hi = starts[:-1] - 1, np.maximum(starts[1:] - 2, starts[:-1] - 1)  # trigrams may begin at the zero before a text
    grams = buckets(data[:-2], data[1:-1], data[2:])
    first = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if len(first):
        mixed = (data + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        place = np.arange(len(data)) - np.maximum.accumulate(np.where(space, np.arange(len(data)), 0))
        mixed = np.where(space, np.uint64(0), mixed * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
        hashes = np.add.reduceat(mixed, first)
        doc = np.searchsorted(starts, first, side="right") - 1
        words = np.bincount(doc, minlength=len(texts))
        key = np.unique((doc.astype(np.uint64) << np.uint64(40)) | (hashes >> np.uint64(24)))
        distinct = np.bincount((key >> np.uint64(40)).astype(np.int64), minlength=len(texts))
    else:
        words = distinct = np.zeros(len(texts), np.int64)
    ratio = np.where(words > 0, 10 * distinct // np.maximum(words, 1), 0)
    size = np.minimum(np.log2(words + 1).astype(np.int64), 23)
    return grams, np.stack([lo, hi], 1), BUCKETS + size * 11 + ratio


def fit(docs: DataFrame, ratings: DataFrame, grade: str = "quality", per_grade: int = PER_GRADE, steps: int = 120) -> OrdinalModel:
    """``ratings``: doc_id and ``grade``. The features of the bounded sample are
    gathered; the fit runs on the driver over these few thousand sparse rows."""
    rated = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(grade).cast("int").alias("grade")).filter(learnable() & F.col("grade").isNotNull())
    sample = bounded_sample(rated, "doc_id", "grade", per_grade)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")  # bounded by per_grade

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, part in chunks(batches):
            grams, bounds, shape = _scan(part)
            at, share = [], []
            for (lo, hi), s in zip(bounds.tolist(), shape.tolist()):
                found, n = np.unique(grams[lo:hi], return_counts=True)
                at.append(np.append(found, s).astype("<i4").tobytes())
                share.append(np.append(n * (SCALE / max(1, hi - lo)), 1.0).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(at, pa.binary()), pa.array(share, pa.binary())], names=["grade", "at", "share"])

    rows = texts.select("grade", "text").mapInArrow(features, "grade int, at binary, share binary").collect()
    grades = sorted({r[0] for r in rows})
    if len(grades) < 2:
        return OrdinalModel(grades, np.zeros(BUCKETS + SHAPES, np.float32), np.zeros(0))
    rows.sort(key=lambda r: (r[0], r[1]))  # the order in which rows arrive has no effect
    at = [np.frombuffer(r[1], "<i4") for r in rows]
    return _fit_rows(np.searchsorted(grades, [r[0] for r in rows]), at, [np.frombuffer(r[2], "<f4") for r in rows], grades, steps)


def _fit_rows(y: np.ndarray, at: list[np.ndarray], share: list[np.ndarray], grades: list[int], steps: int, decay: float = 1e-3) -> OrdinalModel:
    """Adam on the class-balanced log-likelihood of the cumulative-link model."""
    n, k = len(y), len(grades)
    row = np.repeat(np.arange(n), [len(a) for a in at])
    col, val = np.concatenate(at), np.concatenate(share)
    balance = (n / k / np.bincount(y, minlength=k))[y]
    w = np.zeros(BUCKETS + SHAPES)
    # thresholds: the first, then logarithms of the steps, so that they stay ordered
    theta = np.concatenate([[0.0], np.zeros(k - 2)])
    m, v = np.zeros(len(w) + len(theta)), np.zeros(len(w) + len(theta))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for step in range(1, steps + 1):
        cut = np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))])
        z = np.bincount(row, val * w[col], minlength=n)
        upper = np.where(y < k - 1, sigmoid(cut[np.minimum(y, k - 2)] - z), 1.0)
        lower = np.where(y > 0, sigmoid(cut[np.maximum(y - 1, 0)] - z), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p
        dz = balance * (du - dl) / n  # of the negative log-likelihood
        gcut = np.bincount(np.maximum(y - 1, 0), balance * dl * (y > 0) / n, minlength=k - 1) - np.bincount(np.minimum(y, k - 2), balance * du * (y < k - 1) / n, minlength=k - 1)
        tail = np.cumsum(gcut[::-1])[::-1]
        g = np.concatenate([np.bincount(col, val * dz[row], minlength=len(w)) + decay * w / n, [tail[0]], tail[1:] * np.exp(theta[1:])])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = 0.2 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, theta = w - move[: len(w)], theta - move[len(w) :]
    return OrdinalModel(grades, w.astype(np.float32), np.concatenate([[theta[0]], theta[0] + np.cumsum(np.exp(theta[1:]))]))


def score_texts(texts: list[str], model: OrdinalModel, least: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade and P(grade >= least); least: the second grade if None."""
    if len(model.grades) < 2:
        return np.full(len(texts), float(model.grades[0]) if model.grades else np.nan), np.ones(len(texts))
    grams, bounds, shape = _scan(texts)
    each = model.weights[grams].astype(np.float64)
    total = np.array([each[lo:hi].sum() * (SCALE / max(1, hi - lo)) for lo, hi in bounds.tolist()])
    z = total + model.weights[shape]
    below = 1 / (1 + np.exp(-np.clip(model.thresholds[None, :] - z[:, None], -30, 30)))  # P(grade <= k)
    at_most = np.concatenate([below, np.ones((len(texts), 1))], 1)
    mass = np.diff(at_most, axis=1, prepend=0)
    least = model.grades[1] if least is None else least
    return mass @ np.array(model.grades, float), mass[:, np.array(model.grades) >= least].sum(1)


def score(docs: DataFrame, model: OrdinalModel, least: int | None = None) -> DataFrame:
    """doc_id, expected_grade, tail_probability of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a float for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            grade, tail = score_texts(texts, shared.value, least)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grade), pa.array(tail)], names=["doc_id", "expected_grade", "tail_probability"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCORES)


def select(docs: DataFrame, model: OrdinalModel, least_tail: float = LEAST_TAIL) -> DataFrame:
    """The rows, all columns as they are, whose tail probability is at least ``least_tail``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield batch.filter(pa.array(score_texts(texts, shared.value)[1] >= least_tail))

    return docs.mapInArrow(keep, docs.schema)


def digest(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    out = score(docs, fit(docs, ratings))
    return out.select("doc_id", held_out().alias("held_out"), "expected_grade", "tail_probability", (F.col("tail_probability") >= LEAST_TAIL).alias("kept"))
