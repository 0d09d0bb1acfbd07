"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log-count ratio of the classes; a linear model with hinge
loss is then fitted on them by dual coordinate descent and turned into a probability by a logistic
curve. The fit, ratios included, uses at most ``per_class`` labelled rows of each class (a documented
bound; rows are chosen by a seeded hash). Scoring covers every row and whole texts.

The model is two vectors of 2**18 columns, the only data sent to the tasks.

Null and empty texts have no features and score by the bias. Null labels are left out; a document
labelled more than once counts once per label. Repeated ids and extra columns are allowed. Without
two classes in the labels every score is the share of class 1, 0.5 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import fold, utf8_rows
from docquarry.llm.linear import BITS, Features, class_counts, labelled_sample, sample_features

FOLDS = 4
HELD_OUT = 2
PER_CLASS = 4_000
ACCEPT = 0.7
SEED = 8


def quality_features() -> Features:
    return Features(BITS, words=True, pairs=False, heads=(), shape=(1, 2, 3, 4, 5))


@dataclass(frozen=True)
class QualityModel:
    """Weights per feature column (ratio and fit in one), the bias and the logistic curve."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def scores(self, texts: Iterator[bytes], features: Features) -> np.ndarray:
        margins = np.array([self._margin(features(t)) for t in texts], np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * margins + self.offset, -700, 700)))

    def _margin(self, columns: np.ndarray) -> float:
        return float(self.weights[columns].sum(dtype=np.float64) / np.sqrt(len(columns) + 1.0) + self.bias)


def log_count_ratio(counts: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log of the classes' smoothed, normalised feature counts, class 1 over class 0."""
    smoothed = counts + alpha
    shares = smoothed / smoothed.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def hinge_dual(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, columns: int, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss support vector machine by dual coordinate descent.

    Row i has *values[i]* in the columns *rows[i]*; the bias is a column of ones.
    """
    w, bias = np.zeros(columns), 0.0
    alpha = np.zeros(len(rows))
    norms = np.array([float(v @ v) + 1.0 for v in values])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            at, x = rows[i], values[i]
            gradient = y[i] * (float(w[at] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[at] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def logistic_curve(margins: np.ndarray, positive: np.ndarray, weight: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset that fit P(class 1 | margin) with Platt's smoothed targets, by Newton's method."""
    up, down = weight[positive].sum(), weight[~positive].sum()
    target = np.where(positive, (up + 1) / (up + 2), 1 / (down + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -500, 500)))
        g = np.array([(weight * (p - target) * margins).sum() + 1e-6 * a, (weight * (p - target)).sum()])
        s = weight * p * (1 - p)
        h = np.array([[(s * margins**2).sum(), (s * margins).sum()], [(s * margins).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def fit_quality(sample: DataFrame, sizes: np.ndarray | None = None, seed: int = SEED) -> QualityModel:
    """Model from a bounded *sample* ``(key, text, grade)`` with grades 0 and 1.

    *sizes* are the documents per class it stands for, by default its own.
    """
    grades, rows = sample_features(sample, quality_features)
    own = np.bincount(grades, minlength=2)
    sizes = own if sizes is None else sizes
    if not own.all():
        share = (sizes[1] + 0.5) / (sizes.sum() + 1.0)
        return QualityModel(np.zeros(1 << BITS), 0.0, 1.0, float(np.log(share / (1 - share))))
    counts = class_counts(grades, rows, 2, BITS)
    ratio = log_count_ratio(counts)
    # a column that a handful of documents have says nothing about others
    ratio[counts.sum(axis=0) < 5] = 0.0
    values = [ratio[r] / np.sqrt(len(r) + 1.0) for r in rows]
    y = np.where(grades == 1, 1.0, -1.0)
    shares = np.array([(y < 0).mean(), (y > 0).mean()])
    cost = np.where(y > 0, 0.5 / max(shares[1], 1e-9), 0.5 / max(shares[0], 1e-9))
    # one part of the sample is kept for the curve
    part = np.arange(len(rows)) % 5 == 0
    train = [i for i in range(len(rows)) if not part[i]]
    w, bias = hinge_dual([rows[i] for i in train], [values[i] for i in train], y[train], 1 << BITS, cost[train], 30, seed)
    final = QualityModel(ratio * w, bias, 1.0, 0.0)
    margins = np.array([final._margin(r) for r in rows])
    # the sample is even by class; weights restore the classes' shares
    weight = np.where(y > 0, sizes[1] / max(1, (y[part] > 0).sum()), sizes[0] / max(1, (y[part] < 0).sum()))
    weight = weight / weight.mean()
    slope, offset = logistic_curve(margins[part], (y > 0)[part], weight[part])
    return QualityModel(final.weights.astype(np.float32), bias, slope, offset)


def learn_quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, seed: int = SEED) -> QualityModel:
    """Model from ``labels.quality``, of documents outside the held-out fold only."""
    sample, sizes = labelled_sample(docs, labels, "quality", per_class, seed, fold("key", FOLDS) != HELD_OUT)
    return fit_quality(sample, sizes, seed)


def score_quality(docs: DataFrame, model: QualityModel, accept: float = ACCEPT) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of *docs*."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = quality_features()
        for batch in batches:
            found = sent.value.scores(utf8_rows(batch.column(1)), features)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found), pa.array((found >= accept).astype(np.int32))],
                names=["doc_id", "score", "predicted"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def accepted_documents(docs: DataFrame, model: QualityModel, accept: float) -> DataFrame:
    """The rows of *docs* that score at least *accept*, with all their columns."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = quality_features()
        for batch in batches:
            found = sent.value.scores(utf8_rows(batch.column(place)), features)
            yield batch.filter(pa.array(found >= accept))

    return docs.mapInArrow(run, docs.schema)
