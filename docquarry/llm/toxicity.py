"""Toxicity: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t_k): the grades share the weights w and differ in their ordered
thresholds t_1 <= t_2 only. The expected severity is the sum of P(grade > k).

Labels are yes or no; the grades of a training text are 0 for no, and for yes 1 or 2, by its number
of marker features (those whose log-count ratio exceeds ``MARK``), cut at the median of the toxic
texts. The model is fitted on at most ``per_class`` rows per label (a documented bound; rows are chosen by
a seeded hash). Scores cover all rows and whole texts.

Null and empty texts have no features and score by the thresholds. Null labels are left out.
Repeated ids and extra columns are allowed. Without both labels every severity is the share of
toxic labels, 0 without labels.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import utf8_rows
from docquarry.llm.linear import BITS, Features, class_counts, labelled_sample, sample_features

PER_CLASS = 4_000
MARK = 3.0
FLAG = 0.5
SEED = 1
GRADES = 3


def toxicity_features() -> Features:
    return Features(BITS, words=True, pairs=False, heads=(4, 5, 6, 7), shape=())


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class ToxicityModel:
    """Shared weights and the ordered thresholds."""

    weights: np.ndarray
    thresholds: np.ndarray

    def exceed(self, columns: np.ndarray) -> np.ndarray:
        """P(grade > k) for every threshold."""
        return _sigmoid(self.weights[columns].sum(dtype=np.float64) - self.thresholds)


def fit_ordinal(
    rows: list[np.ndarray], grades: np.ndarray, scale: np.ndarray, grades_n: int, weight: np.ndarray,
    epochs: int = 40, rate: float = 0.3, ridge: float = 1e-4, seed: int = SEED,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by AdaGrad on the cumulative-link likelihood.

    *scale* multiplies each indicator. Gaps between thresholds are exponentials, so they stay ordered.
    """
    w = np.zeros(len(scale))
    seen = np.full(len(scale), 1e-6)
    free = np.zeros(grades_n - 1)  # first threshold, then logs of the gaps
    free_seen = np.full(grades_n - 1, 1e-6)
    free[0] = 1.0
    shuffled = np.random.default_rng(seed)
    batch = 64
    flat = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)))

    def thresholds() -> np.ndarray:
        return np.concatenate((free[:1], free[0] + np.cumsum(np.exp(free[1:]))))

    for _ in range(epochs):
        order = shuffled.permutation(len(rows))
        for at in range(0, len(order), batch):
            picked = order[at : at + batch]
            columns = np.concatenate([flat[starts[i] : starts[i + 1]] for i in picked])
            owner = np.repeat(np.arange(len(picked)), lengths[picked])
            score = np.bincount(owner, w[columns] * scale[columns], len(picked))
            t = np.concatenate(([-np.inf], thresholds(), [np.inf]))
            g = grades[picked]
            # P(grade) = F(t_{g+1} - s) - F(t_g - s)
            high, low = _sigmoid(t[g + 1] - score), _sigmoid(t[g] - score)
            high, low = np.where(g == grades_n - 1, 1.0, high), np.where(g == 0, 0.0, low)
            p = np.maximum(high - low, 1e-12)
            dh, dl = high * (1 - high), low * (1 - low)
            ds = weight[picked] * (dh - dl) / p
            grad = np.bincount(columns, ds[owner] * scale[columns], len(scale)) / len(picked)
            touched = np.unique(columns)
            change = grad[touched] + ridge * w[touched]
            seen[touched] += change * change
            w[touched] -= rate * change / np.sqrt(seen[touched])
            dt = np.zeros(grades_n - 1)
            np.add.at(dt, np.minimum(g, grades_n - 2), np.where(g < grades_n - 1, -weight[picked] * dh / p, 0.0))
            np.add.at(dt, np.maximum(g - 1, 0), np.where(g > 0, weight[picked] * dl / p, 0.0))
            dt /= len(picked)
            df = np.concatenate(([dt.sum()], [dt[k:].sum() * np.exp(free[k]) for k in range(1, grades_n - 1)]))
            free_seen += df * df
            free -= rate * df / np.sqrt(free_seen)
    return w * scale, thresholds()


def fit_toxicity(sample: DataFrame, sizes: np.ndarray, seed: int = SEED) -> ToxicityModel:
    """Model from a bounded *sample* ``(key, text, grade)`` with grades 0 (clean) and 1 (toxic).

    *sizes* are the documents per label that it stands for.
    """
    labels, rows = sample_features(sample, toxicity_features)
    own = np.bincount(labels, minlength=2)
    if not own.all():
        share = sizes[1] / max(1, sizes.sum())
        odds = np.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return ToxicityModel(np.zeros(1 << BITS), np.array([-odds, 700.0]))
    counts = class_counts(labels, rows, 2, BITS)
    shares = (counts + 0.5) / (own[:, None] + 1.0)
    ratio = np.log(shares[1] / shares[0])
    ratio[counts.sum(axis=0) < 3] = 0.0
    # only columns that tell the labels apart carry weight
    scale = np.where(np.abs(ratio) > 1.0, np.minimum(np.abs(ratio), 5.0) / 2.0, 0.0)
    rows = [r[scale[r] > 0] if len(r) else r.astype(np.int64) for r in rows]
    marks = np.array([int((ratio[r] > MARK).sum()) for r in rows])
    toxic = labels == 1
    middle = np.median(marks[toxic]) if toxic.any() else 0
    grades = np.where(toxic, np.where(marks > middle, 2, 1), 0)
    weight = np.where(toxic, sizes[1] / max(1, toxic.sum()), sizes[0] / max(1, (~toxic).sum()))
    w, thresholds = fit_ordinal(rows, grades, scale, GRADES, weight / weight.mean(), seed=seed)
    return ToxicityModel(w.astype(np.float32), thresholds)


def score_toxicity(docs: DataFrame, model: ToxicityModel, flag: float = FLAG) -> DataFrame:
    """``(doc_id, severity, grade, toxic)``: expected severity, likeliest grade, P(grade > 0) >= *flag*."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = toxicity_features()
        for batch in batches:
            over = np.array([sent.value.exceed(features(t)) for t in utf8_rows(batch.column(1))])
            over = over.reshape(-1, GRADES - 1)
            edges = np.concatenate([np.ones((len(over), 1)), over, np.zeros((len(over), 1))], axis=1)
            grade = np.argmax(edges[:, :-1] - edges[:, 1:], axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(over.sum(axis=1)), pa.array(grade.astype(np.int32)),
                    pa.array(over[:, 0] >= flag),
                ],
                names=["doc_id", "severity", "grade", "toxic"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, severity double, grade int, toxic boolean"
    )


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """Severity of every document, learned from ``labels.toxic``."""
    sample, sizes = labelled_sample(docs, labels, "toxic", per_class, SEED)
    return score_toxicity(docs, fit_toxicity(sample, sizes))
