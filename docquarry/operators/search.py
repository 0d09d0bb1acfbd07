"""Exact nearest neighbours over a table of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.errors import InvalidConfiguration
from docquarry.operators.ranking import list_matrix, scan_top_k

METRICS = ("l2", "cosine")


def _factory(metric: str, question_vector: str, corpus_vector: str):
    def build(table: pa.Table):
        asked = list_matrix(table.column(question_vector))
        square = (asked * asked).sum(axis=1)
        scale = np.sqrt(square)

        def score(batch: pa.RecordBatch) -> np.ndarray:
            rows = list_matrix(batch.column(corpus_vector))
            if not len(rows):
                return np.zeros((0, len(asked)))
            products = rows @ asked.T
            own = (rows * rows).sum(axis=1)
            if metric == "l2":
                return -np.maximum(own[:, None] + square[None, :] - 2.0 * products, 0.0)
            size = np.sqrt(own)[:, None] * scale[None, :]
            return np.divide(products, size, out=np.zeros_like(products), where=size > 0)

        return score

    return build


def nearest(
    questions: DataFrame,
    vectors: DataFrame,
    k: int = 4,
    metric: str = "l2",
    *,
    question_id: str = "qid",
    question_vector: str = "embedding",
    vector_id: str = "doc_id",
    vector: str = "embedding",
    ordinal: str | None = None,
    where: Column | None = None,
    **bounds,
) -> DataFrame:
    """Top-k of *vectors* for every question: ``(qid, doc_id, rank, score)``.

    ``l2`` scores are squared distances, smallest first, ties to the smaller *ordinal*; ``cosine``
    scores are similarities, largest first, ties to the larger *ordinal*; a zero vector has
    similarity 0. *where* filters the vectors before the search. Rows without a vector are skipped.
    """
    if metric not in METRICS:
        raise InvalidConfiguration("unknown metric", metric=metric)
    if where is not None:
        vectors = vectors.where(where)
    columns = [vector_id, vector] + ([ordinal] if ordinal and ordinal != vector_id else [])
    found = scan_top_k(
        questions.select(question_id, question_vector),
        vectors.select(*columns),
        _factory(metric, question_vector, vector),
        k,
        question_id=question_id,
        corpus_id=vector_id,
        tie=ordinal,
        tie_descending=metric == "cosine",
        required=(question_vector, vector),
        **bounds,
    )
    return found.withColumn("score", -F.col("score")) if metric == "l2" else found


def first_k(vectors: DataFrame, k: int = 4, ordinal: str = "ordinal") -> DataFrame:
    """The first *k* rows in insertion order, whatever the question."""
    return vectors.orderBy(ordinal).limit(k)


def centroids(vectors: DataFrame, label: str, vector: str = "embedding") -> DataFrame:
    """Mean vector per label: ``(label, embedding)``; partial sums keep hot labels cheap."""
    flat = vectors.select(label, F.posexplode(vector).alias("dim", "value"))
    means = flat.groupBy(label, "dim").agg(F.avg(F.col("value").cast("double")).alias("value"))
    packed = means.groupBy(label).agg(
        F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("pairs")
    )
    return packed.select(label, F.transform("pairs", lambda p: p["value"]).alias(vector))
