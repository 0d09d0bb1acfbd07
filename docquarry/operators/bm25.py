"""BM25 ranking of documents for many questions.

Term statistics are Spark aggregations over the corpus; scoring is the one-scan top-k of
:mod:`docquarry.operators.ranking` with a term-frequency kernel.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.functions.binding import unnest
from docquarry.functions.text import split_tokens
from docquarry.operators.ranking import scan_top_k
from docquarry.session import cut_lineage

# The usual BM25 parameters.
K1 = 1.5
B = 0.75
EPSILON = 0.25


def postings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Inverted index ``(term, doc_id, tf)`` over white-space tokens.

    The texts are dealt by id, so that terms are counted where their text is and no posting is shuffled. The
    number of tasks is set, since Spark would join parts by the size of the texts and not of their postings.
    """
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = docs.select(doc_id, text).repartition(tasks, doc_id)
    terms = unnest(dealt, split_tokens(F.col(text)), value="term")
    return terms.groupBy("term", doc_id).agg(F.count(F.lit(1)).alias("tf"))


def term_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(term, df, tokens)``: document frequency per term, and the corpus under the null term.

    The null term occurs once in every document, so its ``df`` is the number of documents and its
    ``tokens`` their total length: one pass gives all statistics. The shuffle carries partial
    counts, not tokens.
    """
    tokens = split_tokens(F.col(text))
    marked = F.concat(F.array_distinct("held"), F.array(F.lit(None).cast("string")))
    listed = unnest(docs.select(tokens.alias("held")), marked, value="term").select(
        F.size("held").alias("length"), "term"
    )
    return listed.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"),
        F.sum(F.when(F.col("term").isNull(), F.col("length"))).alias("tokens"),
    )


def term_weights(stats: DataFrame) -> DataFrame:
    """``(term, df, idf, avg_len)`` from :func:`term_stats`.

    A negative idf becomes a quarter of the mean idf over all terms; ``avg_len`` is the mean
    document length, the same in every row.
    """
    corpus = stats.where(F.col("term").isNull())
    n_docs = corpus.select("df").scalar()
    avg_len = corpus.select(F.col("tokens") / F.col("df")).scalar()
    raw = stats.where(F.col("term").isNotNull()).withColumn(
        "raw", F.log(n_docs - F.col("df") + 0.5) - F.log(F.col("df") + F.lit(0.5))
    )
    floor = raw.agg(F.avg("raw") * EPSILON).scalar()
    return raw.select(
        "term",
        "df",
        F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"),
        avg_len.alias("avg_len"),
    )


def _factory(corpus_text: str, k1: float, b: float):
    def build(table: pa.Table):
        avg_len = table.column("avg_len")[0].as_py() or 1.0
        # per term: the questions that ask for it, and times asked x idf
        numbers: dict[str, int] = {}
        asking: list[dict[int, float]] = []
        for question, (tokens, weights) in enumerate(
            zip(table.column("__terms").to_pylist(), table.column("__idf").to_pylist(), strict=True)
        ):
            for term, idf in zip(tokens, weights, strict=True):
                number = numbers.setdefault(term, len(numbers))
                if number == len(asking):
                    asking.append({})
                asking[number][question] = asking[number].get(question, 0.0) + idf
        lengths = np.array([len(x) for x in asking], np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)))
        askers = np.array([q for x in asking for q in x], np.int64)
        weight = np.array([w for x in asking for w in x.values()])
        questions = table.num_rows

        def score(batch: pa.RecordBatch) -> np.ndarray:
            rows, terms, gains = [], [], []
            for i, text in enumerate(batch.column(corpus_text).to_pylist()):
                tokens = text.split()
                scale = k1 * (1.0 - b + b * len(tokens) / avg_len)
                for term, tf in Counter(tokens).items():
                    number = numbers.get(term)
                    if number is not None:
                        rows.append(i)
                        terms.append(number)
                        gains.append(tf * (k1 + 1.0) / (tf + scale))
            # every (document, term) meets the questions that ask for the term, and no others
            held = np.array(terms, np.int64)
            wide = lengths[held]
            entry = np.repeat(np.arange(len(held)), wide)
            place = np.arange(len(entry)) - np.repeat(np.cumsum(wide) - wide, wide) + starts[held[entry]]
            cell = np.array(rows, np.int64)[entry] * questions + askers[place]
            size = batch.num_rows * questions
            # without any cell numpy counts in integers
            scores = np.bincount(cell, np.array(gains)[entry] * weight[place], size).astype(float)
            # a document without any term of the question is no result
            hit = np.zeros(size, bool)
            hit[cell] = True
            scores[~hit] = -np.inf
            return scores.reshape(batch.num_rows, questions)

        score.width = len(askers)
        return score

    return build


def bm25(
    questions: DataFrame,
    docs: DataFrame,
    k: int = 4,
    *,
    question_id: str = "qid",
    question_text: str = "text",
    doc_id: str = "doc_id",
    text: str = "text",
    weights: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
    **bounds,
) -> DataFrame:
    """Top-k documents by BM25 per question: ``(qid, doc_id, rank, score)``.

    Pass stored *weights* (:func:`term_weights`) to skip the statistics pass. Documents that share
    no term with the question are left out.
    """
    if weights is None:
        # the statistics are read several times below; they are as small as the vocabulary
        weights = term_weights(cut_lineage(term_stats(docs, text)))
    asked = questions.select(
        question_id, F.posexplode(split_tokens(F.col(question_text))).alias("at", "term")
    )
    weighted = (
        asked.join(weights.select("term", "idf", "avg_len"), "term")
        .groupBy(question_id)
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "term", "idf"))).alias("found"),
            F.any_value("avg_len").alias("avg_len"),
        )
        .select(
            question_id,
            F.transform("found", lambda x: x["term"]).alias("__terms"),
            F.transform("found", lambda x: x["idf"]).alias("__idf"),
            "avg_len",
        )
    )
    return scan_top_k(
        weighted,
        docs.select(doc_id, text),
        _factory(text, k1, b),
        k,
        question_id=question_id,
        corpus_id=doc_id,
        required=("__terms", text),
        **bounds,
    )
