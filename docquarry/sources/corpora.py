"""Evaluation corpora: documents, queries and relevance judgements under their usual names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _first_present(df: DataFrame, names: Sequence[str], default: str | None = None) -> Column:
    """First non-empty value of the columns that exist."""
    held = [
        F.when(F.col(f"`{n}`").cast("string") != "", F.col(f"`{n}`").cast("string"))
        for n in names
        if n in df.columns
    ]
    if default is not None:
        held.append(F.lit(default))
    return F.coalesce(*held)


def corpus_documents(corpus: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with the title, a blank line and the text or abstract."""
    title = F.coalesce(F.col("title").cast("string"), F.lit("")) if "title" in corpus.columns else F.lit("")
    body = _first_present(corpus, ["text", "abstract"], "")
    return corpus.select(
        _first_present(corpus, ["doc_id", "_id", "id"]).alias("doc_id"),
        F.concat(title, F.lit("\n\n"), body).alias("text"),
    )


def corpus_queries(queries: DataFrame) -> DataFrame:
    """``(qid, text)`` of the non-empty queries, in numeric id order."""
    out = queries.select(
        _first_present(queries, ["query_id", "_id", "id"]).alias("qid"),
        _first_present(queries, ["text", "query"], "").alias("text"),
    ).where(F.col("text") != "")
    return out.orderBy(F.col("qid").try_cast("bigint"), "qid")


def corpus_qrels(qrels: DataFrame) -> DataFrame:
    """``(qid, doc_id, rel)``; a missing score is 0."""
    score = F.col("score").cast("int") if "score" in qrels.columns else F.lit(0)
    return qrels.select(
        _first_present(qrels, ["query-id", "query_id"]).alias("qid"),
        _first_present(qrels, ["corpus-id", "doc_id"]).alias("doc_id"),
        F.coalesce(score, F.lit(0)).alias("rel"),
    )


def examples(queries: DataFrame, corpus: DataFrame, qrels: DataFrame) -> DataFrame:
    """``(qid, query, answer, doc_id)``: each judgement with both texts."""
    return (
        qrels.join(queries.select("qid", F.col("text").alias("query")), "qid")
        .join(corpus.select("doc_id", F.col("text").alias("answer")), "doc_id")
        .select("qid", "query", "answer", "doc_id")
    )
