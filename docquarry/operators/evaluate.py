"""Retrieval quality: NDCG, MAP, MRR, recall and precision at k."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.errors import EvaluationError
from docquarry.functions.text import basename
from docquarry.operators.ranking import top_k_per_group

# Fixed values.
DEFAULT_KS = (1, 5, 10, 20)
DEFAULT_METRICS = ("NDCG@10", "MAP@10", "MRR@10", "Recall@10", "Precision@10")
DEFAULT_TESTS = ("BeIR/scifact", "BeIR/scidocs", "BeIR/trec-covid", "BeIR/fever", "BeIR/fiqa")
ALIASES = {"P": "Precision"}


@dataclass(frozen=True)
class Evaluation:
    category: str
    test: str
    metrics: Sequence[str] = field(default_factory=lambda: DEFAULT_METRICS)


def default_evaluations() -> list[Evaluation]:
    return [Evaluation("retrieval", test) for test in DEFAULT_TESTS]


def cut_offs(metrics: Iterable[str]) -> list[int]:
    """The k values in metric names ``X@k``; 1, 5, 10 and 20 when there are none."""
    found = {int(m.group(1)) for name in metrics if (m := re.search(r"@(\d+)$", name))}
    return sorted(found) if found else list(DEFAULT_KS)


def simplify_run(run: DataFrame) -> DataFrame:
    """Document paths to file names without extension."""
    return run.withColumn("doc_id", basename(F.col("doc_id")))


def judged_ranks(run: DataFrame, qrels: DataFrame, depth: int) -> DataFrame:
    """First *depth* results per question with relevance and its running count."""
    ranked = top_k_per_group(
        run.select("qid", "doc_id", "score"), ["qid"], [F.desc("score"), F.asc("doc_id")], depth
    )
    window = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranked.join(qrels.select("qid", "doc_id", "rel"), ["qid", "doc_id"], "left")
        .withColumn("rel", F.coalesce("rel", F.lit(0)))
        .withColumn("hits", F.sum((F.col("rel") > 0).cast("int")).over(window))
    )


def _gain(rel: Column, rank: Column) -> Column:
    return rel / F.log2(rank + F.lit(1.0))


def question_metrics(run: DataFrame, qrels: DataFrame, ks: Sequence[int]) -> DataFrame:
    """``(qid, metric, k, value)`` for every judged question with a relevant document.

    A question without results scores 0.
    """
    depth = max(ks)
    judged = judged_ranks(run, qrels, depth)
    ideal = top_k_per_group(
        qrels.where(F.col("rel") > 0).select("qid", "doc_id", "rel"),
        ["qid"],
        [F.desc("rel"), F.asc("doc_id")],
        depth,
    )
    relevant = (
        qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.count(F.lit(1)).alias("n_relevant"))
    )

    def at(k: int, value: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("rank") <= k, value)), F.lit(0.0))

    hit = F.col("rel") > 0
    found = judged.groupBy("qid").agg(
        *[at(k, _gain(F.col("rel"), F.col("rank"))).alias(f"dcg_{k}") for k in ks],
        *[at(k, F.when(hit, F.col("hits") / F.col("rank"))).alias(f"ap_{k}") for k in ks],
        *[at(k, hit.cast("double")).alias(f"hits_{k}") for k in ks],
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
    )
    best = ideal.groupBy("qid").agg(
        *[at(k, _gain(F.col("rel"), F.col("rank"))).alias(f"idcg_{k}") for k in ks]
    )
    joined = relevant.join(best, "qid").join(found, "qid", "left")

    def rows(k: int) -> list[Column]:
        hits = F.coalesce(F.col(f"hits_{k}"), F.lit(0.0))
        values = {
            "NDCG": F.coalesce(F.col(f"dcg_{k}"), F.lit(0.0)) / F.col(f"idcg_{k}"),
            "MAP": F.coalesce(F.col(f"ap_{k}"), F.lit(0.0)) / F.col("n_relevant"),
            "MRR": F.when(F.col("first_hit") <= k, F.lit(1.0) / F.col("first_hit")).otherwise(0.0),
            "Recall": hits / F.col("n_relevant"),
            "Precision": hits / F.lit(float(k)),
        }
        return [
            F.struct(F.lit(m).alias("metric"), F.lit(k).alias("k"), v.alias("value"))
            for m, v in values.items()
        ]

    entries = F.array(*reduce(lambda a, b: a + b, [rows(k) for k in ks]))
    return joined.select("qid", F.inline(entries))


def evaluate(run: DataFrame, qrels: DataFrame, metrics: Sequence[str] = DEFAULT_METRICS) -> DataFrame:
    """``(metric, value)`` for the requested names ``X@k``, the mean over the judged questions.

    ``P@k`` is accepted for ``Precision@k``. Of duplicate names the larger value counts.
    """
    values = (
        question_metrics(run, qrels, cut_offs(metrics))
        .groupBy(F.concat_ws("@", "metric", F.col("k").cast("string")).alias("metric"))
        .agg(F.avg("value").alias("value"))
    )
    return select_metrics(values, metrics)


def run_evaluations(evaluations: Iterable[Evaluation], load) -> DataFrame:
    """``(category, test, metric, value)`` of several evaluations in one plan.

    *load* gives the run and the judgements of a test: ``load(test) -> (run, qrels)``.
    """
    parts = [
        evaluate(*load(e.test), e.metrics).select(
            F.lit(e.category).alias("category"), F.lit(e.test).alias("test"), "metric", "value"
        )
        for e in evaluations
    ]
    if not parts:
        raise EvaluationError("no evaluations given")
    return reduce(DataFrame.unionByName, parts)


def select_metrics(values: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Keep the requested names, each once with its largest value."""
    wanted = []
    for name in metrics:
        head, at, tail = name.partition("@")
        wanted.append(ALIASES.get(head, head) + at + tail)
    return (
        values.where(F.col("metric").isin(wanted))
        .groupBy("metric")
        .agg(F.max("value").alias("value"))
    )


def hit_rate(answers: DataFrame, expected: str = "expected", found: str = "found") -> DataFrame:
    """Share of rows whose *found* text holds the *expected* one, ignoring case."""
    hit = F.contains(F.lower(found), F.lower(expected)).cast("double")
    return answers.agg(
        F.count(F.lit(1)).alias("questions"), F.avg(F.coalesce(hit, F.lit(0.0))).alias("hit_rate")
    )
