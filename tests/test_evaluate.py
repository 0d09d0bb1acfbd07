from __future__ import annotations

import math

import numpy as np
import pytest

from docquarry.operators import evaluate as E
from docquarry.sources import corpora


def brute(run, qrels, k):
    sums = dict.fromkeys(["NDCG", "MAP", "MRR", "Recall", "Precision"], 0.0)
    judged = [q for q, docs in qrels.items() if any(r > 0 for r in docs.values())]
    for q in judged:
        rels = qrels[q]
        top = sorted(run.get(q, {}).items(), key=lambda x: (-x[1], x[0]))[:k]
        gains = [rels.get(d, 0) for d, _ in top]
        ideal = sorted((r for r in rels.values() if r > 0), reverse=True)
        dcg = sum(g / math.log2(i + 2) for i, g in enumerate(gains))
        idcg = sum(g / math.log2(i + 2) for i, g in enumerate(ideal[:k]))
        hits = [i for i, g in enumerate(gains) if g > 0]
        sums["NDCG"] += dcg / idcg
        sums["MAP"] += sum((n + 1) / (i + 1) for n, i in enumerate(hits)) / len(ideal)
        sums["MRR"] += 1 / (hits[0] + 1) if hits else 0
        sums["Recall"] += len(hits) / len(ideal)
        sums["Precision"] += len(hits) / k
    return {f"{m}@{k}": v / len(judged) for m, v in sums.items()}


def test_metrics_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    run = {q: {f"d{d}": float(rng.integers(0, 4)) for d in rng.choice(40, 15, replace=False)} for q in range(12)}
    qrels = {q: {f"d{d}": int(rng.integers(0, 3)) for d in rng.choice(40, 12, replace=False)} for q in range(14)}
    run_df = spark.createDataFrame([(q, d, s) for q, x in run.items() for d, s in x.items()], "qid int, doc_id string, score double")
    qrels_df = spark.createDataFrame([(q, d, r) for q, x in qrels.items() for d, r in x.items()], "qid int, doc_id string, rel int")
    names = [f"{m}@{k}" for m in ("NDCG", "MAP", "MRR", "Recall", "Precision") for k in (1, 5, 10)]
    got = {r["metric"]: r["value"] for r in E.evaluate(run_df, qrels_df, names).collect()}
    expected = {}
    for k in (1, 5, 10):
        expected |= brute(run, qrels, k)
    assert got == pytest.approx(expected)


def test_names():
    assert E.cut_offs(["NDCG@10", "MAP@3", "x"]) == [3, 10]
    assert E.cut_offs(["ndcg"]) == [1, 5, 10, 20]
    assert [e.test for e in E.default_evaluations()] == list(E.DEFAULT_TESTS)


def test_several_evaluations(spark):
    run = spark.createDataFrame([(1, "a", 1.0)], "qid int, doc_id string, score double")
    qrels = spark.createDataFrame([(1, "a", 1)], "qid int, doc_id string, rel int")
    tests = [E.Evaluation("retrieval", name, ["MRR@1"]) for name in ("one", "two")]
    rows = E.run_evaluations(tests, lambda test: (run, qrels)).collect()
    assert sorted((r["test"], r["metric"], r["value"]) for r in rows) == [("one", "MRR@1", 1.0), ("two", "MRR@1", 1.0)]


def test_alias_and_unknown_names(spark):
    run = spark.createDataFrame([(1, "a", 1.0)], "qid int, doc_id string, score double")
    qrels = spark.createDataFrame([(1, "a", 1)], "qid int, doc_id string, rel int")
    assert {r["metric"]: r["value"] for r in E.evaluate(run, qrels, ["P@1", "Nope@1"]).collect()} == {"Precision@1": 1.0}


def test_paths(spark):
    df = spark.createDataFrame([("/p/q/12.x.txt",), ("doc.md",), ("plain",), (".rc",)], "doc_id string")
    assert [r["doc_id"] for r in E.simplify_run(df).collect()] == ["12.x", "doc", "plain", ".rc"]


def test_corpora(spark):
    corpus = spark.createDataFrame([("1", "T", "", "abs"), ("2", None, "body", "")], "_id string, title string, text string, abstract string")
    assert {r["doc_id"]: r["text"] for r in corpora.corpus_documents(corpus).collect()} == {"1": "T\n\nabs", "2": "\n\nbody"}
    queries = spark.createDataFrame([("10", "ten"), ("9", "nine"), ("1", "")], "_id string, text string")
    assert [r["qid"] for r in corpora.corpus_queries(queries).collect()] == ["9", "10"]
    qrels = spark.createDataFrame([("9", "1", "2")], "`query-id` string, `corpus-id` string, score string")
    assert tuple(corpora.corpus_qrels(qrels).first()) == ("9", "1", 2)


def test_hit_rate(spark):
    df = spark.createDataFrame([("Paris", "it is PARIS."), ("Rome", "no"), ("Oslo", None)], "expected string, found string")
    row = E.hit_rate(df).first()
    assert row["questions"] == 3 and row["hit_rate"] == pytest.approx(1 / 3)
