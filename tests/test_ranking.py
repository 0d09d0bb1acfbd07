from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docquarry.operators import bm25 as B
from docquarry.operators.ranking import _Leaders, _question_blocks, best_rows, top_k_per_group
from docquarry.operators.search import nearest


@given(
    st.lists(st.lists(st.integers(-2, 2), min_size=3, max_size=3), min_size=1, max_size=30),
    st.integers(1, 8),
)
@settings(max_examples=200, deadline=None)
def test_best_rows_is_a_stable_sort(rows, k):
    scores = np.array(rows, dtype=float)
    expected = np.argsort(-scores, axis=0, kind="stable")[:k].T
    assert (best_rows(scores, k) == expected).all()


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(3)
    # few distinct values: many exact ties, a third of the vectors are one and the same
    points = rng.integers(-1, 2, size=(300, 4)).astype(float)
    points[::3] = [1.0, 1.0, 0.0, 0.0]
    points[7] = 0.0
    asked = rng.integers(-1, 2, size=(23, 4)).astype(float)
    asked[0] = 0.0
    vectors = spark.createDataFrame(
        [(f"d{i:03}", i, [float(x) for x in p]) for i, p in enumerate(points)],
        "doc_id string, ordinal bigint, embedding array<double>",
    ).repartition(5)
    questions = spark.createDataFrame(
        [(i, [float(x) for x in p]) for i, p in enumerate(asked)], "qid bigint, embedding array<double>"
    )
    return points, asked, vectors, questions


def brute(points, asked, k, metric):
    out = {}
    for q, a in enumerate(asked):
        rows = []
        for i, p in enumerate(points):
            if metric == "l2":
                rows.append((round(float(((p - a) ** 2).sum()), 6), i, i))
            else:
                size = np.linalg.norm(p) * np.linalg.norm(a)
                sim = float(p @ a / size) if size else 0.0
                rows.append((-round(sim, 6), -i, i))
        rows.sort()
        out[q] = [f"d{i:03}" for _, _, i in rows[:k]]
    return out


@pytest.mark.parametrize("metric", ["l2", "cosine"])
@pytest.mark.parametrize("bounds", [{}, {"block_rows": 5}])
def test_nearest_equals_brute_force(frames, metric, bounds):
    points, asked, vectors, questions = frames
    found = nearest(questions, vectors, 6, metric, ordinal="ordinal", **bounds)
    lists = {}
    for row in found.orderBy("qid", "rank").collect():
        lists.setdefault(row["qid"], []).append(row["doc_id"])
    assert lists == brute(points, asked, 6, metric)


def test_fewer_rows_than_k_and_missing_vectors(spark):
    questions = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid int, embedding array<double>")
    vectors = spark.createDataFrame(
        [("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 1.0])], "doc_id string, embedding array<double>"
    )
    rows = nearest(questions, vectors, 5, "cosine").orderBy("rank").collect()
    assert [(r["qid"], r["doc_id"], r["rank"]) for r in rows] == [(1, "a", 1), (1, "c", 2)]


def test_block_route_of_bm25(spark):
    docs = spark.createDataFrame(
        [(i, " ".join(["red"] * (i % 4) + ["blue"] * (i % 3) + ["sky", f"w{i % 7}"])) for i in range(60)],
        "doc_id bigint, text string",
    )
    questions = spark.createDataFrame(
        [(i, t) for i, t in enumerate(["red sky", "blue w3", "red red blue", "nothing here", "w1 w2"])],
        "qid bigint, text string",
    )
    plain = B.bm25(questions, docs, 4)
    blocks = B.bm25(questions, docs, 4, block_rows=2)
    key = ["qid", "doc_id", "rank"]
    assert sorted(map(tuple, plain.select(key).collect())) == sorted(map(tuple, blocks.select(key).collect()))
    assert 3 not in {r["qid"] for r in plain.collect()}


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "a a c"), (3, "d")], "doc_id int, text string")
    asked = spark.createDataFrame([(0, "c b")], "qid int, text string")
    got = {r["doc_id"]: r["score"] for r in B.bm25(asked, docs, 5).collect()}
    idf = np.log(3 - 1 + 0.5) - np.log(1.5)
    def gain(length):
        return idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * length / 2.0))
    assert got == pytest.approx({1: gain(2), 2: gain(3)}, abs=1e-8)


def test_large_k_cuts_groups_twice(spark):
    df = spark.range(5000).select(F.lit(1).alias("g"), "id")
    rows = top_k_per_group(df, ["g"], [F.desc("id")], 1500).agg(F.count("*"), F.min("id"), F.max("rank")).first()
    assert tuple(rows) == (1500, 3500, 1500)


def test_scores_that_are_no_numbers_are_left_out():
    import pyarrow as pa

    leaders = _Leaders(2, False)
    ids = pa.array([1, 2, 3, 4])
    leaders.add(ids, ids, np.array([[np.nan], [0.5], [np.inf], [0.25]]))
    assert leaders.ids.tolist() == [[2, 4]]


def test_question_blocks_are_whole_and_bounded(spark):
    questions = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(300)], "qid bigint, text string")
    blocks = list(_question_blocks(questions, 40, 600))
    assert sorted(q for b in blocks for q in b.column("qid").to_pylist()) == list(range(300))
    assert all(b.num_rows <= 40 and (b.nbytes <= 600 or b.num_rows == 1) for b in blocks)
