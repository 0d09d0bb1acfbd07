"""The inverted index shuffles texts, not postings."""

from __future__ import annotations

from docquarry.operators import bm25 as B


def test_postings_are_counted_where_their_text_is(spark):
    rows = [(1, "a b a"), (2, "b"), (1, "a c"), (3, None), (4, "")]
    index = B.postings(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = index._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and plan.count("Exchange") == 1
    assert sorted(map(tuple, index.collect())) == [("a", 1, 3), ("b", 1, 1), ("b", 2, 1), ("c", 1, 1)]
