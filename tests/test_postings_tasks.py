"""Stored postings at size: blocks travel once, tasks have a fixed number of ranges."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.operators import bm25 as B
from docquarry.operators.postings import SCORED_RANGES, PostingIndex
from docquarry.session import Scratch, scratch_path


def test_blocks_are_dealt_by_range_whatever_is_asked(spark):
    docs = spark.range(1280).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("all"), F.col("id") % 7, F.col("id") % 50).alias("text"))
    asked = spark.range(60).select(F.col("id").alias("qid"), F.concat_ws(" ", F.lit("all"), F.col("id") % 50).alias("text"))
    terms = PostingIndex(spark, scratch_path(spark, "terms"), parts=4, range_docs=16)
    terms.add(docs)
    with Scratch(spark) as scratch:
        words = scratch.cut(terms._asked(asked, "qid", "text"))
        blocks = terms._asked_blocks(words)
        chosen = scratch.cut(blocks.join(words, ["part", "term"]).select("qid", "range").distinct())
        found = terms._scored(chosen, words, blocks)
        plan = found._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert not any("hashpartitioning(qid" in line for line in exchanges)
    assert any("hashpartitioning(range#" in line and f", {80 // SCORED_RANGES}), REPARTITION_BY_NUM" in line for line in exchanges)
    rows = lambda df: sorted((r.qid, r.doc_id, r.rank, round(r.score, 7)) for r in df.collect())
    assert rows(terms.search(asked, 5)) == rows(B.bm25(asked, docs, 5))
