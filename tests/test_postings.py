"""Stored postings: equal to the full scan, skipped ranges, batches, plans."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from docquarry.operators import bm25 as B
from docquarry.operators.postings import PostingIndex
from docquarry.session import Scratch, scratch_path

KEY = ["qid", "doc_id", "rank"]


def rows(df):
    return sorted((r["qid"], r["doc_id"], r["rank"], round(r["score"], 7)) for r in df.collect())


def corpus(spark, seed, n=600, start=0):
    """Common words everywhere, rare ones in few documents, a third of all texts equal."""
    draw = random.Random(seed)
    out = []
    for i in range(start, start + n):
        if i % 3 == 0:
            out.append((i, "the same text of all copies"))
        else:
            words = ["the"] * draw.randint(0, 4) + [f"w{int(draw.paretovariate(0.7))}" for _ in range(draw.randint(1, 40))]
            draw.shuffle(words)
            out.append((i, " ".join(words)))
    return spark.createDataFrame(out, "doc_id bigint, text string").repartition(4)


ASKED = ["the same", "w1 w2 w3 the", "w977 w1", "w55 w55 w81 w13", "unknown words", "", "w4 copies"]


@pytest.fixture
def asked(spark):
    more = [" ".join(f"w{random.Random(i).randint(1, 60)}" for i in range(j, j + 5)) for j in range(6)]
    return spark.createDataFrame(list(enumerate(ASKED + more)), "qid bigint, text string")


def index(spark, **settings):
    return PostingIndex(spark, scratch_path(spark, "terms"), **{"parts": 4, "range_docs": 16, **settings})


@pytest.mark.parametrize("k", [1, 4, 50])
def test_equal_to_the_scan(spark, asked, k):
    docs = corpus(spark, 1)
    terms = index(spark)
    terms.add(docs)
    assert rows(terms.search(asked, k)) == rows(B.bm25(asked, docs, k))


def test_batches_equal_one_index(spark, asked):
    # lengths of the second batch move the mean, so stored bounds have to be raised
    short, long = corpus(spark, 2, 300), corpus(spark, 3, 300, 300).withColumn(
        "text", F.concat_ws(" ", "text", "text", "text", "text")
    )
    terms = index(spark)
    terms.add(short)
    assert rows(terms.search(asked, 3)) == rows(B.bm25(asked, short, 3))
    terms.add(long)
    assert terms.version() == 2
    assert rows(terms.search(asked, 3)) == rows(B.bm25(asked, short.unionByName(long), 3))


def test_ranges_are_skipped(spark):
    """Rare terms lift the floor above what ranges with common terms alone can give."""
    docs = spark.createDataFrame(
        [(i, "common words here" + (" rare gem" if i % 100 == 7 else "")) for i in range(2000)],
        "doc_id bigint, text string",
    )
    terms = index(spark)
    terms.add(docs)
    question = spark.createDataFrame([(0, "rare gem common")], "qid bigint, text string")
    found = terms.searched(question, 2)
    assert rows(found.rows) == rows(B.bm25(question, docs, 2))
    assert found.ranges > 100
    assert found.scored < found.ranges / 4


def test_a_cut_off_batch_is_written_again(spark, asked, monkeypatch):
    docs = corpus(spark, 4, 200)
    terms = index(spark)

    def broken(*_):
        raise RuntimeError("stopped")

    with monkeypatch.context() as patch:
        patch.setattr(PostingIndex, "_count", broken)
        with pytest.raises(RuntimeError):
            terms.add(docs)
    assert terms.version() == 0
    terms.add(docs)
    assert rows(terms.search(asked, 3)) == rows(B.bm25(asked, docs, 3))


def test_plan_reads_asked_parts_without_python_or_texts(spark, asked):
    docs = corpus(spark, 5, 200)
    terms = index(spark, parts=16)
    terms.add(docs)
    one = asked.where(F.col("qid") == 2)
    with Scratch(spark) as scratch:
        words = scratch.cut(terms._asked(one, "qid", "text"))
        blocks = terms._asked_blocks(words)
        chosen = blocks.join(words, ["part", "term"]).select("qid", "range").distinct()
        plan = terms._scored(chosen, words, blocks)._jdf.queryExecution().executedPlan().toString()
        read = blocks.select(F.input_file_name()).distinct().collect()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
    assert "text" not in plan
    scans = [line for line in plan.splitlines() if "tfs" in line and "FileScan" in line]
    assert scans
    for line in scans:
        assert re.search(r"PartitionFilters: \[[^]]*part#\d+L? (IN|=)", line), line
        assert re.search(r"PushedFilters: \[[^]]*(In\(term|EqualTo\(term)", line), line
    assert len(read) <= 2


def test_odd_rows(spark, asked):
    odd = spark.createDataFrame(
        [(None, "w1"), (1, None), (2, ""), (3, "w1 w1"), (4, "w1 w1"), (5, "w9 " * 20_000)],
        "doc_id bigint, text string",
    )
    terms = index(spark)
    terms.add(odd)
    got = rows(terms.search(spark.createDataFrame([(0, "w1"), (1, None)], "qid bigint, text string"), 5))
    assert [r[:3] for r in got] == [(0, 3, 1), (0, 4, 2)]
    empty = index(spark)
    empty.add(odd.limit(0))
    assert rows(empty.search(asked, 5)) == []
    blank = index(spark)
    blank.add(odd.where("doc_id = 2"))
    assert rows(blank.search(asked, 5)) == []


def test_ties_go_to_the_smaller_id(spark):
    docs = spark.createDataFrame([(i, "a b") for i in range(300)] + [(900, "c")], "doc_id bigint, text string")
    terms = index(spark)
    terms.add(docs)
    found = terms.searched(spark.createDataFrame([(0, "a")], "qid bigint, text string"), 3)
    assert [r[1] for r in rows(found.rows)] == [0, 1, 2]
