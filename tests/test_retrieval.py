from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.operators import retrieval as R


@pytest.mark.parametrize(
    "text,clean,filters",
    [
        (
            'What is it? filter:title="Two Words" filter:page_num=42',
            "What is it?",
            {"title": "Two Words", "page_num": "42"},
        ),
        ("filter:a=b start  here", "start here", {"a": "b"}),
        ("no directive", "no directive", {}),
        ("filter:a=1 filter:a=12 x", "x", {"a": "12"}),
    ],
)
def test_parse_filters(spark, text, clean, filters):
    row = spark.createDataFrame([(text,)], "t string").select(
        R.clean_question(F.col("t")).alias("c"), R.question_filters(F.col("t")).alias("f")
    ).first()
    assert (row["c"], row["f"]) == (clean, filters)


@pytest.mark.parametrize(
    "value,kind,wanted,expected",
    [
        ("Two Words", "string", "words", True),
        (42, "int", "42", True),
        (42, "int", "43", False),
        (42, "int", "42.0", False),
        (42, "int", "no number", False),
        (3.14, "double", "3.14", True),
        (3.14, "double", "pi", False),
        (True, "boolean", "1", True),
        (None, "string", "x", False),
        (["x"], "array<string>", "x", False),
    ],
)
def test_value_matches(spark, value, kind, wanted, expected):
    df = spark.createDataFrame([(value, {"v": wanted})], f"v {kind}, f map<string,string>")
    hit = df.select(R.matches_filters({"v": df.schema["v"].dataType}, F.col("f")).alias("h")).first()["h"]
    assert hit is expected


def test_all_filters_must_hold(spark):
    df = spark.createDataFrame(
        [({"a": "x", "n": "1"},), ({"a": "x", "n": "2"},), ({"zzz": "1"},), ({},)], "f map<string,string>"
    ).withColumns({"a": F.lit("Xy"), "n": F.lit(1)})
    hits = [r[0] for r in df.select(R.matches_filters({"a": T.StringType(), "n": T.IntegerType()}, F.col("f"))).collect()]
    assert hits == [True, False, False, True]


def ranked(spark, rows):
    return spark.createDataFrame(rows, "qid int, doc_id string, rank int, content string, question string")


def test_rerank_is_stable(spark):
    q = "The Brasília of straße"
    rows = [(1, "a", 1, "nothing", q), (1, "b", 2, "brasília", q), (1, "c", 3, "Straße, STRASSE straße brasília", q), (1, "d", 4, "the of", q)]
    found = R.keyword_rerank(ranked(spark, rows), 4).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["c", "b", "a", "d"]


def test_fusion(spark):
    dense = ranked(spark, [(1, "A", 1, "", ""), (1, "B", 2, "", "")])
    sparse = ranked(spark, [(1, "B", 1, "", ""), (1, "C", 2, "", "")])
    found = R.reciprocal_rank_fusion(dense, sparse, k=3).orderBy("rank").collect()
    assert [r["doc_id"] for r in found] == ["B", "A", "C"]
    tie = R.reciprocal_rank_fusion(
        ranked(spark, [(1, "x", 1, "", "")]), ranked(spark, [(1, "y", 1, "", "")]), k=2
    )
    assert [r["doc_id"] for r in tie.orderBy("rank").collect()] == ["x", "y"]


def test_packing_stops_at_the_first_overflow(spark):
    rows = [(1, "a", 1, "one two three", ""), (1, "b", 2, "one two three four", ""), (1, "c", 3, "", ""), (2, "d", 1, "one two three four", "")]
    packed = R.pack_context(ranked(spark, rows), 3).collect()
    assert [r["doc_id"] for r in packed] == ["a"]
    counted = ranked(spark, rows).withColumn("n", F.lit(1))
    assert R.pack_context(counted, 3, token_count="n").count() == 4


def test_post_filter_fetches_three_times_k(spark):
    rows = [(1, f"d{i}", i, "", "") for i in range(1, 10)]
    lists = ranked(spark, rows)
    keep = F.col("rank") % 2 == 0
    filters = F.create_map(F.lit("a"), F.lit("b"))
    found = R.filter_ranked(lists, keep, 2, filters).orderBy("rank").collect()
    assert [(r["doc_id"], r["rank"]) for r in found] == [("d2", 1), ("d4", 2)]
    none = F.expr("cast(map() as map<string,string>)")
    assert R.filter_ranked(lists, F.lit(True), 2, none).count() == 2
    assert R.filter_ranked(lists, F.col("rank") > 6, 2, filters).count() == 0


def test_rank_scores(spark):
    rows = [(1, "s", 1, "", ""), (1, "s", 2, "", ""), (1, "t", 3, "", "")]
    best = {r["doc_id"]: r["score"] for r in R.rank_scores(ranked(spark, rows), "doc_id").collect()}
    last = {r["doc_id"]: r["score"] for r in R.rank_scores(ranked(spark, rows), "doc_id", "last").collect()}
    assert best == {"s": 1.0, "t": pytest.approx(1 / 3)} and last["s"] == 0.5
