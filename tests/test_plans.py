"""The physical plans keep the properties the library relies on."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import embedding as V
from docquarry.functions import headings as H
from docquarry.operators import chunking, store
from docquarry.operators.changes import keep_first
from docquarry.operators.ranking import top_k_per_group
from docquarry.plans import catalog
from docquarry.sources.tables import read_table, spread

QUERIES, _ = catalog.load()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rankings_are_cut_before_the_shuffle(spark, folder):
    orders = read_table(spark, folder, "orders")
    text = plan(top_k_per_group(orders, ["o_custkey"], [F.desc("o_totalprice")], 5))
    assert text.count("WindowGroupLimit") == 2
    assert text.rindex("WindowGroupLimit") > text.index("Exchange")


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(QUERIES["filter_then_limit"](spark, folder))
    assert "EqualTo(lang,de)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text
    assert "TakeOrderedAndProject" in text
    text = plan(QUERIES["source_chunk_counts"](spark, folder))
    assert "ReadSchema: struct<l_orderkey:bigint>" in text and "ReadSchema: struct<o_orderkey:bigint>" in text
    text = plan(QUERIES["filtered_topk_pre"](spark, folder))
    assert "LessThan(label,5)" in text


def test_limit_stays_below_the_filter(spark, folder):
    text = plan(QUERIES["limit_then_filter"](spark, folder))
    assert text.index("Filter") < text.index("TakeOrdered")


def test_native_paths_have_no_python(spark, folder):
    for name in (
        "char_windows", "token_windows", "markdown_headings", "html_headings", "html_text", "font_headings",
        "extract_citations", "hash_embedding", "codepoint_embedding", "search_terms_and", "parse_filters",
        "dedup_exact", "incremental_chunks", "reindex_diff", "ir_metrics", "pair_similarity",
    ):
        text = plan(QUERIES[name](spark, folder))
        assert "Python" not in text and "InArrow" not in text and "Cartesian" not in text, name


def test_row_local_steps_do_not_shuffle(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "text")
    assert "Exchange" not in plan(docs.select(V.sha256_embedding(F.col("text"))))
    pages = read_table(spark, folder, "pages")
    assert "Exchange" not in plan(pages.select(H.html_headings(F.col("html"))))
    assert "Exchange" not in plan(chunking.token_windows(docs))


def test_copies_are_dropped_on_the_map_side(spark):
    df = spark.range(10).select(F.lit(1).alias("source_id"), F.lit("x").alias("content"), F.col("id").alias("chunk_index"))
    text = plan(keep_first(df, ["source_id"]))
    assert "partial_min_by" in text and text.count("Exchange") == 1
    assert keep_first(df, ["source_id"]).collect()[0]["chunk_index"] == 0


def test_spread_leaves_wide_scans_alone(spark, folder):
    one = read_table(spark, folder, "documents")
    assert spread(one, "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    wide = spark.range(0, 100, 1, 64)
    assert spread(wide, "id") is wide


def test_counts_come_before_the_join(spark):
    chunks = spark.createDataFrame([("a",)] * 50, "source_id string")
    sources = spark.createDataFrame([("a",), ("b",)], "source_id string")
    rows = {r["source_id"]: r["chunk_count"] for r in store.source_list(sources, chunks).collect()}
    assert rows == {"a": 50, "b": 0}


def test_no_query_is_cut_short():
    for sql in catalog.ORACLES.values():
        assert "TABLESAMPLE" not in sql.upper()
