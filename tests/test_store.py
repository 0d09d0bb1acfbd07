from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docquarry.operators import store as S

DOCS = "doc_id string, source_id string, chunk_order int, content string, metadata map<string,string>"


@pytest.fixture
def kept(spark, tmp_path):
    store = S.DocumentStore(spark, str(tmp_path / "store"), buckets=4)
    rows = [
        ("d3", "s1", 1, "The Quick fox", {"type": "article", "author": "a"}),
        ("d1", "s1", 0, "A lazy dog, a fox", {"type": "article", "author": "b"}),
        ("d2", "s2", 0, "foxes and hounds", {"type": "note", "author": "a"}),
    ]
    store.add_documents(spark.createDataFrame(rows, DOCS))
    sources = [("s1", "/s1", 10, 1.0, {"k": "v"}), ("s2", "/s2", None, 2.0, {})]
    store.add_sources(
        spark.createDataFrame(
            sources,
            "source_id string, location string, size_bytes bigint, indexed_at double, metadata map<string,string>",
        )
    )
    return store


def ids(df, key="doc_id"):
    return sorted(r[key] for r in df.select(key).collect())


def frame(spark, values, key="doc_id"):
    return spark.createDataFrame([(v,) for v in values], f"{key} string")


def test_crud(spark, kept):
    assert [r["doc_id"] for r in kept.list_document_ids().collect()] == ["d1", "d2", "d3"]
    assert kept.count_documents() == 3
    assert kept.document_exists("d1") and not kept.document_exists("zz")
    assert ids(kept.get_documents_by_ids(frame(spark, ["d2", "zz"]))) == ["d2"]
    new = spark.createDataFrame([("d2", "s2", 0, "changed", {})], DOCS)
    kept.add_documents(new)
    kept.add_documents(new)
    assert kept.count_documents() == 3
    assert kept.get_document("d2").first()["content"] == "changed"
    status = kept.delete_documents(frame(spark, ["d1", "d3", "nothing"]))
    assert {r["doc_id"]: r["deleted"] for r in status.collect()} == {"d1": True, "d3": True, "nothing": False}
    assert ids(kept.chunks.read()) == ["d2"]
    kept.add_documents(spark.createDataFrame([("d1", "s1", 0, "back", {})], DOCS))
    assert ids(kept.chunks.read()) == ["d1", "d2"]


def test_emptied_buckets_stay_empty(spark, kept, tmp_path):
    kept.delete_documents(frame(spark, ["d1", "d2", "d3"]))
    assert kept.count_documents() == 0
    assert kept.chunks.purge(str(tmp_path / "compact")).read().count() == 0


def test_search(kept):
    assert ids(kept.search_documents("fox")) == ["d1", "d3"]
    assert ids(kept.search_documents("FOX lazy")) == ["d1"]
    assert ids(kept.search_documents("fox", mode="substring")) == ["d1", "d2", "d3"]
    assert ids(kept.search_documents(metadata_filter={"type": "article"})) == ["d1", "d3"]
    assert ids(kept.search_documents(metadata_filter={"type": "article", "author": "a"})) == ["d3"]
    assert ids(kept.search_documents(limit=2)) == ["d1", "d2"]
    assert ids(kept.search_documents(metadata_filter={"author": "a"}, limit=1, limit_first=True)) == []
    assert ids(kept.search_documents(metadata_filter={"author": "a"}, limit=1)) == ["d2"]
    assert len(ids(kept.search_documents(limit=0))) == 3


def test_sources(spark, kept):
    listed = kept.list_sources().collect()
    assert [(r["source_id"], r["chunk_count"]) for r in listed] == [("s2", 1), ("s1", 2)]
    assert kept.get_source("s1").first()["chunk_count"] == 2
    assert [r["doc_id"] for r in kept.source_chunks("s1").collect()] == ["d1", "d3"]
    kept.update_source_metadata(
        spark.createDataFrame([("s1", {"k": "w", "n": "1"})], "source_id string, metadata map<string,string>")
    )
    assert kept.sources.get(["s1"]).first()["metadata"] == {"k": "w", "n": "1"}
    kept.remove_sources(frame(spark, ["s1"], "source_id"))
    assert ids(kept.sources.read(), "source_id") == ["s2"] and ids(kept.chunks.read()) == ["d2"]
    kept.clear_catalog()
    assert kept.sources.read().count() == 0 and kept.count_documents() == 1
    kept.clear()
    assert kept.count_documents() == 0


def test_settings(kept):
    assert kept.get_setting("a") is None
    kept.set_setting("a", "1")
    kept.set_setting("a", "2")
    kept.set_setting("b", "3")
    assert (kept.get_setting("a"), kept.get_setting("b")) == ("2", "3")


def test_listing(kept):
    listed = kept.list_sources()
    assert S.index_stats(listed).first().asDict() == {"document_count": 2, "total_size": 10, "chunk_count": 3}
    shown = {r["file_path"]: r for r in S.display_listing(listed).collect()}
    assert shown["/s1"]["size"] == "0.0 KB" and shown["/s2"]["size"] == "N/A"
    assert shown["/s1"]["last_modified"] == "N/A"
    assert [r["file_path"] for r in S.largest_sources(listed, 1).collect()] == ["/s1"]


def test_size_label_rounds_half_to_even(spark):
    df = spark.createDataFrame([(19712,), (1024,)], "n bigint").select(S.size_label(F.col("n")).alias("s"))
    assert [r["s"] for r in df.collect()] == [f"{19712 / 1024:.1f} KB", "1.0 KB"]


def test_generated_ids(spark):
    df = spark.createDataFrame([(0, None), (1, "own")], "i int, given string")
    assert ids(S.generated_ids(df, "i", "given")) == ["doc_0", "own"]


def test_one_source_touches_one_bucket(spark, kept, tmp_path):
    root = tmp_path / "store" / "chunks"

    def files():
        return {p.relative_to(root).parts[0]: sorted(q.name for q in p.glob("*.parquet")) for p in root.glob("bucket=*")}

    before = files()
    assert len(before) == 2
    kept.add_documents(spark.createDataFrame([("d2", "s2", 0, "changed", {})], DOCS))
    after = files()
    assert sum(before[b] != after[b] for b in before) == 1
    kept.remove_sources(frame(spark, ["s2"], "source_id"))
    assert sum(after[b] != n for b, n in files().items()) == 1
    assert ids(kept.chunks.read()) == ["d1", "d3"]
    # a source that replaces nothing is appended
    held = files()
    kept.add_documents(spark.createDataFrame([("n1", "s1", 2, "more", {})], DOCS))
    assert all(set(held[b]) <= set(n) for b, n in files().items())


def test_an_id_moves_to_another_source(spark, kept):
    kept.add_documents(spark.createDataFrame([("d2", "s1", 2, "moved", {})], DOCS))
    rows = {r["doc_id"]: r["source_id"] for r in kept.chunks.read().collect()}
    assert rows == {"d1": "s1", "d2": "s1", "d3": "s1"}


def test_one_source_reads_one_bucket(kept):
    plan = kept.chunks.of_value("s1")._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters") :].split("]")[0]
    assert "bucket" in filters
    assert "d2" not in ids(kept.source_chunks("s1"))
