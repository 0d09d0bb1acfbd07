from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from docquarry.errors import EmbeddingError, ServiceError
from docquarry.functions import embedding as V
from docquarry.operators import embed as E


def vector(spark, text, build):
    return spark.createDataFrame([(text,)], "v string").select(build(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("dim", [32, 384, 50])
def test_sha256(spark, dim):
    digest = hashlib.sha256("grüße".encode()).digest()
    raw = [(digest[i % 32] - 127.5) / 127.5 for i in range(dim)]
    size = sum(x * x for x in raw) ** 0.5
    got = vector(spark, "grüße", lambda v: V.sha256_embedding(v, dim))
    assert got == pytest.approx([x / size for x in raw])


def test_md5(spark):
    digest = hashlib.md5(b"abc").digest()
    got = vector(spark, "abc", lambda v: V.md5_embedding(v, 20))
    assert got == pytest.approx([digest[i % 16] / 255.0 * 2 - 1 for i in range(20)])


def test_codepoints(spark):
    text = "aé😀"
    start = sum(map(ord, text)) % 100
    raw = [(start + i) / 100 for i in range(12)]
    size = sum(x * x for x in raw) ** 0.5
    got = vector(spark, text, lambda v: V.codepoint_embedding(v, 12))
    assert got == pytest.approx([x / size for x in raw])


def test_blank_text_is_an_error_row(spark):
    df = spark.createDataFrame([("x",), (" \n　",), (None,)], "content string")
    rows = E.embed(df, E.native_model("sha256", 32)).collect()
    assert [r["embedding"] is None for r in rows] == [False, True, True]
    assert [r["embedding_error"] for r in rows] == [None, "blank text", "blank text"]


def test_remote_batches_fail_alone(spark):
    def remote(texts):
        if "bad" in texts:
            raise RuntimeError("refused")
        return [[1.0] if t == "short" else [1.0, 2.0] for t in texts]

    model = E.Model("m", 2, remote=remote, retry=E.Retry(attempts=2, first_wait=0.0, longest_wait=0.0))
    df = spark.createDataFrame([("a",), ("bad",), ("short",), (" ",)], "content string").coalesce(1)
    rows = {r["content"]: r for r in E.embed(df, model).collect()}
    assert rows["a"]["embedding"] == [1.0, 2.0]
    assert "refused" in rows["bad"]["embedding_error"]
    assert "dimension 1" in rows["short"]["embedding_error"]
    assert rows[" "]["embedding_error"] == "blank text"


def test_retry_waits_and_gives_up():
    calls, waits = [], []

    def flaky(x):
        calls.append(x)
        if len(calls) < 3:
            raise OSError("busy")
        return "done"

    assert E.Retry(attempts=5).call(flaky, 1, sleep=waits.append) == "done"
    assert len(calls) == 3 and len(waits) == 2 and all(w >= 1.0 for w in waits)
    with pytest.raises(ServiceError):
        E.Retry(attempts=2).call(lambda: 1 / 0, sleep=waits.append)


def test_cache_embeds_misses_only(spark):
    df = spark.createDataFrame([("s", 0, "a"), ("s", 1, "b")], "source string, chunk_index int, content string")
    cache = spark.createDataFrame([], "cache_key string, embedding array<float>")
    model = E.native_model("sha256", 32)
    first, added = E.embed_cached(df, cache, model)
    assert first.count() == 2 and added.count() == 2
    more = df.unionByName(spark.createDataFrame([("s", 2, "c")], df.schema))
    second, new = E.embed_cached(more, added, model)
    assert second.count() == 3 and new.count() == 1
    key = added.where("cache_key like 's:0:%'").first()["cache_key"]
    assert key == "s:0:" + hashlib.sha256(b"a").hexdigest()[:16]


def test_overrides(spark):
    df = E.embed(spark.createDataFrame([("x",), ("y",)], "content string"), E.native_model("sha256", 32))
    given = spark.createDataFrame([("x", [0.0] * 32)], "text string, embedding array<double>")
    rows = {r["content"]: r["embedding"] for r in E.with_overrides(df, given, "content", 32).collect()}
    assert set(rows["x"]) == {0.0} and set(rows["y"]) != {0.0}
    wrong = spark.createDataFrame([("x", [0.0])], "text string, embedding array<double>")
    with pytest.raises(Exception, match="dimension 32"):
        E.with_overrides(df, wrong, "content", 32).collect()


@pytest.mark.parametrize("n,size", [(5, 1), (10, 1), (25, 5), (50, 5), (100, 10), (200, 10), (500, 20), (1000, 20), (2000, 50)])
def test_batch_size(spark, n, size):
    assert spark.range(1).select(E.batch_size(F.lit(n)).alias("s")).first()["s"] == size


def test_model_map(spark):
    chosen = E.load_model_map(["# map", "docs/*.md: small", "'reports/*': large"])
    df = spark.createDataFrame([("docs/a.md",), ("reports/x",), ("other",)], "p string")
    rows = df.select(E.model_for_path(F.col("p"), chosen, "base").alias("m")).collect()
    assert [r["m"] for r in rows] == ["small", "large", "base"]
    with pytest.raises(EmbeddingError):
        E.load_model_map(["no separator"])
    assert E.native_model("sha256", 8).info()["dimension"] == "8"
    assert (E.request_concurrency(8), E.request_concurrency(64), E.request_concurrency(8, 3)) == (12, 32, 3)


def test_prepared_text(spark):
    df = spark.createDataFrame([("T", None, ["a", "b"], "body")], "title string, author string, tags array<string>, c string")
    fields = {"title": F.col("title"), "author": F.col("author"), "tags": F.array_join("tags", ", ")}
    assert df.select(E.prepared_text(F.col("c"), fields).alias("r")).first()["r"] == "title: T\ntags: a, b\n\nbody"
    assert df.select(E.prepared_text(F.col("c"), {}).alias("r")).first()["r"] == "body"
