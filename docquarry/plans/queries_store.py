"""Queries on the document store, the catalog and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.config import ChunkSettings, EngineConfig
from docquarry.operators import chunking, store
from docquarry.operators import embed as E
from docquarry.plans.catalog import PATH, documents, query, texts
from docquarry.session import scratch_path
from docquarry.sources.tables import read_table
from docquarry.streaming.ingest import embed_stream, index_stream


def labels(spark, folder):
    return read_table(spark, folder, "labels")


def toxic_ids(spark, folder):
    return labels(spark, folder).where("toxic = 1").select("doc_id")


def as_chunks(spark, folder):
    return documents(spark, folder).select(
        F.col("doc_id").cast("string").alias("doc_id"),
        F.col("source").alias("source_id"),
        F.col("text").alias("content"),
    )


def stored_documents(spark, folder):
    """A new store that holds all documents."""
    kept = store.DocumentStore(spark, scratch_path(spark, "store"), buckets=8)
    kept.add_documents(as_chunks(spark, folder))
    return kept


def catalog(spark, folder):
    """Every ``source`` value as a catalog source, its documents as chunks."""
    docs = documents(spark, folder)
    chunks = docs.select(
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("chunk_order"),
        F.col("text").alias("content"),
    )
    sources = docs.groupBy("source").agg(F.sum("n_chars").alias("size_bytes")).select(
        F.col("source").alias("source_id"),
        F.concat(F.lit("/docs/"), "source").alias("location"),
        F.lit(None).cast("string").alias("content_type"),
        "size_bytes",
        F.col("size_bytes").cast("double").alias("last_modified"),
        F.lit(1.0).alias("indexed_at"),
        F.create_map(F.lit("tokenizer"), F.lit("words")).alias("metadata"),
    )
    return sources, chunks


@query(
    """SELECT doc_id, md5(CASE WHEN quality = 1 THEN 'new ' || text ELSE text END) AS content_md5
       FROM documents LEFT JOIN labels USING (doc_id)"""
)
def store_upsert(spark, folder):
    """Good documents arrive again with new content."""
    docs = documents(spark, folder).select("doc_id", "text")
    good = labels(spark, folder).where("quality = 1")
    changed = docs.join(good, "doc_id", "left_semi").withColumn("text", F.concat(F.lit("new "), "text"))
    merged = store.upsert(docs, changed, "doc_id")
    return merged.select("doc_id", F.md5("text").alias("content_md5"))


@query(
    """SELECT user_id, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM events GROUP BY user_id"""
)
def latest_version(spark, folder):
    """The last version per key wins."""
    events = read_table(spark, folder, "events").select("user_id", "ts", "event_id")
    return store.latest(events, "user_id", "ts").select("user_id", "ts", "event_id")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def store_delete(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    return store.delete_rows(docs, toxic_ids(spark, folder), "doc_id").select("doc_id")


@query(
    """SELECT p_partkey AS doc_id, (p_partkey IN (SELECT doc_id FROM documents))::INT AS deleted FROM part"""
)
def delete_status(spark, folder):
    """Whether each id asked to be deleted was there."""
    ids = read_table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"))
    status = store.delete_status(documents(spark, folder).select("doc_id"), ids, "doc_id")
    return status.select("doc_id", F.col("deleted").cast("int").alias("deleted"))


@query(
    """SELECT doc_id, md5(text) AS content_md5 FROM documents
       WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def in_list_lookup(spark, folder):
    docs = documents(spark, folder).select("doc_id", "text")
    found = store.lookup(docs, toxic_ids(spark, folder), "doc_id")
    return found.select("doc_id", F.md5("text").alias("content_md5"))


@query(
    """SELECT event_id, CASE WHEN event_type = 'error' THEN json_extract_string(props, '$.k')
              ELSE 'doc_' || event_id END AS doc_id FROM events"""
)
def generated_ids(spark, folder):
    """Ids from the metadata, made from the position where there is none."""
    events = read_table(spark, folder, "events").withColumn(
        "given", F.when(F.col("event_type") == "error", F.get_json_object("props", "$.k"))
    )
    return store.generated_ids(events, "event_id", "given").select("event_id", "doc_id")


@query("SELECT doc_id FROM documents WHERE text ILIKE '%AUlich%'")
def search_ilike(spark, folder):
    docs = texts(spark, folder)
    return store.search(docs, match=store.contains_text(F.col("text"), "AUlich")).select("doc_id")


@query(
    """SELECT doc_id FROM documents
       WHERE list_has_all(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ['the', 'with', 'for'])"""
)
def search_terms_and(spark, folder):
    """Documents that hold all words of the query."""
    docs = texts(spark, folder)
    match = store.has_all_terms(F.col("text"), "The WITH for")
    return store.search(docs, match=match).select("doc_id")


@query(
    """SELECT doc_id FROM (SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 50) WHERE lang = 'de'"""
)
def limit_then_filter(spark, folder):
    """The store's rule: the limit comes before the metadata filter."""
    found = store.search(
        documents(spark, folder).select("doc_id", "lang"), where=F.col("lang") == "de", limit=50
    )
    return found.select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY doc_id LIMIT 50")
def filter_then_limit(spark, folder):
    found = store.search(
        documents(spark, folder).select("doc_id", "lang"),
        where=F.col("lang") == "de",
        limit=50,
        limit_first=False,
    )
    return found.select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang = 'fr' AND source = 'src3'")
def metadata_scan(spark, folder):
    """Equality on several metadata keys."""
    docs = documents(spark, folder).select(
        "doc_id", chunking.metadata_map({"lang": F.col("lang"), "source": F.col("source")}).alias("metadata")
    )
    return docs.where(store.metadata_equals({"lang": "fr", "source": "src3"})).select("doc_id")


@query("SELECT doc_id, md5(text) AS content_md5 FROM documents WHERE doc_id = 7")
def point_lookup(spark, folder):
    found = stored_documents(spark, folder).get_document("7")
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5("content").alias("content_md5"))


@query("SELECT doc_id FROM documents ORDER BY doc_id")
def document_ids(spark, folder):
    ids = stored_documents(spark, folder).list_document_ids()
    return ids.select(F.col("doc_id").cast("bigint").alias("doc_id"))


@query("SELECT count(*) AS documents FROM documents")
def document_count(spark, folder):
    return stored_documents(spark, folder).document_total()


@query(
    """SELECT o_orderkey AS source_id, count(l_orderkey) AS chunk_count
       FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey"""
)
def source_chunk_counts(spark, folder):
    """Children per parent, parents without any included."""
    sources = read_table(spark, folder, "orders").select(F.col("o_orderkey").alias("source_id"))
    chunks = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("source_id"))
    return store.source_list(sources, chunks)


@query(
    """SELECT l_orderkey AS source_id, l_linenumber AS chunk_order, l_partkey AS content
       FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')"""
)
def ordered_chunks(spark, folder):
    """Children of some parents in order; the composite sort splits a parent of any size."""
    sources = (
        read_table(spark, folder, "orders")
        .where("o_orderstatus = 'F'")
        .select(F.col("o_orderkey").alias("source_id"))
    )
    chunks = read_table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("source_id"),
        F.col("l_linenumber").alias("chunk_order"),
        F.col("l_partkey").alias("content"),
    )
    return store.ordered_chunks(chunks, sources)


@query(
    """SELECT source AS source_id, count(*) AS chunk_count FROM documents
       WHERE source NOT IN ('src3', 'src7') GROUP BY source"""
)
def cascade_delete(spark, folder):
    """Sources and their chunks go together."""
    sources, chunks = catalog(spark, folder)
    gone = sources.where(F.col("source_id").isin("src3", "src7")).select("source_id")
    kept = store.delete_rows(sources, gone, "source_id")
    left = store.delete_rows(chunks, gone, "source_id")
    return store.source_list(kept, left).select("source_id", "chunk_count")


@query(
    """SELECT '/docs/' || source AS file_path, 'unknown' AS file_type, count(*) AS num_chunks,
              sum(n_chars)::BIGINT AS file_size, sum(n_chars)::DOUBLE AS last_modified, 'words' AS tokenizer,
              '' AS text_splitter
       FROM documents GROUP BY source"""
)
def file_listing(spark, folder):
    """Indexed files with defaults for unknown values."""
    listed = store.file_listing(store.source_list(*catalog(spark, folder)))
    return listed.select(
        "file_path", "file_type", "num_chunks", "file_size", "last_modified", "tokenizer", "text_splitter"
    )


@query(
    """SELECT '/docs/' || source AS file_path, 'text/plain' AS file_type,
              strftime(make_timestamp(sum(n_chars)::BIGINT * 1000000), '%Y-%m-%d %H:%M:%S') AS last_modified,
              printf('%.1f KB', sum(n_chars) / 1024.0) AS size, count(*) AS chunks
       FROM documents GROUP BY source"""
)
def display_listing(spark, folder):
    return store.display_listing(store.source_list(*catalog(spark, folder)))


@query(
    """SELECT '/docs/' || source AS file_path, 'text/plain' AS file_type,
              'Document with ' || count(*) || ' chunks' AS summary, count(*) AS num_chunks
       FROM documents GROUP BY source ORDER BY sum(n_chars) DESC, source LIMIT 5"""
)
def largest_sources(spark, folder):
    return store.largest_sources(store.source_list(*catalog(spark, folder)), 5)


@query(
    """SELECT count(DISTINCT source) AS document_count, sum(n_chars)::BIGINT AS total_size,
              count(*) AS chunk_count FROM documents"""
)
def index_stats(spark, folder):
    return store.index_stats(store.source_list(*catalog(spark, folder)))


@query("SELECT DISTINCT o_custkey AS id FROM orders INTERSECT SELECT doc_id FROM documents")
def already_indexed(spark, folder):
    """Indexed before and seen again in this run."""
    before = documents(spark, folder).select(F.col("doc_id").alias("id"))
    now = read_table(spark, folder, "orders").select(F.col("o_custkey").alias("id"))
    return now.intersect(before)


@query(
    """SELECT doc_id, lang AS kept, CASE WHEN toxic = 1 THEN 'flagged' ELSE source END AS source,
              quality::VARCHAR AS quality
       FROM documents LEFT JOIN labels USING (doc_id)"""
)
def metadata_merge(spark, folder):
    """New values replace old ones, other keys stay."""
    docs = documents(spark, folder)
    old = chunking.metadata_map({"lang": F.col("lang"), "source": F.col("source")})
    changes = chunking.metadata_map(
        {"quality": F.col("quality"), "source": F.when(F.col("toxic") == 1, F.lit("flagged"))}
    )
    joined = docs.join(labels(spark, folder), "doc_id", "left")
    merged = joined.select("doc_id", store.merge_metadata(old, changes).alias("m"))
    return merged.select(
        "doc_id",
        *[
            F.try_element_at("m", F.lit(key)).alias(name)
            for key, name in (("lang", "kept"), ("source", "source"), ("quality", "quality"))
        ],
    )


@query(
    """SELECT doc_id::VARCHAR AS doc_id, md5(CASE WHEN quality = 1 THEN 'new ' || text ELSE text END) AS content_md5
       FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0"""
)
def stored_round_trip(spark, folder):
    """Write all documents, upsert the good ones, delete the toxic ones, read back."""
    kept = stored_documents(spark, folder)
    docs = as_chunks(spark, folder)
    marks = labels(spark, folder).withColumn("doc_id", F.col("doc_id").cast("string"))
    good = docs.join(marks.where("quality = 1"), "doc_id", "left_semi")
    kept.add_documents(good.withColumn("content", F.concat(F.lit("new "), "content")))
    kept.delete_documents(marks.where("toxic = 1").select("doc_id"))
    return kept.chunks.read().select("doc_id", F.md5("content").alias("content_md5"))


@query(
    """SELECT path AS source_id, 'text/plain' AS content_type,
              greatest(1, (len(regexp_extract_all(text, '\\S+')) + 9999) // 10000) AS chunk_count
       FROM files""",
    ("files",),
)
def stream_ingest(spark, folder):
    """Documents arrive as a stream and are indexed batch by batch."""
    from docquarry.engine import Engine

    root = scratch_path(spark, "stream")
    config = EngineConfig(
        f"{root}/store",
        embedding_dim=32,
        chunks=ChunkSettings(size=10_000, overlap=0),
        buckets=8,
    )
    engine = Engine(spark, config)
    schema = documents(spark, folder).schema
    arriving = spark.readStream.schema(schema).parquet(f"{folder}/documents*.parquet")
    sources = arriving.select(
        F.expr(PATH).alias("source_id"),
        F.expr(PATH).alias("location"),
        F.lit("text/plain").alias("content_type"),
        "text",
        F.sha2("text", 256).alias("content_hash"),
        F.col("n_chars").alias("size_bytes"),
        F.lit(None).cast("double").alias("last_modified"),
    )
    index_stream(sources, engine, f"{root}/checkpoint").awaitTermination()
    return engine.store.list_sources().select("source_id", "content_type", "chunk_count")


@query(
    """SELECT conv_id, turn, round((v[1] / n)::FLOAT::DOUBLE, 6) AS v0 FROM (
         SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
           SELECT conv_id, turn, list_transform(range(0, 32), lambda i:
             (('0x' || substr(sha256(text), 1 + 2 * i, 2))::INT - 127.5) / 127.5) AS v FROM conversations))"""
)
def stream_embedding(spark, folder):
    """Vectors made by a stream stay beside the keys of their texts."""
    root = scratch_path(spark, "embedded")
    schema = read_table(spark, folder, "conversations").schema
    turns = spark.readStream.schema(schema).parquet(f"{folder}/conversations*.parquet")
    made = embed_stream(turns, E.native_model("sha256", 32), "text")
    running = (
        made.select("conv_id", "turn", "embedding")
        .writeStream.format("parquet")
        .option("path", f"{root}/vectors")
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    stored = spark.read.parquet(f"{root}/vectors")
    first = F.get("embedding", F.lit(0)).cast("double")
    return stored.select("conv_id", "turn", F.round(first, 6).alias("v0"))
