"""Queries on indexing, change detection and embedding."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.config import ChunkSettings, EngineConfig
from docquarry.errors import ServiceError
from docquarry.functions import embedding as V
from docquarry.functions.text import first_short_line, split_tokens
from docquarry.operators import changes, chunking, embed
from docquarry.plans import ingest
from docquarry.plans.catalog import documents, file_documents, query, texts
from docquarry.plans.queries_sources import TITLE_SQL
from docquarry.session import scratch_path
from docquarry.sources.tables import read_table, text_sources


@query(
    """SELECT source || '/' || doc_id || '#chunk' || chunk_index AS doc_id,
              source || '/' || doc_id AS source_id, chunk_index AS chunk_order, sha256(content) AS chunk_hash
       FROM windows""",
    ("windows",),
)
def chunk_links(spark, folder):
    """Chunk ids and their order below the source."""
    docs = texts(spark, folder).select(F.expr("source || '/' || doc_id").alias("source_id"), "text")
    chunks = chunking.char_windows(docs)
    return chunks.select(
        ingest.chunk_id(F.col("source_id"), F.col("chunk_index")).alias("doc_id"),
        "source_id",
        F.col("chunk_index").alias("chunk_order"),
        F.sha2("content", 256).alias("chunk_hash"),
    )


@query(
    """SELECT path AS source_id, path AS location, sha256(text) AS content_hash, length(text) AS size_bytes,
              1700000000.0::DOUBLE AS indexed_at, '200' AS chunk_size, 'sha256' AS embedding_model,
              lang AS lang
       FROM files""",
    ("files",),
)
def source_rows(spark, folder):
    """Catalog rows with the settings a source was indexed under."""
    files = file_documents(spark, folder)
    sources = text_sources(
        files, F.col("source_id"), F.col("text"), F.col("content_type"), lang=F.col("lang")
    )
    config = EngineConfig("unused", chunks=ChunkSettings(size=200, overlap=40))
    rows = ingest.source_rows(sources, config, 1_700_000_000.0)
    return rows.select(
        "source_id",
        "location",
        "content_hash",
        "size_bytes",
        "indexed_at",
        *[
            F.try_element_at("metadata", F.lit(k)).alias(k)
            for k in ("chunk_size", "embedding_model", "lang")
        ],
    )


@query(
    """SELECT count(*) AS loaded, count(*) FILTER (n_chars >= 500) AS long_enough,
              count(*) FILTER (n_chars >= 500 AND quality = 1) AS good,
              count(*) FILTER (n_chars >= 500 AND quality = 1 AND toxic = 0) AS kept
       FROM documents LEFT JOIN labels USING (doc_id)"""
)
def filter_chain_counts(spark, folder):
    """How many documents pass the filters, one after the other."""
    docs = documents(spark, folder).select("doc_id", "n_chars")
    joined = docs.join(read_table(spark, folder, "labels"), "doc_id", "left")
    tests = [F.col("n_chars") >= 500, F.col("quality") == 1, F.col("toxic") == 0]
    passed = [tests[0], tests[0] & tests[1], tests[0] & tests[1] & tests[2]]
    names = ["long_enough", "good", "kept"]
    return joined.agg(
        F.count(F.lit(1)).alias("loaded"),
        *[F.count_if(p).alias(n) for p, n in zip(passed, names, strict=True)],
    )


@query(
    """SELECT doc_id, title FROM (
         SELECT doc_id, trim(string_split(text, chr(10))[1]) AS title
         FROM documents JOIN labels USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars >= 500)"""
)
def content_filters(spark, folder):
    """Documents that pass every filter; unlabelled ones do not."""
    joined = texts(spark, folder).join(read_table(spark, folder, "labels"), "doc_id")
    tests = [F.col("quality") == 1, F.col("toxic") == 0, F.col("n_chars") >= 500]
    title = F.trim(F.get(F.split("text", "\n"), F.lit(0)))
    return changes.content_filter(joined, tests).select("doc_id", title.alias("title"))


@query(
    """SELECT source, count(*) AS documents, sum((r = 1)::INT)::BIGINT AS kept FROM (
         SELECT source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS r
         FROM documents)
       GROUP BY source"""
)
def dedup_counts(spark, folder):
    """Documents per source before and after dropping exact copies within the source."""
    docs = texts(spark, folder).select("source", "doc_id", "text")
    kept = changes.keep_first(docs, ["source"], "text", "doc_id")
    before = docs.groupBy("source").agg(F.count(F.lit(1)).alias("documents"))
    after = kept.groupBy("source").agg(F.count(F.lit(1)).alias("kept"))
    return before.join(after, "source")


@query(
    """SELECT doc_id, chunk_index, md5(content) AS content_md5 FROM (
         SELECT doc_id, w.s // 120 AS chunk_index, substr(text, w.s + 1, 120) AS content
         FROM documents, LATERAL (SELECT unnest(range(0, length(text), 120)) AS s) w)
       QUALIFY row_number() OVER (PARTITION BY doc_id, content ORDER BY chunk_index) = 1"""
)
def dedup_exact(spark, folder):
    """First of the equal chunks of each document."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.char_windows(docs, size=120, overlap=0).drop("text")
    kept = changes.keep_first(chunks, ["doc_id"])
    return kept.select("doc_id", "chunk_index", F.md5("content").alias("content_md5"))


@query(
    """SELECT p.p_partkey::VARCHAR AS source_id, 'loading' AS stage, 'not found' AS error_message
       FROM part p WHERE p.p_partkey NOT IN (SELECT doc_id FROM documents)"""
)
def load_errors(spark, folder):
    """Requested ids without a document become error rows."""
    asked = read_table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"))
    found = documents(spark, folder).select("doc_id")
    return asked.join(found, "doc_id", "left_anti").select(
        F.col("doc_id").cast("string").alias("source_id"),
        F.lit("loading").alias("stage"),
        F.lit("not found").alias("error_message"),
    )


@query(
    """WITH old AS (
         SELECT d.doc_id::VARCHAR AS source_id, sha256(CASE WHEN toxic = 1 THEN upper(text) ELSE text END) AS h,
                CASE WHEN quality = 0 THEN 500 ELSE 1000 END AS chunk_size
         FROM documents d JOIN labels USING (doc_id))
       SELECT d.doc_id::VARCHAR AS source_id,
              CASE WHEN o.source_id IS NULL THEN 'new' WHEN o.h <> sha256(d.text) THEN 'content'
                   WHEN o.chunk_size <> 1000 THEN 'chunking' ELSE 'current' END AS reason
       FROM documents d LEFT JOIN old o ON o.source_id = d.doc_id::VARCHAR"""
)
def reindex_diff(spark, folder):
    """What must be indexed again: labelled documents are indexed, the toxic ones with another
    text, those of low quality with another chunk size."""
    docs = texts(spark, folder).withColumn("source_id", F.col("doc_id").cast("string"))
    labelled = docs.join(read_table(spark, folder, "labels"), "doc_id")
    text = F.when(F.col("toxic") == 1, F.upper("text")).otherwise(F.col("text"))
    indexed = labelled.select(
        "source_id",
        F.sha2(text, 256).alias("content_hash"),
        F.lit(1.0).alias("last_modified"),
        F.when(F.col("quality") == 0, 500).otherwise(1000).alias("chunk_size"),
        F.lit(200).alias("chunk_overlap"),
        F.lit("sha256").alias("embedding_model"),
        F.lit("1").alias("embedding_model_version"),
    )
    incoming = docs.select(
        "source_id", F.sha2("text", 256).alias("content_hash"), F.lit(1.0).alias("last_modified")
    )
    judged = changes.reindex_reasons(
        incoming, indexed, chunk_size=1000, chunk_overlap=200, model="sha256", model_version="1"
    )
    return judged.select("source_id", F.coalesce("reason", F.lit("current")).alias("reason"))


@query(
    """WITH new AS (SELECT DISTINCT doc_id, sha256(content) AS h FROM windows),
       old AS (SELECT DISTINCT doc_id, sha256(CASE WHEN toxic = 1 THEN upper(content) ELSE content END) AS h
               FROM windows JOIN labels USING (doc_id))
       SELECT coalesce(n.doc_id, o.doc_id)::VARCHAR AS source_id,
              CASE WHEN o.h IS NULL THEN 'new' WHEN n.h IS NULL THEN 'gone' ELSE 'kept' END AS status,
              count(*) AS chunks
       FROM new n FULL JOIN old o ON n.doc_id = o.doc_id AND n.h = o.h GROUP BY ALL""",
    ("windows",),
)
def incremental_chunks(spark, folder):
    """Chunks to embed, to keep and to delete when the texts of toxic documents changed."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.char_windows(docs).select(F.col("doc_id").cast("string").alias("source_id"), "content")
    labels = read_table(spark, folder, "labels").select(
        F.col("doc_id").cast("string").alias("source_id"), "toxic"
    )
    before = F.when(F.col("toxic") == 1, F.upper("content")).otherwise(F.col("content"))
    stored = chunks.join(labels, "source_id").select("source_id", F.sha2(before, 256).alias("chunk_hash"))
    incoming = chunks.select("source_id", F.sha2("content", 256).alias("chunk_hash"))
    return (
        changes.chunk_changes(incoming, stored)
        .groupBy("source_id", "status")
        .agg(F.count(F.lit(1)).alias("chunks"))
    )


def by_line(part):
    """A custom parser: every line is a chunk."""
    lines = part.select("source_id", "location", "content_type", F.posexplode(F.split("text", "\n")))
    return lines.select(
        "source_id",
        "location",
        "content_type",
        F.col("pos").alias("chunk_index"),
        F.col("col").alias("content"),
    )


def transformed(spark, folder, types):
    """Custom parser for some content types, an extracted column, a filter and deduplication."""
    steps = ingest.Transforms(
        parsers=dict.fromkeys(types, by_line),
        extractors={"n_words": F.size(split_tokens(F.col("content")))},
        filters=[F.length("content") >= 20],
        deduplicate=True,
    )
    docs = file_documents(spark, folder).select("source_id", "location", "content_type", "text")
    config = EngineConfig("unused", chunks=ChunkSettings(size=200, overlap=40))
    return ingest.transform(docs, config, steps)


@query()
def transform_with_steps(spark, folder):
    """All optional steps, with a parser for one type and the splitters for the others."""
    return transformed(spark, folder, ["text/csv"])


@query(
    """WITH lines AS (
         SELECT path AS source_id, u.i - 1 AS chunk_index, u.line AS content FROM files,
           LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                    generate_subscripts(string_split(text, chr(10)), 1) AS i) u)
       SELECT source_id, chunk_index, md5(content) AS content_md5,
              len(regexp_extract_all(content, '\\S+')) AS n_words
       FROM lines WHERE length(content) >= 20
       QUALIFY row_number() OVER (PARTITION BY source_id, content ORDER BY chunk_index) = 1""",
    ("files",),
)
def custom_parser(spark, folder):
    """The same steps with the parser for every content type."""
    types = ["text/markdown", "text/plain", "text/html", "text/csv"]
    chunks = transformed(spark, folder, types)
    return chunks.select("source_id", "chunk_index", F.md5("content").alias("content_md5"), "n_words")


def _hash_sql(function: str, text: str, width: int, value: str) -> str:
    return (
        f"list_transform(range(0, {width}), lambda i: "
        + value.format(b=f"('0x' || substr({function}({text}), 1 + 2 * i, 2))::INT")
        + ")"
    )


def _whole_sql(value: str, dim: int) -> str:
    """Digest of all places of a vector, in ten-thousandths."""
    places = f"list_transform(range(0, {dim}), lambda i: floor({value} * 10000 + 0.37)::BIGINT::VARCHAR)"
    return f"md5(array_to_string({places}, ','))"


def whole(vector):
    """As :func:`_whole_sql`; the offset keeps the bounds of the steps away from round values."""
    places = F.transform(vector, lambda x: F.floor(x.cast("double") * 10000 + 0.37).cast("string"))
    return F.md5(F.array_join(places, ",").cast("binary")).alias("vector_md5")


@query(
    f"""SELECT doc_id, {_whole_sql('v[1 + i % 32] / n', 384)} AS vector_md5
        FROM (SELECT *, sqrt(12 * list_sum(list_transform(v, lambda x: x * x))) AS n FROM (
               SELECT doc_id, {_hash_sql("sha256", "text", 32, "({b} - 127.5) / 127.5")} AS v
               FROM documents))"""
)
def hash_embedding(spark, folder):
    """SHA-256 embedding of whole texts, dimension 384."""
    return texts(spark, folder).select("doc_id", whole(V.sha256_embedding(F.col("text"))))


@query(
    f"""SELECT doc_id, {_whole_sql('v[1 + i % 16]', 1536)} AS vector_md5
        FROM (SELECT doc_id, {_hash_sql("md5", "text", 16, "{b} / 255.0 * 2.0 - 1.0")} AS v FROM documents)"""
)
def md5_embedding(spark, folder):
    return texts(spark, folder).select("doc_id", whole(V.md5_embedding(F.col("text"))))


@query(
    f"""SELECT doc_id, p AS pattern, {_whole_sql('(p + i) / 100.0 / n', 384)} AS vector_md5
       FROM (SELECT *, sqrt(list_sum(list_transform(range(0, 384), lambda i: ((p + i) / 100.0) ** 2))) AS n
             FROM (SELECT doc_id, (list_sum(list_transform(string_split(text, ''), lambda c: unicode(c)))
                                   % 100)::BIGINT AS p FROM documents))"""
)
def codepoint_embedding(spark, folder):
    text = F.col("text")
    return texts(spark, folder).select(
        "doc_id", V.codepoint_pattern(text).alias("pattern"), whole(V.codepoint_embedding(text))
    )


@query(
    f"""SELECT doc_id, md5('title: ' || coalesce({TITLE_SQL}, '') || chr(10) || 'source: ' || source || chr(10)
               || 'tags: ' || lang || ', ' || source || chr(10) || chr(10) || text) AS prepared_md5
        FROM documents"""
)
def embedding_text(spark, folder):
    """Metadata lines in front of the text; lists are joined by commas."""
    fields = {
        "title": F.coalesce(first_short_line(F.col("text")), F.lit("")),
        "source": F.col("source"),
        "tags": F.array_join(F.array("lang", "source"), ", "),
    }
    prepared = embed.prepared_text(F.col("text"), fields)
    return texts(spark, folder).select("doc_id", F.md5(prepared).alias("prepared_md5"))


@query(
    """SELECT md5(substr(text, 1, 1000)) AS text_md5, source, '' AS source_id, chunk_index, chunk_total AS
              total_chunks, lang AS category
       FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index,
                    count(*) OVER (PARTITION BY doc_id) AS chunk_total
             FROM (SELECT doc_id, source, lang, w.s, substr(d.text, w.s + 1, 3000) AS text FROM documents d,
                   LATERAL (SELECT unnest(range(0, length(d.text), 2500)) AS s) w))"""
)
def vector_metadata(spark, folder):
    """What is stored beside a vector: a preview, defaults and the known keys."""
    docs = texts(spark, folder).select("doc_id", "source", F.col("lang").alias("category"), "text")
    chunks = chunking.char_windows(docs, size=3000, overlap=500)
    rows = embed.vector_metadata(chunks.withColumnRenamed("chunk_total", "total_chunks"))
    return rows.withColumn("text", F.md5("text")).withColumnRenamed("text", "text_md5")


@query(
    """SELECT user_id, count(*) AS n, CASE WHEN count(*) <= 10 THEN 1 WHEN count(*) <= 50 THEN 5
              WHEN count(*) <= 200 THEN 10 WHEN count(*) <= 1000 THEN 20 ELSE 50 END AS batch_size
       FROM events GROUP BY user_id"""
)
def batch_plan(spark, folder):
    """Request size by the number of texts."""
    counts = read_table(spark, folder, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("batch_size", embed.batch_size(F.col("n")))


@query(
    """SELECT path, CASE WHEN regexp_matches(path, '^src1/.*\\.md$') THEN 'small'
              WHEN regexp_matches(path, '^src[2-4]/.*$') THEN 'large'
              WHEN regexp_matches(path, '^src1./.*$') THEN 'other' ELSE 'default' END AS model
       FROM files""",
    ("files",),
)
def model_map(spark, folder):
    """First glob that matches the path decides the embedding model."""
    wanted = {"src1/*.md": "small", "src[2-4]/*": "large", "src1?/*": "other"}
    files = file_documents(spark, folder).select(F.col("source_id").alias("path"))
    return files.withColumn("model", embed.model_for_path(F.col("path"), wanted, "default"))


@query(
    """SELECT doc_id, 0 AS failed, length(text)::DOUBLE AS v0, len(regexp_extract_all(text, '\\S+'))::DOUBLE AS v1
       FROM documents"""
)
def remote_embedding(spark, folder):
    """A remote model called with batches of texts from the tasks."""

    def measure(texts):
        return [[float(len(t)), float(len(t.split()))] for t in texts]

    model = embed.Model("measure", 2, remote=measure)
    made = embed.embed(texts(spark, folder).select("doc_id", "text"), model, "text")
    return made.select(
        "doc_id",
        F.col("embedding_error").isNotNull().cast("int").alias("failed"),
        *[F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in (0, 1)],
    )


@query(
    """SELECT doc_id, chunk_index, (doc_id IN (SELECT doc_id FROM labels))::INT AS cached,
              source || ':' || chunk_index || ':' || substr(sha256(content), 1, 16) AS cache_key
       FROM windows""",
    ("windows",),
)
def embedding_cache(spark, folder):
    """Chunks of labelled documents come from the cache, the others are embedded."""
    docs = texts(spark, folder).select("doc_id", "source", "text")
    chunks = chunking.char_windows(docs).select("doc_id", "source", "chunk_index", "content")
    model = embed.native_model("sha256", 32)
    labelled = chunks.join(read_table(spark, folder, "labels"), "doc_id", "left_semi")
    key = embed.cache_key(F.concat_ws("/", "source", "doc_id"), F.col("chunk_index"), F.col("content"))
    cache = labelled.select(key.alias("cache_key"), F.array(F.lit(0.0)).cast("array<float>").alias("embedding"))
    keyed = chunks.withColumn("place", F.concat_ws("/", "source", "doc_id"))
    made, _ = embed.embed_cached(keyed, cache, model, source="place")
    plain = embed.cache_key(F.col("source"), F.col("chunk_index"), F.col("content"))
    return made.select(
        "doc_id",
        "chunk_index",
        (F.size("embedding") == 1).cast("int").alias("cached"),
        plain.alias("cache_key"),
    )


@query(
    """SELECT doc_id, (text IN (SELECT text FROM documents JOIN labels USING (doc_id) WHERE toxic = 1))::INT
              AS given
       FROM documents"""
)
def embedding_overrides(spark, folder):
    """Texts of toxic documents have a predefined vector, copies of them too."""
    docs = texts(spark, folder).select("doc_id", "text")
    toxic = read_table(spark, folder, "labels").where("toxic = 1")
    given = (
        docs.join(toxic, "doc_id", "left_semi")
        .select("text")
        .distinct()
        .withColumn("embedding", F.array_repeat(F.lit(0.0), 16))
    )
    made = embed.embed(docs, embed.native_model("sha256", 16), "text")
    fixed = embed.with_overrides(made, given, "text", 16)
    zero = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + F.abs(x)) == 0
    return fixed.select("doc_id", zero.cast("int").alias("given"))


@query(
    """SELECT (SELECT count(*) FROM documents) AS documents_loaded, count(*) AS chunks_stored,
              count(*) AS vectors_stored, 0 AS errors, 0 AS reused_first, 1 AS second_run_empty
       FROM (SELECT unnest(range(0, greatest(1, len(regexp_extract_all(text, '\\S+'))), 10000))
             FROM documents)"""
)
def ingest_counters(spark, folder):
    """Two ingest runs over the same documents: the second finds nothing to do."""
    from docquarry.engine import Engine

    config = EngineConfig(
        scratch_path(spark, "store"),
        embedding_dim=32,
        chunks=ChunkSettings(size=10_000, overlap=0),
        buckets=8,
    )
    engine = Engine(spark, config)
    docs = texts(spark, folder).withColumn("doc_id", F.col("doc_id").cast("string"))
    sources = text_sources(docs, F.col("doc_id"), F.col("text"), F.lit("text/plain"))
    first = engine.index(sources).counts
    second = engine.index(sources).counts
    stored = engine.store.chunks.read().select("source_id", "doc_id")
    held = stored.join(engine.store.vectors.read().select("doc_id", "model"), "doc_id", "left")
    return held.agg(
        F.count_distinct("source_id").alias("documents_loaded"),
        F.count("*").alias("chunks_stored"),
        F.count("model").alias("vectors_stored"),
        F.lit(first["errors"]).cast("int").alias("errors"),
        F.lit(first["embeddings_reused"]).cast("int").alias("reused_first"),
        F.lit(int(second["documents_loaded"] == 0)).alias("second_run_empty"),
    )


@query(
    """SELECT path AS source_id, CASE WHEN lang = 'en' THEN 'md5:1' ELSE 'sha256:1' END AS model,
              n AS vectors, n AS equal, 0 AS second_run
       FROM (SELECT lang, doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END AS path,
                    greatest(1, (len(regexp_extract_all(text, '\\S+')) + 9999) // 10000) AS n FROM documents)"""
)
def mapped_models(spark, folder):
    """Each path has its model; vectors read back from the store are those of that model."""
    from docquarry.engine import Engine

    config = EngineConfig(
        scratch_path(spark, "store"),
        embedding_dim=32,
        model_map={"*.md": "md5"},
        chunks=ChunkSettings(size=10_000, overlap=0),
        buckets=8,
    )
    engine = Engine(spark, config)
    path = F.expr("doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.txt' END")
    sources = text_sources(texts(spark, folder), path, F.col("text"), F.lit("text/plain"))
    engine.index(sources)
    second = engine.index(sources).counts["documents_loaded"]
    expected = F.when(F.col("model") == "md5:1", V.md5_embedding(F.col("content"), 32)).otherwise(
        V.sha256_embedding(F.col("content"), 32)
    )
    contents = engine.store.chunks.read().select("doc_id", "content")
    return (
        engine.store.vectors.read()
        .join(contents, "doc_id")
        .groupBy("source_id", "model")
        .agg(
            F.count("*").alias("vectors"),
            F.count_if(F.col("embedding") == expected.cast("array<float>")).alias("equal"),
            F.lit(second).alias("second_run"),
        )
    )


def _fails_on_some(texts_: list[str]) -> list[list[float]]:
    if any(len(t) % 29 == 0 for t in texts_):
        raise ServiceError("service down")
    return _lengths(texts_)


def _lengths(texts_: list[str]) -> list[list[float]]:
    return [[float(len(t)), 1.0] for t in texts_]


def _never(texts_: list[str]) -> list[list[float]]:
    raise ServiceError("nothing is left to ask")


@query(
    """SELECT count(*) AS chunks, count(*) AS vectors, count(*) AS right_vectors, 1 AS some_failed, 0 AS unfinished,
              0 AS last_documents, 0 AS last_vectors, 0 AS last_errors
       FROM documents WHERE length(trim(text)) > 0"""
)
def retry_embeddings(spark, folder):
    """The service fails for some texts, the next run completes them, a third asks nothing."""
    from docquarry.engine import Engine

    config = EngineConfig(
        scratch_path(spark, "store"), embedding_model="lengths", embedding_dim=2,
        chunks=ChunkSettings(size=100_000, overlap=0), buckets=8,
    )
    docs = texts(spark, folder).withColumn("doc_id", F.col("doc_id").cast("string"))
    sources = text_sources(docs, F.col("doc_id"), F.col("text"), F.lit("text/plain"))
    results = []
    for asked in (_fails_on_some, _lengths, _never):
        model = embed.Model(name="lengths", dim=2, remote=asked, retry=embed.Retry(attempts=1))
        engine = Engine(spark, config, model=model)
        results.append(engine.index(sources).counts)
    first, _, last = results
    vectors = engine.store.vectors.read().select("doc_id", "embedding")
    held = engine.store.chunks.read().select("doc_id", "content").join(vectors, "doc_id", "left")
    return held.agg(
        F.count("*").alias("chunks"),
        F.count("embedding").alias("vectors"),
        F.count_if(F.get("embedding", F.lit(0)) == F.length("content")).alias("right_vectors"),
        F.lit(int(0 < first["vectors_stored"] < first["chunks_stored"])).alias("some_failed"),
        F.lit(engine.store.unfinished.read().count()).cast("int").alias("unfinished"),
        *[F.lit(last[n]).cast("int").alias(f"last_{short}") for n, short in
          (("documents_loaded", "documents"), ("vectors_stored", "vectors"), ("errors", "errors"))],
    )


@query(
    """SELECT doc_id::VARCHAR AS source_id, md5('new ' || text) AS content_md5, 200.0::DOUBLE AS last_modified
       FROM documents WHERE length(trim(text)) > 0"""
)
def stream_late_versions(spark, folder):
    """Newer versions arrive first, older ones in a later stream run: the newer ones stay."""
    from docquarry.engine import Engine
    from docquarry.streaming.ingest import index_stream

    root = scratch_path(spark, "late")
    config = EngineConfig(
        f"{root}/store", embedding_dim=32, chunks=ChunkSettings(size=100_000, overlap=0), buckets=8
    )
    engine = Engine(spark, config)
    docs = texts(spark, folder).withColumn("doc_id", F.col("doc_id").cast("string"))
    for time, word in ((200.0, "new "), (100.0, "old ")):
        version = text_sources(docs, F.col("doc_id"), F.concat(F.lit(word), "text"), F.lit("text/plain"))
        version.withColumn("last_modified", F.lit(time)).write.mode("append").parquet(f"{root}/arriving")
        arriving = spark.readStream.schema(spark.read.parquet(f"{root}/arriving").schema).parquet(f"{root}/arriving")
        index_stream(arriving, engine, f"{root}/checkpoint").awaitTermination()
    times = engine.store.sources.read().select("source_id", "last_modified")
    held = engine.store.chunks.read().select("source_id", F.md5("content").alias("content_md5"))
    return held.join(times, "source_id")
