"""Queries on chunking."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.config import ChunkSettings
from docquarry.functions import headings as H
from docquarry.functions.text import first_short_line, token_length
from docquarry.operators import chunking, splitting
from docquarry.plans.catalog import (
    MIME_OF_LANG,
    file_documents,
    markdown_documents,
    pages,
    query,
    texts,
)
from docquarry.plans.ingest import processing_summary
from docquarry.plans.queries_sources import TITLE_SQL
from docquarry.sources.tables import read_table


@query(
    """SELECT doc_id, chunk_index, chunk_total, start_char, start_char + length(content) AS end_char,
              md5(content) AS content_md5 FROM windows""",
    ("windows",),
)
def char_windows(spark, folder):
    chunks = chunking.char_windows(texts(spark, folder).select("doc_id", "text"))
    return chunks.select(
        "doc_id",
        "chunk_index",
        "chunk_total",
        F.col("chunk_start_char").alias("start_char"),
        F.col("chunk_end_char").alias("end_char"),
        F.md5("content").alias("content_md5"),
    )


@query(
    """WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '\\s*\\S+|\\s+') AS tokens FROM documents),
       w AS (SELECT doc_id, text, array_to_string(list_slice(tokens, u.s + 1, u.s + 120), '') AS content, u.s
             FROM t, LATERAL (SELECT unnest(range(0, greatest(0, len(tokens) - 30 - 1) + 1, 90)) AS s) u
             WHERE len(tokens) > 0)
       SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS chunk_index,
              count(*) OVER (PARTITION BY doc_id) AS chunk_total, md5(content) AS content_md5,
              instr(text, content) - 1 AS start_char
       FROM w"""
)
def token_windows(spark, folder):
    """Windows of 120 tokens with an overlap of 30; offsets of the first occurrence."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.token_windows(docs, size=120, overlap=30)
    return chunks.select(
        "doc_id",
        "chunk_index",
        "chunk_total",
        F.md5("content").alias("content_md5"),
        F.col("chunk_start_char").alias("start_char"),
    )


@query(
    """SELECT doc_id, w.s // 40 AS chunk_index, instr(text, substr(text, w.s + 1, 40)) - 1 AS first_char
       FROM documents, LATERAL (SELECT unnest(range(0, length(text), 40)) AS s) w"""
)
def chunk_positions(spark, folder):
    """A repeated chunk gets the offset of its first occurrence."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.window_positions(docs, size=40, overlap=0)
    return chunks.select("doc_id", "chunk_index", F.col("chunk_start_char").alias("first_char"))


@query()
def recursive_split(spark, folder):
    """Semantic chunks of up to 200 tokens with an overlap of 40."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.recursive_chunks(docs, size=200, overlap=40)
    return chunks.drop("text")


@query(
    """SELECT doc_id, length(regexp_replace(text, '\\s', '', 'g')) AS kept_chars, 1 AS within_size
       FROM documents"""
)
def recursive_split_coverage(spark, folder):
    """Without overlap the chunks hold every visible character once, and none is too long."""
    docs = texts(spark, folder).select("doc_id", "text")
    chunks = chunking.recursive_chunks(docs, size=50, overlap=0)
    visible = F.length(F.regexp_replace("content", r"\s", ""))
    return chunks.groupBy("doc_id").agg(
        F.sum(visible).alias("kept_chars"),
        F.min((token_length(F.col("content")) <= 50).cast("int")).alias("within_size"),
    )


@query(
    """SELECT page_id, length(regexp_replace(html, '\\s', '', 'g')) AS kept_chars, 1 AS within_size
       FROM pages"""
)
def html_split_coverage(spark, folder):
    """The same for pages cut at their tags, measured in characters."""
    html_pages = pages(spark, folder).select("page_id", "html")
    chunks = chunking.recursive_chunks(
        html_pages, "html", size=800, overlap=0, separators=splitting.HTML, length="chars"
    )
    visible = F.length(F.regexp_replace("content", r"\s", ""))
    return chunks.groupBy("page_id").agg(
        F.sum(visible).alias("kept_chars"),
        F.min((F.length("content") <= 800).cast("int")).alias("within_size"),
    )


@query(
    """SELECT conv_id, turn, length(regexp_replace(text, '\\s', '', 'g')) AS kept_chars, 1 AS within_size
       FROM conversations"""
)
def page_split_coverage(spark, folder):
    """The same for the separators of PDF and Word texts."""
    turns = read_table(spark, folder, "conversations").select("conv_id", "turn", "text")
    chunks = chunking.recursive_chunks(
        turns, size=120, overlap=0, separators=splitting.PAGES, length="chars"
    )
    visible = F.length(F.regexp_replace("content", r"\s", ""))
    return chunks.groupBy("conv_id", "turn").agg(
        F.sum(visible).alias("kept_chars"),
        F.min((F.length("content") <= 120).cast("int")).alias("within_size"),
    )


_HEADER = (
    "nullif(last_value(CASE WHEN level = {n} THEN head WHEN level < {n} THEN chr(1) END IGNORE NULLS) "
    "OVER w, chr(1))"
)


@query(
    f"""WITH marked AS (
          SELECT doc_id, n, trim(line) AS line,
                 CASE WHEN regexp_matches(trim(line), '^#{{1,6}}( |$)')
                      THEN length(regexp_extract(trim(line), '^(#+)', 1)) END AS level,
                 trim(regexp_extract(trim(line), '^#+ (.*)$', 1)) AS head
          FROM md_lines),
        carried AS (
          SELECT doc_id, n, line, level, {", ".join(_HEADER.format(n=n) + f" AS h{n}" for n in (1, 2, 3))},
                 count(level) OVER w AS part
          FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
        parts AS (
          SELECT doc_id, part, h1, h2, h3, string_agg(line, chr(10) ORDER BY n) AS body
          FROM carried WHERE level IS NULL AND line <> '' GROUP BY ALL),
        runs AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY part)
                    - row_number() OVER (PARTITION BY doc_id, h1, h2, h3 ORDER BY part) AS run
          FROM parts),
        joined AS (
          SELECT doc_id, min(part) AS place, h1, h2, h3,
                 string_agg(body, '  ' || chr(10) ORDER BY part) AS content
          FROM runs GROUP BY doc_id, run, h1, h2, h3)
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS chunk_index,
               md5(content) AS content_md5,
               CASE WHEN h1 IS NOT NULL OR h2 IS NOT NULL THEN coalesce(h3, h2, h1) END AS closest_heading,
               CASE WHEN h1 IS NOT NULL OR h2 IS NOT NULL THEN concat_ws(' > ', h1, h2, h3) END
                 AS heading_path
        FROM joined""",
    ("markdown", "md_lines"),
)
def markdown_sections(spark, folder):
    """Sections below their headers, large enough to stay whole."""
    docs = markdown_documents(spark, folder)
    chunks = chunking.markdown_chunks(docs, size=1_000_000, overlap=0, length="chars")
    return chunking.header_context(chunks).select(
        "doc_id",
        "chunk_index",
        F.md5("content").alias("content_md5"),
        "closest_heading",
        "heading_path",
    )


@query(
    """WITH w AS (
         SELECT doc_id, u.s AS start_char FROM markdown,
           LATERAL (SELECT unnest(range(0, length(text), 450)) AS s) u
         WHERE length(text) > 450),
       near AS (
         SELECT w.doc_id, w.start_char, h.text, h.path,
                row_number() OVER (PARTITION BY w.doc_id, w.start_char
                                   ORDER BY abs(h.position - w.start_char), h.n) AS r
         FROM w JOIN md_headings h USING (doc_id))
       SELECT doc_id, start_char, text AS closest_heading, path AS heading_path FROM near WHERE r = 1""",
    ("markdown", "md_lines", "md_headings"),
)
def nearest_heading(spark, folder):
    """Nearest heading before or after the start of each window."""
    docs = markdown_documents(spark, folder).withColumn(
        "heading_hierarchy", H.markdown_headings(F.col("text"))
    )
    chunks = chunking.heading_context(chunking.char_windows(docs))
    return chunks.where(F.col("closest_heading").isNotNull()).select(
        "doc_id", F.col("chunk_start_char").alias("start_char"), "closest_heading", "heading_path"
    )


@query(
    """SELECT semantic, splitter, count(*) AS documents FROM (
          SELECT 1 AS semantic, CASE lang WHEN 'en' THEN 'markdown_header_splitter'
                 WHEN 'fr' THEN 'html_splitter' ELSE 'token_splitter' END AS splitter FROM documents
          UNION ALL
          SELECT 0, CASE lang WHEN 'en' THEN 'markdown_header_splitter' ELSE 'token_splitter' END
          FROM documents)
        GROUP BY ALL"""
)
def splitter_dispatch(spark, folder):
    docs = file_documents(spark, folder).select("content_type")
    both = docs.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(flag).alias("semantic"),
                        chunking.splitter_name(F.col("content_type"), bool(flag)).alias("splitter"),
                    )
                    for flag in (1, 0)
                ]
            )
        )
    )
    return both.groupBy("semantic", "splitter").agg(F.count(F.lit(1)).alias("documents"))


@query()
def split_documents(spark, folder):
    """Every document through the splitter of its content type, with heading context."""
    docs = file_documents(spark, folder).select("source_id", "content_type", "text")
    chunks = chunking.split_documents(docs, ChunkSettings(size=200, overlap=40))
    return chunks.drop("text", "headers")


@query(
    f"""SELECT doc_id, chunk_index, 1700000000.0::DOUBLE AS processed_at, {MIME_OF_LANG} AS mime_type,
               'words' AS tokenizer, len(regexp_extract_all(content, '\\S+')) AS token_count
        FROM windows""",
    ("windows",),
)
def chunk_enrichment(spark, folder):
    docs = file_documents(spark, folder).select("doc_id", "content_type", "text")
    chunks = chunking.enrich(chunking.char_windows(docs), now=1_700_000_000.0)
    return chunks.select(
        "doc_id", "chunk_index", "processed_at", "mime_type", "tokenizer", "token_count"
    )


@query(
    f"""SELECT doc_id, chunk_index, CASE WHEN chunk_total > 1 THEN {TITLE_SQL} END AS title,
               CASE WHEN chunk_total > 1 THEN source END AS source, NULL::VARCHAR AS lang,
               chunk_index::VARCHAR AS own
        FROM windows""",
    ("windows",),
)
def inherited_metadata(spark, folder):
    """Title and source pass from the first chunk to the others; other keys do not."""
    docs = texts(spark, folder).select(
        "doc_id",
        "text",
        chunking.metadata_map(
            {"title": first_short_line(F.col("text")), "source": F.col("source"), "lang": F.col("lang")}
        ).alias("first"),
    )
    chunks = chunking.char_windows(docs)
    own = chunking.metadata_map({"own": F.col("chunk_index")})
    held = chunks.select(
        "doc_id",
        "chunk_index",
        chunking.inherit(own, F.col("first"), F.col("chunk_total")).alias("metadata"),
    )
    return held.select(
        "doc_id",
        "chunk_index",
        *[
            F.try_element_at("metadata", F.lit(key)).alias(key)
            for key in ("title", "source", "lang", "own")
        ],
    )


@query(
    f"""SELECT content_type, count(*) AS sources, count(n) AS succeeded, count(*) - count(n) AS failed,
               coalesce(sum(n), 0)::BIGINT AS chunks
        FROM (SELECT {MIME_OF_LANG} AS content_type, nullif((length(text) + 449) // 450, 0) AS n
              FROM documents)
        GROUP BY content_type"""
)
def chunk_summary(spark, folder):
    """Sources, successes, failures and chunks per content type."""
    sources = file_documents(spark, folder).select("source_id", "content_type", "text")
    return processing_summary(sources, chunking.char_windows(sources))


@query(
    """SELECT doc_id, length(text) AS chars, len(regexp_extract_all(text, '\\S+')) AS words,
              ((length(text) + 3) // 4) AS chars4 FROM documents"""
)
def token_lengths(spark, folder):
    text = F.col("text")
    return texts(spark, folder).select(
        "doc_id", *[token_length(text, model).alias(model) for model in ("chars", "words", "chars4")]
    )
