"""Named queries over the fixture tables, each with the SQL it must agree with where there is one.

Every query reads whole tables and whole texts. ``SHARED_SQL`` holds common table expressions; a
query names the ones it needs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.sources.tables import read_table, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

# Each document gets a file path whose extension follows its language.
PATH = (
    "source || '/' || doc_id || CASE lang WHEN 'en' THEN '.md' WHEN 'de' THEN '.txt' "
    "WHEN 'fr' THEN '.html' ELSE '.csv' END"
)
MIME_OF_LANG = (
    "CASE lang WHEN 'en' THEN 'text/markdown' WHEN 'de' THEN 'text/plain' "
    "WHEN 'fr' THEN 'text/html' ELSE 'text/csv' END"
)

SHARED_SQL: dict[str, str] = {
    "files": f"files AS (SELECT doc_id, text, lang, source, n_chars, {PATH} AS path FROM documents)",
    # character windows of 500 with overlap 50
    "windows": """windows AS (
        SELECT doc_id, source, lang, text, w.s AS start_char,
               row_number() OVER (PARTITION BY doc_id ORDER BY w.s) - 1 AS chunk_index,
               count(*) OVER (PARTITION BY doc_id) AS chunk_total,
               substr(text, w.s + 1, 500) AS content
        FROM documents, LATERAL (SELECT unnest(range(0, length(text), 450)) AS s) w)""",
    # short lines turned into headings of level 1 to 3 by their place
    "markdown": """markdown AS (
        SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x, i:
            CASE WHEN length(x) BETWEEN 1 AND 60 THEN repeat('#', 1 + (i - 1) % 3) || ' ' || x
                 ELSE x END), chr(10)) AS text
        FROM documents)""",
    "md_lines": """md_lines AS (
        SELECT doc_id, u.i AS n, u.line,
               coalesce(sum(length(u.line) + 1) OVER (PARTITION BY doc_id ORDER BY u.i
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS position
        FROM markdown, LATERAL (
            SELECT unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i) u)""",
    # a stack cut to level - 1 has depth n + min(0, running min of level - n)
    "md_headings": """md_headings AS (
        SELECT doc_id, n, position, level, text, depth,
               array_to_string(list_filter([
                 CASE WHEN depth >= 1 THEN last_value(CASE WHEN depth = 1 THEN text END IGNORE NULLS) OVER w END,
                 CASE WHEN depth >= 2 THEN last_value(CASE WHEN depth = 2 THEN text END IGNORE NULLS) OVER w END,
                 CASE WHEN depth >= 3 THEN last_value(CASE WHEN depth = 3 THEN text END IGNORE NULLS) OVER w END],
                 lambda x: x IS NOT NULL), ' > ') AS path
        FROM (SELECT *, n + least(0, min(level - n) OVER (PARTITION BY doc_id ORDER BY n
                  ROWS UNBOUNDED PRECEDING)) AS depth
              FROM (SELECT doc_id, position, length(regexp_extract(line, '^(#+)', 1)) AS level,
                           trim(regexp_extract(line, '^#+\\s+(.+)$', 1)) AS text,
                           row_number() OVER (PARTITION BY doc_id ORDER BY n) AS n
                    FROM md_lines WHERE regexp_matches(line, '^#+\\s+.')))
        WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING))""",
    "centers": """centers AS (
        SELECT label, list(value ORDER BY dim) AS embedding
        FROM (SELECT label, dim, avg(value) AS value
              FROM (SELECT label, unnest(embedding)::DOUBLE AS value,
                           generate_subscripts(embedding, 1) AS dim FROM embeddings)
              GROUP BY label, dim)
        GROUP BY label)""",
    "l2": """l2 AS (
        SELECT c.label AS qid, e.vec_id,
               round(list_distance(c.embedding, e.embedding::DOUBLE[]) ** 2, 9) AS d2, e.label
        FROM centers c, embeddings e)""",
    "cosines": """cosines AS (
        SELECT c.label AS qid, e.vec_id, e.label,
               round(list_cosine_similarity(c.embedding, e.embedding::DOUBLE[]), 9) AS sim
        FROM centers c, embeddings e)""",
    "tokens": """tokens AS (
        SELECT doc_id, unnest(regexp_extract_all(text, '\\S+')) AS term FROM documents)""",
    "idf": """corpus_size AS (SELECT count(*) AS n FROM documents),
      tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
      raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS idf
              FROM tf, corpus_size GROUP BY term, n),
      idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf
              FROM raw)""",
    "bm25": """lengths AS (SELECT doc_id, count(*) AS dl FROM tokens GROUP BY doc_id),
      corpus AS (SELECT (SELECT sum(dl) FROM lengths) / (SELECT count(*) FROM documents) AS avgdl),
      asked AS (SELECT item_id AS qid, unnest(regexp_extract_all(text, '\\S+')) AS term FROM benchmark),
      scored AS (
        SELECT qid, doc_id,
               round(sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
        FROM asked JOIN idf USING (term) JOIN tf USING (term) JOIN lengths USING (doc_id), corpus
        GROUP BY qid, doc_id),
      bm25 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank
               FROM scored)""",
    # 32 digest bytes decide the cosine: the 384 values repeat them
    "hashed": """hashed AS (
        SELECT doc_id, chunk_index, content, start_char,
               list_transform(range(0, 32), lambda i:
                 (('0x' || substr(sha256(content), 1 + 2 * i, 2))::INT - 127.5) / 127.5) AS v
        FROM windows WHERE length(trim(content, ' ' || chr(10))) > 0),
      asked_v AS (
        SELECT item_id AS qid, text,
               list_transform(range(0, 32), lambda i:
                 (('0x' || substr(sha256(text), 1 + 2 * i, 2))::INT - 127.5) / 127.5) AS v
        FROM benchmark),
      dense AS (
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, chunk_id DESC) AS rank
        FROM (SELECT qid, doc_id || '#chunk' || chunk_index AS chunk_id, doc_id,
                     content, round(list_cosine_similarity(a.v, h.v), 9) AS sim
              FROM asked_v a, hashed h))""",
}


def query(sql: str | None = None, shared: tuple[str, ...] = ()):
    """Register a function as the query of its name, with its SQL twin."""

    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            heads = [SHARED_SQL[name] for name in shared]
            body = sql
            if heads:
                rest = body.lstrip()
                if rest[:5].upper() == "WITH ":
                    body = "WITH " + ", ".join(heads) + ", " + rest[5:]
                else:
                    body = "WITH " + ", ".join(heads) + " " + body
            ORACLES[fn.__name__] = body
        return fn

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents for work that is heavy per text, spread over the cores."""
    return spread(documents(spark, folder), "doc_id")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """Web pages, spread over the cores."""
    return spread(read_table(spark, folder, "pages"), "page_id")


def file_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a file path, as ``source_id`` and ``location``, and its content type."""
    return texts(spark, folder).withColumns(
        {
            "source_id": F.expr(PATH),
            "location": F.expr(PATH),
            "content_type": F.expr(MIME_OF_LANG),
        }
    )


def markdown_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose short lines are Markdown headings of level 1 to 3."""
    text = """array_join(transform(split(text, '\n'), (x, i) ->
        CASE WHEN length(x) BETWEEN 1 AND 60 THEN concat(repeat('#', 1 + i % 3), ' ', x) ELSE x END
    ), '\n')"""
    return texts(spark, folder).select("doc_id", F.expr(text).alias("text"))


def questions(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark passages as questions ``(qid, text)``."""
    return read_table(spark, folder, "benchmark").select(F.col("item_id").alias("qid"), "text")


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings")


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from docquarry.plans import (  # noqa: F401
        queries_answers,
        queries_chunks,
        queries_ingest,
        queries_retrieval,
        queries_sources,
        queries_store,
    )

    return QUERIES, ORACLES
