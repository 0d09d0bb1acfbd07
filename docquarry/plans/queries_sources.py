"""Queries on sources, loaders and metadata extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.functions import headings as H
from docquarry.functions import mime as M
from docquarry.functions import text as X
from docquarry.functions.binding import unnest
from docquarry.operators import metadata
from docquarry.plans.catalog import (
    MIME_OF_LANG,
    documents,
    file_documents,
    markdown_documents,
    pages,
    query,
)
from docquarry.sources import corpora, loaders, tables
from docquarry.sources.files import describe, is_supported_path, path_filter
from docquarry.sources.tables import read_table


def as_files(named):
    """Texts with a ``source_id`` as a scan of files gives them."""
    return named.select(
        "source_id",
        F.col("source_id").alias("path"),
        F.col("text").cast("binary").alias("content"),
        F.octet_length("text").cast("bigint").alias("length"),
        F.timestamp_seconds(F.lit(0)).alias("modificationTime"),
    )


@query(
    """SELECT path AS source_id FROM files
       WHERE regexp_extract(path, '(\\.[^./]+)$', 1) IN ('.md', '.html')
         AND NOT regexp_matches(path, '(^|/)src1/[^/]*$')""",
    ("files",),
)
def scan_filter_sources(spark, folder):
    """Supported files of some types outside an excluded folder."""
    files = file_documents(spark, folder).select("source_id")
    path = F.col("source_id")
    return files.where(is_supported_path(path) & path_filter(path, [".md", ".html"], ["src1/*"]))


@query(
    f"""SELECT content_type, loader, count(*) AS files FROM (
          SELECT {MIME_OF_LANG} AS content_type,
                 CASE lang WHEN 'en' THEN 'markdown' WHEN 'de' THEN 'text' WHEN 'fr' THEN 'html'
                           ELSE 'csv' END AS loader
          FROM documents
          UNION ALL SELECT CASE WHEN url LIKE '%.html' THEN 'text/html' ELSE 'text/plain' END,
                 CASE WHEN url LIKE '%.html' THEN 'html' ELSE 'text' END FROM pages)
        GROUP BY ALL"""
)
def mime_dispatch(spark, folder):
    """Content type and loader by extension, or by a look at the bytes when there is none."""
    named = file_documents(spark, folder).select("source_id", F.col("text").alias("content"))
    bare = read_table(spark, folder, "pages").select(
        F.col("url").alias("source_id"), F.col("html").alias("content")
    )
    kind = M.content_type(F.col("source_id"), F.col("content"))
    return (
        named.unionByName(bare)
        .select(kind.alias("content_type"))
        .withColumn("loader", loaders.loader_name(F.col("content_type")))
        .groupBy("content_type", "loader")
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, folder):
    """Each document taken as the file ``<doc_id>.txt``."""
    named = documents(spark, folder).withColumn("source_id", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    found = describe(as_files(named))
    return found.select(
        F.regexp_extract("source_id", "^[0-9]+", 0).cast("bigint").alias("doc_id"), "content_hash"
    )


@query(
    """SELECT path, strlen(text) AS size_bytes, regexp_extract(path, '(\\.[^./]+)$', 1) AS extension,
              sha256(text) AS content_hash FROM files""",
    ("files",),
)
def file_stats(spark, folder):
    found = describe(as_files(file_documents(spark, folder)))
    return found.select(
        F.col("source_id").alias("path"),
        "size_bytes",
        M.extension(F.col("source_id")).alias("extension"),
        "content_hash",
    )


@query("SELECT doc_id, lang, n_chars FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def multi_get(spark, folder):
    """Documents of the labelled ids; ids without a document are left out."""
    ids = read_table(spark, folder, "labels").select("doc_id")
    return documents(spark, folder).select("doc_id", "lang", "n_chars").join(ids, "doc_id", "left_semi")


@query(
    """SELECT p.p_partkey AS id, (d.doc_id IS NOT NULL)::INT AS present
       FROM part p LEFT JOIN documents d ON d.doc_id = p.p_partkey"""
)
def document_exists(spark, folder):
    """Existence per requested id, without reading any text."""
    ids = read_table(spark, folder, "part").select(F.col("p_partkey").alias("id"))
    known = documents(spark, folder).select(F.col("doc_id").alias("id"), F.lit(1).alias("found"))
    return ids.join(known, "id", "left").select(
        "id", F.coalesce("found", F.lit(0)).alias("present")
    )


@query(
    """SELECT path AS source_id FROM files
       WHERE starts_with(path, 'src1') AND lang = 'en' AND source = 'src12'""",
    ("files",),
)
def memory_source_filter(spark, folder):
    """Prefix, content type and metadata equality together."""
    sources = file_documents(spark, folder)
    kept = tables.select_sources(
        sources, prefix="src1", content_type="text/markdown", metadata_filter={"source": F.lit("src12")}
    )
    return kept.select("source_id")


@query(
    """SELECT c_custkey, 'c_custkey: ' || c_custkey || chr(10) || 'c_name: ' || c_name || chr(10) ||
              'c_nationkey: ' || c_nationkey || chr(10) || 'c_acctbal: ' || c_acctbal || chr(10) ||
              'c_mktsegment: ' || c_mktsegment AS text
       FROM customer"""
)
def csv_records(spark, folder):
    """One text per record, a line per field."""
    rows = read_table(spark, folder, "customer")
    return rows.select("c_custkey", loaders.record_text(rows.columns).alias("text"))


def _html_text_sql() -> str:
    out = "html"
    for pattern, to in (
        ("(?is)<!--.*?-->", "' '"),
        ("(?is)<script[^>]*>.*?</script>", "' '"),
        ("(?is)<style[^>]*>.*?</style>", "' '"),
        (rf"(?i)</?({X.BLOCK_TAGS})(\s[^>]*)?/?>", "chr(10)"),
        ("<[^>]+>", "''"),
    ):
        out = f"regexp_replace({out}, '{pattern}', {to}, 'g')"
    for entity, char in X.ENTITIES:
        quoted = char.replace("'", "''")
        out = f"replace({out}, '{entity}', '{quoted}')"
    out = f"regexp_replace({out}, '[ \\t\\r\\x0b\\f]+', ' ', 'g')"
    out = f"regexp_replace({out}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"SELECT page_id, trim({out}, ' ' || chr(10)) AS text FROM pages"


@query(_html_text_sql())
def html_text(spark, folder):
    html_pages = pages(spark, folder)
    return html_pages.select("page_id", X.html_text(F.col("html")).alias("text"))


TITLE_SQL = (
    "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), "
    "lambda x: length(x) BETWEEN 1 AND 99)[1]"
)


@query(
    f"""SELECT doc_id::VARCHAR AS doc_id, coalesce({TITLE_SQL}, '') || chr(10) || chr(10) || text AS text
        FROM documents"""
)
def corpus_documents(spark, folder):
    """Title, blank line and body of every corpus document."""
    corpus = documents(spark, folder).select(
        F.col("doc_id").alias("_id"), X.first_short_line(F.col("text")).alias("title"), "text"
    )
    return corpora.corpus_documents(corpus)


@query(
    """SELECT n_nationkey::VARCHAR AS qid, n_name AS query, s_suppkey::VARCHAR AS doc_id,
              s_name || chr(10) || chr(10) || 'balance ' || s_acctbal AS answer
       FROM supplier JOIN nation ON s_nationkey = n_nationkey"""
)
def corpus_examples(spark, folder):
    """Judgements joined with their query and document texts."""
    queries = corpora.corpus_queries(
        read_table(spark, folder, "nation").select(
            F.col("n_nationkey").alias("_id"), F.col("n_name").alias("text")
        )
    )
    supplier = read_table(spark, folder, "supplier")
    corpus = corpora.corpus_documents(
        supplier.select(
            F.col("s_suppkey").alias("_id"),
            F.col("s_name").alias("title"),
            F.concat(F.lit("balance "), F.col("s_acctbal").cast("string")).alias("text"),
        )
    )
    qrels = corpora.corpus_qrels(
        supplier.select(
            F.col("s_nationkey").alias("query-id"),
            F.col("s_suppkey").alias("corpus-id"),
            F.lit(1).alias("score"),
        )
    )
    return corpora.examples(queries, corpus, qrels)


@query(
    """SELECT user_id::VARCHAR AS qid, event_id::VARCHAR AS doc_id, (value)::INT AS rel
       FROM (SELECT user_id, event_id, trunc(value) AS value FROM events)"""
)
def corpus_judgements(spark, folder):
    """Judgements from an event log: user as query, event as document, value as score."""
    events = read_table(spark, folder, "events")
    return corpora.corpus_qrels(
        events.select(
            F.col("user_id").alias("query_id"),
            F.col("event_id").alias("doc_id"),
            F.col("value").alias("score"),
        )
    )


@query(f"SELECT doc_id, {TITLE_SQL} AS title FROM documents")
def title_heuristic(spark, folder):
    return documents(spark, folder).select("doc_id", X.first_short_line(F.col("text")).alias("title"))


@query(
    f"""SELECT doc_id, CASE WHEN h <> '' THEN h ELSE {TITLE_SQL} END AS title
        FROM (SELECT *, trim(regexp_extract(text, '(?m)^\\s*#\\s+(.+?)$', 1)) AS h FROM markdown)""",
    ("markdown",),
)
def markdown_title(spark, folder):
    return markdown_documents(spark, folder).select(
        "doc_id", X.markdown_title(F.col("text")).alias("title")
    )


@query(
    """SELECT page_id, CASE WHEN t <> '' THEN trim(t) ELSE trim(regexp_replace(h, '<[^>]+>', '', 'g')) END
              AS title
       FROM (SELECT page_id, regexp_extract(html, '(?is)<title>(.+?)</title>', 1) AS t,
                    regexp_extract(html, '(?is)<h1[^>]*>(.+?)</h1>', 1) AS h FROM pages)"""
)
def html_title(spark, folder):
    html_pages = pages(spark, folder)
    return html_pages.select("page_id", X.html_title(F.col("html")).alias("title"))


@query(
    """SELECT page_id, 1 AS level, instr(html, m) - 1 AS position,
              trim(regexp_replace(m, '<[^>]+>', '', 'g')) AS text,
              trim(regexp_replace(m, '<[^>]+>', '', 'g')) AS path, 22.0::DOUBLE AS font_size
       FROM (SELECT page_id, html,
                    unnest(regexp_extract_all(html, '(?is)<h1[^>]*>.+?</h1>')) AS m FROM pages)"""
)
def html_headings(spark, folder):
    html_pages = pages(spark, folder)
    found = unnest(html_pages, H.html_headings(F.col("html"))).select("page_id", "col.*")
    return found.select("page_id", "level", "position", "text", "path", "font_size")


@query(
    "SELECT doc_id, position::BIGINT AS position, level, text, path FROM md_headings",
    ("markdown", "md_lines", "md_headings"),
)
def markdown_headings(spark, folder):
    docs = markdown_documents(spark, folder)
    return unnest(docs, H.markdown_headings(F.col("text"))).select("doc_id", "col.*").select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "level", "text", "path"
    )


RUNS = """transform(split(text, '\n'), (x, i) -> named_struct(
    'text', x, 'font_size', 8.0D + length(x) % 10, 'page', 1, 'position', i))"""

_SLOT = (
    "CASE WHEN level >= {n} THEN nullif(last_value(CASE WHEN level = {n} THEN text "
    "WHEN level < {n} THEN chr(1) END IGNORE NULLS) OVER w, chr(1)) END"
)


@query(
    f"""WITH runs AS (
          SELECT doc_id, u.line AS text, u.i - 1 AS position, 8.0 + length(u.line) % 10 AS size
          FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i) u),
        ranked AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY size DESC) AS level FROM runs),
        kept AS (SELECT doc_id, position, level, trim(text) AS text FROM ranked
                 WHERE level <= 5 AND length(text) <= 200)
        SELECT doc_id, position, level, text, array_to_string(list_filter([
            {", ".join(_SLOT.format(n=n) for n in range(1, 6))}], lambda x: x IS NOT NULL), ' > ') AS path
        FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY position ROWS UNBOUNDED PRECEDING)"""
)
def font_headings(spark, folder):
    """Headings from font runs: each line is a run whose size follows its length."""
    docs = documents(spark, folder).select("doc_id", F.expr(RUNS).alias("runs"))
    return unnest(docs, H.font_headings(F.col("runs"))).select("doc_id", "col.*").select(
        "doc_id", F.col("position").cast("bigint").alias("position"), "level", "text", "path"
    )


@query(
    """SELECT doc_id, CASE WHEN n <= 10 THEN n ELSE 0 END AS headings FROM (
         SELECT doc_id, count(*) FILTER (level <= 5 AND length(text) <= 200) AS n FROM (
           SELECT doc_id, text, dense_rank() OVER (PARTITION BY doc_id ORDER BY length(text) % 10 DESC) AS level
           FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text FROM documents))
         GROUP BY doc_id)"""
)
def font_headings_numbered(spark, folder):
    """Headings numbered one by one: more than ten give none."""
    docs = documents(spark, folder).select("doc_id", F.expr(RUNS).alias("runs"))
    found = H.font_headings(F.col("runs"), "per_item")
    return docs.select("doc_id", F.size(found).cast("bigint").alias("headings"))


@query(
    """SELECT doc_id, substr(trim(string_split(trim(text, ' ' || chr(10)), chr(10))[1]), 1, 50) AS heading
       FROM documents"""
)
def fallback_heading(spark, folder):
    """First line as the only heading of a document without font information."""
    docs = documents(spark, folder)
    return docs.select("doc_id", F.inline(H.first_line_heading(F.col("text")))).select(
        "doc_id", F.col("text").alias("heading")
    )


@query(
    f"""SELECT path AS source_id, CASE WHEN lang = 'en' AND h <> '' THEN h ELSE {TITLE_SQL} END AS title
        FROM (SELECT *, trim(regexp_extract(text, '(?m)^\\s*#\\s+(.+?)$', 1)) AS h FROM files)""",
    ("files",),
)
def metadata_dispatch(spark, folder):
    """Title rule chosen by content type."""
    docs = metadata.extract_metadata(file_documents(spark, folder))
    return docs.select("source_id", "title")
