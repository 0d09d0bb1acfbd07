"""Queries on prompts, generation, citations and whole answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry.config import ChunkSettings, EngineConfig, SearchSettings
from docquarry.functions.binding import unnest
from docquarry.operators import answer as A
from docquarry.operators import chunking, embed
from docquarry.operators.search import nearest
from docquarry.plans import answering, ingest
from docquarry.plans.catalog import documents, pages, query, questions, texts
from docquarry.plans.queries_retrieval import (
    _PACKED,
    digest_sql,
    digest_vectors,
    packed_context,
    sparse,
)
from docquarry.session import cut_lineage
from docquarry.sources.tables import read_table, text_sources


@query(
    """SELECT qid, rank, content FROM dense WHERE rank <= 4""",
    ("windows", "hashed"),
)
def plain_search(spark, folder):
    """Search without generation: the chunk texts in rank order."""
    chunks = chunking.char_windows(texts(spark, folder).select("doc_id", "text"))
    keyed = chunks.select(
        F.concat("doc_id", F.lit("#chunk"), "chunk_index").alias("chunk_id"), "content"
    )
    asked = digest_vectors(questions(spark, folder))
    ranked = nearest(asked, digest_vectors(keyed, "content"), 4, "cosine", vector_id="chunk_id")
    # only the winners meet their texts again
    return ranked.join(keyed, "chunk_id").select("qid", "rank", "content")


@query(
    f"""WITH {_PACKED} SELECT qid, md5(string_agg(content, chr(10) || chr(10) || '---' || chr(10) || chr(10)
                ORDER BY rank)) AS context_md5, count(*) AS documents
        FROM packed GROUP BY qid""",
    ("tokens", "idf", "bm25"),
)
def context_string(spark, folder):
    """Packed documents of each passage joined in rank order."""
    lists = A.assemble(packed_context(spark, folder), "content")
    return lists.select(
        "qid",
        F.md5(A.context_text(F.col("documents"))).alias("context_md5"),
        F.size("documents").cast("bigint").alias("documents"),
    )


def _prompt_sql() -> str:
    out = "'" + A.PROMPTS["default"].replace("'", "''") + "'"
    for name in ("context", "question"):
        out = out.replace("{" + name + "}", f"' || {name} || '")
    return out.replace("\n", "' || chr(10) || '")


@query(
    f"""SELECT item_id AS qid, md5({_prompt_sql()}) AS prompt_md5
        FROM (SELECT item_id, text AS question, 're: ' || text AS context FROM benchmark)"""
)
def prompt_render(spark, folder):
    """The default template filled in."""
    asked = questions(spark, folder)
    prompt = A.render_prompt(A.prompt_text("default"), F.concat(F.lit("re: "), "text"), F.col("text"))
    return asked.select("qid", F.md5(prompt).alias("prompt_md5"))


def repeat_prompt(batches):
    """A chat model that repeats what it is asked."""
    return ["Asked: " + messages[-1]["content"] for messages in batches]


@query(
    """SELECT conv_id, turn, 'system:be brief|user:' || text AS raw_answer FROM conversations"""
)
def chat_model(spark, folder):
    """A pluggable chat model called with message lists, the system prompt first."""

    def echo(batches):
        return ["|".join(f"{m['role']}:{m['content']}" for m in messages) for messages in batches]

    turns = read_table(spark, folder, "conversations")
    replied = A.generate(turns, echo, system_prompt="be brief", prompt="text")
    return replied.select("conv_id", "turn", "raw_answer")


_CITED = """cited AS (
    SELECT page_id, pos, trim(string_split(c, ':')[1]) AS source,
           CASE WHEN contains(c, ':') THEN trim(substr(c, instr(c, ':') + 1)) ELSE '' END AS excerpt
    FROM (SELECT page_id, u.i AS pos, substr(u.m, 2, length(u.m) - 2) AS c
          FROM pages, LATERAL (SELECT unnest(regexp_extract_all(html, '\\[[^\\]]+\\]|\\([^)]+\\)|"[^"]+"')) AS m,
              generate_subscripts(regexp_extract_all(html, '\\[[^\\]]+\\]|\\([^)]+\\)|"[^"]+"'), 1) AS i) u))"""


@query(
    f"""WITH {_CITED}
        SELECT page_id, source, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS place,
               count(DISTINCT excerpt) FILTER (excerpt <> '') AS excerpts
        FROM cited GROUP BY page_id, source"""
)
def extract_citations(spark, folder):
    """Citations in the markup of every page, in order of first mention."""
    html_pages = pages(spark, folder)
    found = unnest(html_pages, A.citations(F.col("html")), "place", "c")
    return found.select(
        "page_id",
        F.col("c.source").alias("source"),
        F.col("place").cast("bigint").alias("place"),
        F.size("c.excerpts").cast("bigint").alias("excerpts"),
    )


@query(
    """SELECT conv_id, turn, reply || chr(10) || chr(10) || 'Sources:'
              || CASE WHEN role <> 'user' THEN chr(10) || '2. ' || role ELSE '' END AS answer
       FROM (SELECT *, text || ' [turn:' || turn || '] (' || role || ': first) "' || role || ': second"' AS reply
             FROM conversations)"""
)
def cited_answers(spark, folder):
    """Cited sources that were retrieved are listed under their place among all citations."""
    turns = read_table(spark, folder, "conversations")
    reply = F.concat(
        "text",
        F.lit(" [turn:"),
        F.col("turn").cast("string"),
        F.lit("] ("),
        "role",
        F.lit(': first) "'),
        "role",
        F.lit(': second"'),
    )
    turns = turns.withColumn("reply", reply)
    retrieved = F.array(F.lit("system"), F.lit("assistant"))
    listed = A.with_source_list(F.col("reply"), A.citations(F.col("reply")), retrieved)
    return turns.select("conv_id", "turn", listed.alias("answer"))


@query(
    """WITH e AS (
         SELECT qid, rank, source || '|' || lang || '|' || CASE WHEN length(text) > 100
                THEN substr(text, 1, 100) || '...' ELSE text END AS entry
         FROM bm25 JOIN documents USING (doc_id) WHERE rank <= 6),
       d AS (SELECT qid, entry, min(rank) AS rank FROM e GROUP BY qid, entry)
       SELECT qid, count(*) AS num_sources, md5(string_agg(entry, chr(10) ORDER BY rank)) AS sources_md5
       FROM d GROUP BY qid""",
    ("tokens", "idf", "bm25"),
)
def answer_sources(spark, folder):
    """Distinct sources of each answer with their excerpts."""
    bodies = documents(spark, folder).select(
        "doc_id", "source", F.col("lang").alias("source_type"), F.col("text").alias("content")
    )
    ranked = sparse(spark, folder, 6).join(bodies, "doc_id")
    lists = A.assemble(ranked, "source", "source_type", "content").withColumn(
        "sources", A.source_entries(F.col("documents"))
    )
    shown = F.transform("sources", lambda s: F.concat_ws("|", s["path"], s["type"], s["excerpt"]))
    return lists.select(
        "qid",
        F.size("sources").cast("bigint").alias("num_sources"),
        F.md5(F.array_join(shown, "\n")).alias("sources_md5"),
    )


def indexed(spark, folder):
    """All documents as chunk and vector tables, computed by the indexing plan."""
    docs = texts(spark, folder)
    sources = text_sources(
        docs, F.concat_ws("/", "source", "doc_id"), F.col("text"), F.lit("text/plain")
    )
    config = EngineConfig("unused", chunks=ChunkSettings(size=120, overlap=30))
    # written once: vectors are made from the chunks, answers read their texts
    chunks = cut_lineage(ingest.chunk_rows(ingest.transform(sources, config), config, 0.0))
    model = embed.native_model("sha256", 384)
    made = embed.embed(chunks.select("doc_id", "content"), model)
    # ties go by chunk id here; a stored vector table has insertion numbers for that
    vectors = made.select("doc_id", "embedding", F.col("doc_id").alias("ordinal"))
    return chunks, vectors, model


def _answers_sql() -> str:
    unit = (
        "list_transform(v, lambda x: (x / sqrt(12 * list_sum(list_transform(v, lambda y: y * y))))"
        "::FLOAT::DOUBLE)"
    )
    break_ = "chr(10) || chr(10) || '---' || chr(10) || chr(10)"
    return f"""WITH t AS (
        SELECT source || '/' || doc_id AS source_id, regexp_extract_all(text, '\\s*\\S+|\\s+') AS tokens
        FROM documents WHERE length(text) > 0),
      chunks AS (
        SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY u.s) - 1 AS i,
               array_to_string(list_slice(tokens, u.s + 1, u.s + 120), '') AS content
        FROM t, LATERAL (SELECT unnest(range(0, greatest(0, len(tokens) - 30 - 1) + 1, 90)) AS s) u),
      stored AS (SELECT *, {unit} AS e FROM (
        SELECT source_id, source_id || '#chunk' || i AS doc_id, content, {digest_sql("content")} AS v
        FROM chunks WHERE trim(content, ' ' || chr(10)) <> '')),
      asked AS (SELECT qid, question, {unit} AS e FROM (
        SELECT qid, question, {digest_sql("clean")} AS v FROM (
          SELECT item_id AS qid, text AS question, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean
          FROM benchmark))),
      ranked AS (
        SELECT qid, question, source_id, content, row_number() OVER (PARTITION BY qid ORDER BY
                 round(12 * list_distance(a.e, s.e) ** 2, 9), doc_id) AS rank
        FROM asked a, stored s QUALIFY rank <= 4),
      entries AS (
        SELECT qid, min(rank) AS rank, source_id || '|text/plain|' || CASE WHEN length(content) > 100
                 THEN substr(content, 1, 100) || '...' ELSE content END AS entry
        FROM ranked GROUP BY qid, entry),
      listed AS (SELECT qid, string_agg(entry, chr(10) ORDER BY rank) AS sources, count(*) AS num_sources
                 FROM entries GROUP BY qid),
      prompts AS (SELECT qid, any_value(question) AS question, count(*) AS num_documents_retrieved,
                         string_agg(content, {break_} ORDER BY rank) AS context
                  FROM ranked GROUP BY qid)
      SELECT qid, question, reply || chr(10) || chr(10) || 'Sources:' AS answer, sources, num_sources,
             num_documents_retrieved
      FROM (SELECT *, 'Asked: ' || prompt AS reply FROM (SELECT *, {_prompt_sql()} AS prompt FROM prompts))
           JOIN listed USING (qid)"""


# the prompt itself holds the citation "[n]", so every echoed answer gets a list of sources
@query(_answers_sql())
def answer_questions(spark, folder):
    """From documents and questions to cited answers, in one plan."""
    chunks, vectors, model = indexed(spark, folder)
    answers = answering.answer_questions(
        questions(spark, folder), chunks, vectors, model, SearchSettings(k=4), now=0.0, chat=repeat_prompt
    )
    shown = F.transform("sources", lambda s: F.concat_ws("|", s["path"], s["type"], s["excerpt"]))
    return answers.select(
        "qid",
        "question",
        "answer",
        F.array_join(shown, "\n").alias("sources"),
        F.col("num_sources").cast("bigint").alias("num_sources"),
        F.col("num_documents_retrieved").cast("bigint").alias("num_documents_retrieved"),
    )


@query(
    """SELECT item_id AS qid, least(4, held)::BIGINT AS found, 0::BIGINT AS strangers
       FROM (SELECT item_id, item_id % 7 AS s FROM benchmark),
            LATERAL (SELECT count(*) AS held FROM documents
                     WHERE contains(source || '/' || doc_id, '/' || s) AND length(trim(text)) > 0)
       WHERE held > 0"""
)
def filtered_answers(spark, folder):
    """A selective filter per question still gives full k: filters come before the search."""
    docs = texts(spark, folder).select(F.concat_ws("/", "source", "doc_id").alias("source_id"), "text")
    chunks = docs.select(
        F.col("source_id").alias("doc_id"), "source_id", F.col("text").alias("content"),
        F.lit(0).alias("chunk_order"), F.lit(0).alias("token_count"),
        *[F.lit("").alias(c) for c in ("title", "heading_path", "closest_heading")],
        F.expr("cast(map() as map<string,string>)").alias("metadata"),
    )
    model = embed.native_model("sha256", 32)
    vectors = embed.embed(chunks.select("doc_id", "content"), model).select(
        "doc_id", "embedding", F.col("doc_id").alias("ordinal")
    )
    part = F.concat(F.lit("/"), (F.col("qid") % 7).cast("string"))
    asked = questions(spark, folder).withColumn("text", F.concat("text", F.lit(" filter:source_id="), part))
    found = answering.retrieve(answering.parse_questions(asked), chunks, vectors, model, SearchSettings(k=4))
    strange = ~F.contains("source_id", F.concat(F.lit("/"), (F.col("qid") % 7).cast("string")))
    return found.groupBy("qid").agg(F.count("*").alias("found"), F.count_if(strange).alias("strangers"))


@query(
    f"""WITH {_PACKED}
        SELECT item_id AS qid, CASE WHEN n > 0
               THEN 'Asked: ' || text ELSE '{A.NOTHING_FOUND}' END AS answer,
               coalesce(n, 0) AS num_documents_retrieved
        FROM benchmark LEFT JOIN (SELECT qid, count(*) AS n FROM packed GROUP BY qid) c ON c.qid = item_id""",
    ("tokens", "idf", "bm25"),
)
def answer_fallbacks(spark, folder):
    """Questions without any packed document get the fixed reply."""
    packed = packed_context(spark, folder).withColumn("source_type", F.lit("text"))
    lists = A.assemble(packed, "source", "source_type", "content")
    asked = questions(spark, folder).withColumnRenamed("text", "question").join(lists, "qid", "left")
    replied = A.generate(asked, repeat_prompt, prompt="question")
    return A.finish_answers(replied, 0.0).select(
        "qid", "answer", F.col("num_documents_retrieved").cast("bigint").alias("num_documents_retrieved")
    )


@query(
    """SELECT doc_id, md5(substr(array_to_string(list_slice(string_split(text, chr(10) || chr(10)), 1, 3),
              chr(10) || chr(10)), 1, 5000)) AS opening_md5
       FROM documents ORDER BY n_chars DESC, doc_id LIMIT 5"""
)
def summary_inputs(spark, folder):
    """Opening of the five largest documents, as given to the summary prompt."""
    top = texts(spark, folder).orderBy(F.desc("n_chars"), "doc_id").limit(5)
    return top.select("doc_id", F.md5(A.summary_input(F.col("text"))).alias("opening_md5"))


@query(
    """SELECT conv_id, turn, to_json(struct_pack(conv_id := conv_id, turn := turn, role := role)) AS payload
       FROM conversations"""
)
def json_rows(spark, folder):
    """Rows as JSON for machine-readable output."""
    turns = read_table(spark, folder, "conversations")
    return turns.select("conv_id", "turn", F.to_json(F.struct("conv_id", "turn", "role")).alias("payload"))

