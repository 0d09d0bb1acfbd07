"""Answering: a table of questions to a table of answers, in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.config import SearchSettings
from docquarry.operators import answer as A
from docquarry.operators import bm25 as B
from docquarry.operators import embed as E
from docquarry.operators import retrieval as R
from docquarry.operators.postings import PostingIndex
from docquarry.operators.search import nearest
from docquarry.session import cut_lineage

# Typed chunk columns a filter can name; every other key is looked up in the metadata map.
FILTER_FIELDS = {
    "source_id": T.StringType(),
    "title": T.StringType(),
    "heading_path": T.StringType(),
    "closest_heading": T.StringType(),
    "chunk_order": T.IntegerType(),
    "token_count": T.IntegerType(),
}
# Up to so many questions, their winners (ids and ranks) are broadcast to the chunk tables.
FEW_QUESTIONS = 1_000
# Metadata values that hold numbers.
NUMERIC_KEYS = ("chunk_index", "total_chunks", "page_num", "file_size")


def parse_questions(questions: DataFrame) -> DataFrame:
    """``(qid, question, clean, filters)`` from ``(qid, text)``."""
    return questions.select(
        "qid",
        F.col("text").alias("question"),
        R.clean_question(F.col("text")).alias("clean"),
        R.question_filters(F.col("text")).alias("filters"),
    )


def chunk_passes(filters: Column) -> Column:
    """Every filter of the question holds for the chunk row."""

    def on_map(e):
        held = F.try_element_at(F.col("metadata"), e["key"])
        number = held.try_cast("bigint") == e["value"].try_cast("bigint")
        text = F.contains(F.lower(held), F.lower(e["value"]))
        return F.coalesce(
            F.when(e["key"].isin(list(NUMERIC_KEYS)), number).otherwise(text), F.lit(False)
        )

    typed = [
        ~F.map_contains_key(filters, F.lit(name))
        | R.value_matches(F.col(name), dtype, F.try_element_at(filters, F.lit(name)))
        for name, dtype in FILTER_FIELDS.items()
    ]
    others = F.filter(F.map_entries(filters), lambda e: ~e["key"].isin(list(FILTER_FIELDS)))
    return reduce(lambda a, b: a & b, typed) & F.forall(others, on_map)


def _located(df: DataFrame) -> DataFrame:
    """Ids with the bucket of their row in front, where the table has one."""
    if "bucket" not in df.columns:
        return df
    return df.withColumn("doc_id", F.concat_ws(":", F.col("bucket").cast("string"), "doc_id"))


def _unlocated(ranked: DataFrame) -> DataFrame:
    """The bucket and the id of :func:`_located`."""
    return ranked.withColumns(
        {
            "bucket": F.substring_index("doc_id", ":", 1).cast("int"),
            "doc_id": F.expr("substr(doc_id, instr(doc_id, ':') + 1)"),
        }
    )


def _ranked(
    parsed: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    model: E.Model,
    settings: SearchSettings,
    bm25_weights: DataFrame | None,
    terms: PostingIndex | None = None,
) -> DataFrame:
    """``(qid, doc_id, rank)``: dense search, fused with BM25 in hybrid mode.

    With *terms* BM25 reads stored postings instead of all chunks.
    """
    wide = settings.k * settings.overfetch
    asked = E.embed(parsed.select("qid", "clean"), model, "clean").select("qid", "embedding")
    ranked = nearest(asked, vectors, wide, settings.metric, ordinal="ordinal").select(
        "qid", "doc_id", "rank"
    )
    if not settings.hybrid:
        return ranked
    asked_text = parsed.select("qid", F.col("clean").alias("text"))
    if terms is not None:
        sparse = terms.search(asked_text, wide)
        return R.reciprocal_rank_fusion(ranked, sparse, k=wide).select("qid", "doc_id", "rank")
    sparse = B.bm25(
        asked_text,
        chunks.select("doc_id", F.col("content").alias("text")),
        wide,
        weights=bm25_weights,
    )
    return R.reciprocal_rank_fusion(ranked, sparse, k=wide).select("qid", "doc_id", "rank")


def _prefiltered(
    parsed: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    model: E.Model,
    settings: SearchSettings,
    weights: DataFrame | None,
    terms: PostingIndex | None = None,
) -> DataFrame:
    """As :func:`_ranked`, each set of filters searching only the chunks that pass it.

    Questions are grouped by their filters; a set costs one scan, whatever the number of its questions.
    """
    # a map cannot be grouped by, its sorted entries can
    entries = F.array_sort(F.map_entries("filters"))
    filtered = parsed.where(F.size("filters") > 0)
    sets = [row[0] for row in filtered.select(entries.alias("e")).distinct().collect()]
    if weights is None and settings.hybrid and sets:
        # statistics are those of the whole corpus, not of what passes a filter
        weights = terms.weights().where(F.col("term").isNotNull()) if terms is not None else B.term_weights(cut_lineage(B.term_stats(chunks.select("doc_id", F.col("content").alias("text")))))
    parts = [_ranked(parsed.where(F.size("filters") == 0), chunks, vectors, model, settings, weights, terms)]
    for wanted in sets:
        pairs = [F.struct(F.lit(e["key"]).alias("key"), F.lit(e["value"]).alias("value")) for e in wanted]
        passing = chunks.where(chunk_passes(F.map_from_entries(F.array(*pairs))))
        mine = filtered.where(entries == F.array(*pairs))
        held = vectors.join(passing.select("doc_id"), "doc_id", "left_semi")
        parts.append(_ranked(mine, passing, held, model, settings, weights))
    return reduce(DataFrame.unionByName, parts)


def index_terms(chunks: DataFrame, terms: PostingIndex) -> None:
    """Write the postings of all *chunks* anew, for hybrid search.

    Chunks deleted later are left out of answers by the join with their text; for new ones write again.
    """
    terms.clear()
    terms.add(_located(chunks), "doc_id", "content")


def retrieve(
    parsed: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    model: E.Model,
    settings: SearchSettings,
    bm25_weights: DataFrame | None = None,
    terms: PostingIndex | None = None,
) -> DataFrame:
    """Ranked chunks per question with the chunk columns: filter, search, rerank, first k.

    Only ids and scores travel through the search; chunk columns are joined to the few survivors.
    With ``settings.prefilter`` off, filters apply to ``overfetch * k`` found chunks instead and may
    leave fewer than k. Tables that carry their ``bucket`` are joined by it as well: few questions
    read only the buckets that hold their chunks. Questions without filters search *terms*, where
    given (:func:`index_terms`); questions with filters take its statistics and scan what passes.
    """
    k, wide = settings.k, settings.k * settings.overfetch
    by_bucket = "bucket" in chunks.columns and "bucket" in vectors.columns
    if not by_bucket:
        chunks, vectors = chunks.drop("bucket"), vectors.drop("bucket")
    search = _prefiltered if settings.prefilter else _ranked
    ranked = search(parsed, _located(chunks), _located(vectors), model, settings, bm25_weights, terms)
    ranked = ranked.where(F.col("rank") <= wide)
    if by_bucket:
        ranked = _unlocated(ranked)
        # the winners of at most FEW_QUESTIONS questions are FEW_QUESTIONS * wide ids
        if parsed.select("qid").limit(FEW_QUESTIONS + 1).count() <= FEW_QUESTIONS:
            ranked = F.broadcast(ranked)
        joined = ranked.join(chunks, ["bucket", "doc_id"]).drop("bucket").join(parsed, "qid")
    else:
        joined = ranked.join(chunks, "doc_id").join(parsed, "qid")
    found = joined.where(
        F.col("rank") <= R.search_width(k, F.col("filters"), settings.overfetch)
    ).where(chunk_passes(F.col("filters")))
    if settings.rerank:
        return R.keyword_rerank(found, k, "clean", "content")
    return R.top_k_per_group(
        found.withColumnRenamed("rank", "found_rank"), ["qid"], [F.asc("found_rank")], k
    )


def prompts(ranked: DataFrame, questions: DataFrame, settings: SearchSettings) -> DataFrame:
    """``(qid, question, documents, prompt)``, one row per question, packed within the budget."""
    shaped = ranked.withColumns(
        {
            "source": F.col("source_id"),
            "source_type": F.try_element_at("metadata", F.lit("content_type")),
        }
    )
    packed = R.pack_context(shaped, settings.max_context_tokens, "content", "token_count")
    documents = A.assemble(packed, "source", "source_type", "content")
    template = A.prompt_text(settings.prompt_id, fallback=True)
    none = F.expr(
        "cast(array() as array<struct<rank:int,source:string,source_type:string,content:string>>)"
    )
    return (
        questions.select("qid", F.col("text").alias("question"))
        .join(documents, "qid", "left")
        .withColumn("documents", F.coalesce("documents", none))
        .withColumn(
            "prompt",
            A.render_prompt(template, A.context_text(F.col("documents")), F.col("question")),
        )
    )


def answer_questions(
    questions: DataFrame,
    chunks: DataFrame,
    vectors: DataFrame,
    model: E.Model,
    settings: SearchSettings | None = None,
    chat: A.ChatModel | None = None,
    now: float = 0.0,
    terms: PostingIndex | None = None,
) -> DataFrame:
    """Answers of all *questions* ``(qid, text)`` over the chunk and vector tables."""
    settings = settings or SearchSettings()
    ranked = retrieve(parse_questions(questions), chunks, vectors, model, settings, terms=terms)
    prompted = prompts(ranked, questions, settings)
    replied = A.generate(prompted, chat, settings.system_prompt)
    return A.finish_answers(replied, now)


def search_chunks(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, model: E.Model, k: int = 4, metric: str = "l2"
) -> DataFrame:
    """Plain search without filters or generation: ``(qid, rank, score, doc_id, content, metadata)``."""
    asked = E.embed(questions.select("qid", "text"), model, "text").select("qid", "embedding")
    ranked = nearest(asked, vectors, k, metric, ordinal="ordinal")
    return ranked.join(chunks.select("doc_id", "content", "metadata"), "doc_id").select(
        "qid", "rank", "score", "doc_id", "content", "metadata"
    )
