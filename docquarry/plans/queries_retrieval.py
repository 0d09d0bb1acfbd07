"""Queries on vector search, BM25, filters, reranking, fusion, packing and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.embedding import sha256_embedding
from docquarry.functions.vectors import cosine, squared_l2
from docquarry.operators import bm25 as B
from docquarry.operators import chunking, evaluate
from docquarry.operators import retrieval as R
from docquarry.operators.postings import PostingIndex
from docquarry.operators.search import centroids, first_k, nearest
from docquarry.plans.catalog import documents, query, questions, texts, vectors
from docquarry.plans.ingest import ordinals
from docquarry.session import Scratch, cut_lineage, scratch_path
from docquarry.sources.tables import read_table


def centers(spark, folder):
    """The mean vector of each label as a question."""
    return centroids(vectors(spark, folder), "label").select(F.col("label").alias("qid"), "embedding")


def by_center(spark, folder, k, metric, where=None):
    return nearest(
        centers(spark, folder),
        vectors(spark, folder),
        k,
        metric,
        vector_id="vec_id",
        ordinal="vec_id",
        where=where,
    )


def digest_vectors(df, text="text"):
    """Digest embeddings in double precision, as the SQL twins compute them."""
    return df.withColumn("embedding", sha256_embedding(F.col(text), 32))


def digest_sql(text):
    return (
        f"list_transform(range(0, 32), lambda i: "
        f"(('0x' || substr(sha256({text}), 1 + 2 * i, 2))::INT - 127.5) / 127.5)"
    )


def rounded(df, column="score"):
    return df.withColumn(column, F.round(column, 6))


@query(
    """SELECT qid, vec_id, rank, round(d2, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank FROM l2)
       WHERE rank <= 10""",
    ("centers", "l2"),
)
def topk_l2(spark, folder):
    """Nearest vectors to each label mean by squared distance."""
    return rounded(by_center(spark, folder, 10, "l2"))


@query(
    """SELECT qid, vec_id, rank, round(sim, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id DESC) AS rank FROM cosines)
       WHERE rank <= 10""",
    ("centers", "cosines"),
)
def topk_cosine(spark, folder):
    """Most similar vectors to each label mean; ties to the later vector."""
    return rounded(by_center(spark, folder, 10, "cosine"))


@query(
    """SELECT e.vec_id, round(list_cosine_similarity(c.embedding, e.embedding::DOUBLE[]), 6) AS similarity,
              round(list_distance(c.embedding, e.embedding::DOUBLE[]) ** 2, 6) AS distance
       FROM embeddings e JOIN centers c USING (label)""",
    ("centers",),
)
def pair_similarity(spark, folder):
    """Similarity and squared distance of every vector to the mean of its label."""
    middle = centroids(vectors(spark, folder), "label").withColumnRenamed("embedding", "center")
    joined = vectors(spark, folder).join(middle, "label")
    a, b = F.col("center"), F.col("embedding")
    return joined.select(
        "vec_id",
        F.round(cosine(a, b), 6).alias("similarity"),
        F.round(squared_l2(a, b), 6).alias("distance"),
    )


@query(
    """SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY r) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS r FROM l2)
       WHERE r <= 30 AND label = qid QUALIFY rank <= 10""",
    ("centers", "l2"),
)
def filtered_topk_post(spark, folder):
    """Fetch three times k, then keep the vectors of the label, then the first k."""
    found = by_center(spark, folder, 30, "l2")
    labels = vectors(spark, folder).select("vec_id", "label")
    filters = F.create_map(F.lit("label"), F.col("qid").cast("string"))
    keep = R.matches_filters({"label": T.IntegerType()}, filters)
    ranked = R.filter_ranked(found.join(labels, "vec_id"), keep, 10, filters)
    return ranked.select("qid", "vec_id", "rank")


@query(
    """SELECT qid, vec_id, rank, round(d2, 6) AS score FROM (
         SELECT *, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rank FROM l2 WHERE label < 5)
       WHERE rank <= 10""",
    ("centers", "l2"),
)
def filtered_topk_pre(spark, folder):
    """Filter first, then search: the filter reaches the scan."""
    return rounded(by_center(spark, folder, 10, "l2", where=F.col("label") < 5))


@query(
    """SELECT count(*) AS vectors, max(len(embedding)) AS dim, min(vec_id) AS first, max(vec_id) AS last
       FROM embeddings"""
)
def vector_index_info(spark, folder):
    return vectors(spark, folder).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.max(F.size("embedding")).cast("bigint").alias("dim"),
        F.min("vec_id").alias("first"),
        F.max("vec_id").alias("last"),
    )


@query("SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 4")
def first_vectors(spark, folder):
    """The stand-in store that gives the first k vectors to any question."""
    return first_k(vectors(spark, folder).select("vec_id", "label"), 4, "vec_id")


@query(
    """SELECT doc_id, source AS source_id, row_number() OVER (ORDER BY source, doc_id::VARCHAR) AS place
       FROM documents"""
)
def vector_append(spark, folder):
    """Insertion numbers grow in (source, id) order without one task seeing all rows."""
    docs = texts(spark, folder).select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("source_id")
    )
    numbered = ordinals(docs, 100, Scratch(spark))
    return numbered.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), "source_id", (F.col("ordinal") - 99).alias("place")
    )


@query(
    """SELECT qid, chunk_id, rank, round(sim, 6) AS score FROM dense WHERE rank <= 4""",
    ("windows", "hashed"),
)
def topk_text(spark, folder):
    """Nearest chunks of all documents to every benchmark passage under the digest embedding."""
    chunks = chunking.char_windows(texts(spark, folder).select("doc_id", "text"))
    keyed = chunks.select(
        F.concat("doc_id", F.lit("#chunk"), "chunk_index").alias("chunk_id"), "content"
    )
    stored = digest_vectors(keyed, "content")
    asked = digest_vectors(questions(spark, folder))
    return rounded(nearest(asked, stored, 4, "cosine", vector_id="chunk_id"))


_ASKED = """benchmark_q AS (SELECT item_id AS qid, text || ' filter:lang=en filter:source="src ' || item_id
       || '" filter:lang=' || CASE WHEN length(text) > 150 THEN 'de' ELSE 'fr' END AS text FROM benchmark)"""


@query(
    f"""WITH {_ASKED}
        SELECT qid, trim(regexp_replace(regexp_replace(text,
                 'filter:(\\w+)=(?:"([^"]+)"|([^\\s]+))', '', 'g'), '\\s+', ' ', 'g')) AS clean,
               regexp_extract_all(text, 'filter:lang=([^\\s]+)', 1)[-1] AS lang,
               regexp_extract(text, 'filter:source="([^"]+)"', 1) AS source
        FROM benchmark_q"""
)
def parse_filters(spark, folder):
    """Directives leave the question; the last one of a key counts."""
    tail = F.when(F.length("text") > 150, F.lit("de")).otherwise(F.lit("fr"))
    asked = questions(spark, folder).withColumn(
        "text",
        F.concat(
            "text", F.lit(' filter:lang=en filter:source="src '), "qid", F.lit('" filter:lang='), tail
        ),
    )
    filters = R.question_filters(F.col("text"))
    return asked.select(
        "qid",
        R.clean_question(F.col("text")).alias("clean"),
        F.try_element_at(filters, F.lit("lang")).alias("lang"),
        F.try_element_at(filters, F.lit("source")).alias("source"),
    )


@query(
    """SELECT doc_id, (contains(lower(source), 'rc1') AND lang = 'en')::INT AS text_hit,
              (n_chars = try_cast('1500' AS BIGINT) OR false)::INT AS number_hit, 0 AS bad_number,
              (lang = 'de')::INT AS map_hit, 0 AS unknown_key
       FROM documents"""
)
def metadata_match(spark, folder):
    """Strings match by content, numbers by value, unknown keys never."""
    types = {"source": T.StringType(), "lang": T.StringType(), "n_chars": T.LongType()}

    def test(**wanted):
        pairs = [F.lit(x) for pair in wanted.items() for x in pair]
        return R.matches_filters(types, F.create_map(*pairs)).cast("int")

    held = chunking.metadata_map({"lang": F.col("lang")})
    asked = F.create_map(F.lit("lang"), F.lit("DE"))
    return texts(spark, folder).select(
        "doc_id",
        test(source="RC1", lang="EN").alias("text_hit"),
        test(n_chars=" 1500 ").alias("number_hit"),
        test(n_chars="1500.0").alias("bad_number"),
        R.map_matches_filters(held, asked).cast("int").alias("map_hit"),
        test(nothing="1").alias("unknown_key"),
    )


def sparse(spark, folder, k):
    return B.bm25(questions(spark, folder), texts(spark, folder), k)


@query(
    "SELECT qid, doc_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    ("tokens", "idf", "bm25"),
)
def bm25_topk(spark, folder):
    """Best documents for every benchmark passage by BM25."""
    return rounded(sparse(spark, folder, 10))


def posted(spark, folder, k):
    """BM25 from an index that was written in two batches, English texts first."""
    docs = texts(spark, folder)
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index = PostingIndex(spark, scratch_path(spark, "terms"), parts=8)
    try:
        index.add(docs.where(english))
        index.add(docs.where(~english))
        return index.search(questions(spark, folder), k)
    finally:
        index.clear()


@query(
    "SELECT qid, doc_id, rank, round(score, 6) AS score FROM bm25 WHERE rank <= 10",
    ("tokens", "idf", "bm25"),
)
def bm25_postings(spark, folder):
    """Best documents for every benchmark passage, from stored postings."""
    return rounded(posted(spark, folder, 10))


@query(
    "SELECT term, count(*) AS df, sum(tf)::BIGINT AS occurrences FROM ("
    "SELECT term, doc_id, count(*) AS tf FROM tokens GROUP BY ALL) GROUP BY term",
    ("tokens",),
)
def postings_index(spark, folder):
    """Inverted index summed up per term."""
    index = B.postings(texts(spark, folder))
    return index.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum("tf").alias("occurrences")
    )


@query("SELECT term, round(idf, 6) AS idf FROM idf", ("tokens", "idf"))
def term_weights(spark, folder):
    """Inverse document frequencies with the floor for very common terms."""
    weights = B.term_weights(cut_lineage(B.term_stats(texts(spark, folder))))
    return weights.select("term", F.round("idf", 6).alias("idf"))


_WORDS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+')"


@query(
    f"""WITH held AS (SELECT b.qid, b.doc_id, b.rank,
                 list_filter({_WORDS.format('q.text')}, lambda t: NOT list_contains(['a','an','the','of','and','or'], t)) AS asked,
                 {_WORDS.format('d.text')} AS words
               FROM bm25 b JOIN benchmark q ON q.item_id = b.qid JOIN documents d ON d.doc_id = b.doc_id
               WHERE b.rank <= 12),
        counted AS (SELECT qid, doc_id, rank AS prior_rank,
                 list_sum(list_transform(asked, lambda t: list_count(list_filter(words, lambda w: w = t))))::INT
                   AS keyword_score FROM held)
        SELECT *, row_number() OVER (PARTITION BY qid ORDER BY keyword_score DESC, prior_rank) AS rank
        FROM counted QUALIFY rank <= 4""",
    ("tokens", "idf", "bm25"),
)
def keyword_rerank(spark, folder):
    """The twelve best by BM25 reordered by word counts, first four kept."""
    asked = questions(spark, folder).withColumnRenamed("text", "question")
    bodies = documents(spark, folder).select("doc_id", F.col("text").alias("content"))
    ranked = sparse(spark, folder, 12).join(asked, "qid").join(bodies, "doc_id")
    return R.keyword_rerank(ranked, 4).select(
        "qid", "doc_id", "prior_rank", "keyword_score", "rank"
    )


_DENSE_DOCS = f"""vectors_of AS (
    SELECT doc_id, {digest_sql("text")} AS v FROM documents),
  dense_docs AS (
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_id DESC) AS rank
    FROM (SELECT q.item_id AS qid, doc_id,
                 round(list_cosine_similarity(q.v, d.v), 9) AS sim
          FROM (SELECT item_id, {digest_sql("text")} AS v FROM benchmark) q, vectors_of d)
    QUALIFY rank <= 10)"""


_FUSED = f"""WITH {_DENSE_DOCS},
        fused AS (SELECT qid, doc_id, round(sum(1.0 / (60 + rank)), 12) AS score, min(place) AS place FROM (
            SELECT qid, doc_id, rank, rank AS place FROM dense_docs
            UNION ALL SELECT qid, doc_id, rank, 1000 + rank FROM bm25 WHERE rank <= 10)
          GROUP BY qid, doc_id)
        SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, place) AS rank,
               round(score, 6) AS score
        FROM fused QUALIFY rank <= 4"""


@query(_FUSED, ("tokens", "idf", "bm25"))
def rrf_fusion(spark, folder):
    """Vector and BM25 lists over whole documents fused by reciprocal ranks."""
    stored = digest_vectors(texts(spark, folder).select("doc_id", "text"))
    asked = digest_vectors(questions(spark, folder))
    dense = nearest(asked, stored, 10, "cosine")
    return rounded(R.reciprocal_rank_fusion(dense, sparse(spark, folder, 10), k=4)).select(
        "qid", "doc_id", "rank", "score"
    )


@query(_FUSED, ("tokens", "idf", "bm25"))
def rrf_postings(spark, folder):
    """As rrf_fusion, its BM25 list from stored postings."""
    stored = digest_vectors(texts(spark, folder).select("doc_id", "text"))
    dense = nearest(digest_vectors(questions(spark, folder)), stored, 10, "cosine")
    return rounded(R.reciprocal_rank_fusion(dense, posted(spark, folder, 10), k=4)).select(
        "qid", "doc_id", "rank", "score"
    )


_PACKED = """ranked AS (
    SELECT b.qid, b.rank, b.doc_id, d.source, d.text AS content, len(regexp_extract_all(d.text, '\\S+')) AS tokens
    FROM bm25 b JOIN documents d USING (doc_id) WHERE b.rank <= 6),
  packed AS (SELECT *, sum(tokens) OVER (PARTITION BY qid ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS tokens_used
             FROM ranked QUALIFY tokens_used <= 2000)"""


def packed_context(spark, folder):
    """Up to six documents per passage within 2000 tokens."""
    bodies = documents(spark, folder).select("doc_id", "source", F.col("text").alias("content"))
    ranked = sparse(spark, folder, 6).join(bodies, "doc_id")
    return R.pack_context(ranked, 2000)


@query(
    f"""WITH {_PACKED} SELECT qid, rank, doc_id, tokens, tokens_used FROM packed""",
    ("tokens", "idf", "bm25"),
)
def pack_context(spark, folder):
    """Leading documents whose token sum stays within the budget."""
    return packed_context(spark, folder).select("qid", "rank", "doc_id", "tokens", "tokens_used")


@query(
    """SELECT qid, source AS doc_id, round(max(1.0 / rank), 6) AS best, round(min(1.0 / rank), 6) AS last
       FROM bm25 b JOIN documents d USING (doc_id) WHERE rank <= 10 GROUP BY qid, source""",
    ("tokens", "idf", "bm25"),
)
def evaluation_run(spark, folder):
    """Ranks as scores per source; with several hits the best or the last one counts."""
    sources = documents(spark, folder).select("doc_id", "source")
    ranked = sparse(spark, folder, 10).join(sources, "doc_id")
    return rounded(rounded(R.rank_scores(ranked, "source", keep="both"), "best"), "last")


def _metrics_sql(k: int) -> str:
    return f"""
      ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM run
                 QUALIFY rank <= {k}),
      judged AS (SELECT r.qid, r.rank, coalesce(q.rel, 0) AS rel,
                   sum((coalesce(q.rel, 0) > 0)::INT) OVER (PARTITION BY r.qid ORDER BY rank ROWS UNBOUNDED PRECEDING) AS hits
                 FROM ranked r LEFT JOIN qrels q USING (qid, doc_id)),
      found AS (SELECT qid, sum(rel / log2(rank + 1)) AS dcg, sum(CASE WHEN rel > 0 THEN hits / rank ELSE 0 END) AS ap,
                   sum((rel > 0)::INT) AS hits, min(CASE WHEN rel > 0 THEN rank END) AS first FROM judged GROUP BY qid),
      relevant AS (SELECT qid, count(*) AS n FROM qrels WHERE rel > 0 GROUP BY qid),
      ideal AS (SELECT qid, sum(rel / log2(r + 1)) AS idcg FROM (
                  SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC, doc_id) AS r FROM qrels WHERE rel > 0)
                WHERE r <= {k} GROUP BY qid),
      per_q AS (SELECT coalesce(dcg, 0) / idcg AS ndcg, coalesce(ap, 0) / n AS ap, coalesce(1.0 / first, 0) AS rr,
                   coalesce(hits, 0) / n AS recall, coalesce(hits, 0) / {k}.0 AS prec
                FROM relevant JOIN ideal USING (qid) LEFT JOIN found USING (qid))
      SELECT unnest(['NDCG@{k}', 'MAP@{k}', 'MRR@{k}', 'Recall@{k}', 'Precision@{k}']) AS metric,
             round(unnest([avg(ndcg), avg(ap), avg(rr), avg(recall), avg(prec)]), 6) AS value FROM per_q"""


@query(
    "WITH qrels AS (SELECT source AS qid, doc_id, quality + toxic AS rel FROM documents JOIN labels USING (doc_id)),"
    " run AS (SELECT source AS qid, doc_id, n_chars::DOUBLE AS score FROM documents)," + _metrics_sql(10)
)
def ir_metrics(spark, folder):
    """Sources as queries, length as score, labels as graded judgements."""
    docs = documents(spark, folder).select(F.col("source").alias("qid"), "doc_id", "n_chars")
    run = docs.select("qid", "doc_id", F.col("n_chars").cast("double").alias("score"))
    labels = read_table(spark, folder, "labels")
    qrels = docs.join(labels, "doc_id").select("qid", "doc_id", (F.col("quality") + F.col("toxic")).alias("rel"))
    return rounded(evaluate.evaluate(run, qrels), "value")


@query(
    "WITH qrels AS (SELECT label AS qid, vec_id AS doc_id, 1 AS rel FROM embeddings),"
    " run AS (SELECT qid, vec_id AS doc_id, sim AS score FROM (SELECT *, row_number() OVER"
    " (PARTITION BY qid ORDER BY sim DESC, vec_id DESC) AS r FROM cosines) WHERE r <= 20)," + _metrics_sql(20),
    ("centers", "cosines"),
)
def vector_ir_metrics(spark, folder):
    """How well the label means find the vectors of their label."""
    run = by_center(spark, folder, 20, "cosine").withColumnRenamed("vec_id", "doc_id")
    qrels = vectors(spark, folder).select(
        F.col("label").alias("qid"), F.col("vec_id").alias("doc_id"), F.lit(1).alias("rel")
    )
    names = ["NDCG@20", "MAP@20", "MRR@20", "Recall@20", "P@20"]
    return rounded(evaluate.evaluate(run, qrels, names), "value")


@query(
    """SELECT event_type AS metric, max(value) AS value FROM events
       WHERE event_type IN ('click', 'view') GROUP BY event_type"""
)
def metric_selection(spark, folder):
    """Requested names only, the larger value of duplicate names."""
    values = read_table(spark, folder, "events").select(F.col("event_type").alias("metric"), "value")
    return evaluate.select_metrics(values, ["click", "view"])


@query(
    """SELECT source || '/' || doc_id || '.tar.gz' AS path, doc_id || '.tar' AS doc_id FROM documents"""
)
def simplify_paths(spark, folder):
    """Document paths to file names without their last extension."""
    paths = documents(spark, folder).select(F.expr("source || '/' || doc_id || '.tar.gz'").alias("path"))
    return evaluate.simplify_run(paths.withColumn("doc_id", F.col("path")))


@query(
    """SELECT count(*) AS questions, round(avg(hit), 6) AS hit_rate FROM (
         SELECT q.item_id, max(coalesce(contains(lower(d.text), lower(q.text)), false)::INT) AS hit
         FROM benchmark q LEFT JOIN bm25 b ON b.qid = q.item_id AND b.rank <= 3
              LEFT JOIN documents d ON d.doc_id = b.doc_id
         GROUP BY q.item_id)""",
    ("tokens", "idf", "bm25"),
)
def golden_hit_rate(spark, folder):
    """Share of passages found word for word in one of the three best documents."""
    asked = questions(spark, folder).withColumnRenamed("text", "expected")
    bodies = documents(spark, folder).select("doc_id", F.col("text").alias("found"))
    best = sparse(spark, folder, 3).join(bodies, "doc_id").select("qid", "found")
    hits = (
        asked.join(best, "qid", "left")
        .select("qid", F.contains(F.lower("found"), F.lower("expected")).alias("hit"))
        .groupBy("qid")
        .agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("hit"))
    )
    shown = hits.select(F.lit("hit").alias("expected"), F.when(F.col("hit"), "hit").otherwise("").alias("found"))
    return rounded(evaluate.hit_rate(shown), "hit_rate")
