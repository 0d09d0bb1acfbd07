"""One query per operator, with production parameters, over its whole table; SQL twins where there are.

Each query gets its rows from its operator and only names and orders the columns asked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.llm import (
    decontaminate,
    embeddings,
    hard_negatives,
    html_text,
    language_model,
    license_scan,
    mixing,
    periodic_runs,
    quality,
    sharding,
    simhash,
    suffix_dedup,
    toxicity,
)
from docquarry.llm.common import LOWER, UPPER, fold, table
from docquarry.llm.license_rules import read_rules
from docquarry.sources.tables import read_table

SHARDS = 16


def op1_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    """Expected severity of every document."""
    return toxicity.toxicity(table(spark, folder, "documents"), read_table(spark, folder, "labels"))


def op2_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of a mixture of twice the corpus' tokens, and how often each is taken."""
    mixed = mixing.mix(table(spark, folder, "documents"), share=(2, 1), max_epochs=4)
    return mixed.select(
        "doc_id", "lang", "source", F.col("mix_domain").alias("domain"),
        F.col("mix_tokens").alias("n_tokens"), F.col("mix_epochs").alias("n_times"),
    )


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Benchmark words hit in every document."""
    return decontaminate.decontaminate(
        table(spark, folder, "documents"), read_table(spark, folder, "benchmark"), spans=True
    ).drop("spans")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes of every document that an earlier one has too."""
    return suffix_dedup.suffix_dedup(read_table(spark, folder, "documents"), keep_bytes=False).drop("kept")


def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """Main text of every page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.near_duplicates(table(spark, folder, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_embedding_links(spark: SparkSession, folder: str) -> DataFrame:
    """Links and component of every vector."""
    return embeddings.near_duplicates(read_table(spark, folder, "embeddings"))


def op8_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, folder, "documents")
    scored = quality.score_quality(docs, quality.learn_quality(docs, read_table(spark, folder, "labels")))
    held_out = fold("doc_id", quality.FOLDS) == quality.HELD_OUT
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op9_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Log10 probability of every document."""
    return language_model.score_texts(table(spark, folder, "documents"))


def op10_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Sixteen shards of nearly equal bytes."""
    placed = sharding.kd_shards(read_table(spark, folder, "documents"), leaves=SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Licenses named in every document."""
    found = license_scan.scan_licenses(table(spark, folder, "documents"))
    named = lambda *columns: F.array_join(F.array_sort(F.array_distinct(F.concat(*columns))), ",")
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        named("places.label").alias("base_labels"), named("places.label", "detections.label").alias("labels"),
        license_scan.score().alias("score"),
    )


def plant_run(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a row of op12: in a tenth of the documents the end repeats with a period."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def op12_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of every document, and the document without its repetitions."""
    found = periodic_runs.periodic_runs(table(spark, folder, "documents"), rewrite=plant_run)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    longest = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("m"), r["start"], r["period"])))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"), (-F.col("best.m")).alias("length"), F.col("best.period").alias("period"),
        F.floor(-F.col("best.m") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(read_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """All stages of the corpus pipeline, from documents to shards."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_toxicity, op2_mixture, op3_decontaminate, op4_suffix_dedup, op5_main_text, op6_simhash,
        op7_embedding_links, op8_quality, op9_language_model, op10_shards, op11_license_scan,
        op12_periodic_runs, op13_hard_negatives, pipeline,
    )
}


def _mix_sql(share: tuple[int, int], max_epochs: int) -> str:
    """The mixture in SQL: the same tree, shares and prefixes, with plain windows over whole leaves."""
    def weight(level: int) -> str:
        names = ("domain", "language", "origin")[:level]
        cases = [
            "WHEN " + " AND ".join(f"{n} = '{p}'" for n, p in zip(names, path, strict=True)) + f" THEN {w}"
            for path, w in mixing.WEIGHTS.items()
            if len(path) == level
        ]
        return f"CASE {' '.join(cases)} ELSE {mixing.DEFAULT_WEIGHT} END" if cases else str(mixing.DEFAULT_WEIGHT)

    def shares(level: int) -> str:
        names = ", ".join(("domain", "language", "origin")[:level])
        parent = ", ".join(("domain", "language", "origin")[: level - 1])
        group = f"PARTITION BY {parent}" if parent else ""
        source = f"n{level} JOIN s{level - 1} USING ({parent})" if parent else "n1, whole"
        return f"""s{level} AS (
          SELECT {names}, CASE WHEN filled THEN cap
              ELSE (budget - coalesce(sum(CASE WHEN filled THEN cap END) OVER ({group}), 0)) * w
                   // sum(CASE WHEN NOT filled THEN w END) OVER ({group}) END AS budget
          FROM (SELECT *, (budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w
                       >= cap * sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled
                FROM (SELECT {names}, cap, w, budget FROM {source} WHERE w > 0)
                WINDOW o AS ({group} ORDER BY cap::DOUBLE / w::DOUBLE, {names})))"""

    return f"""
    WITH d AS (
      SELECT doc_id, lang, source, coalesce(lang, '{mixing.NONE}') AS language,
             coalesce(source, '{mixing.NONE}') AS origin,
             CASE WHEN source IS NULL THEN '{mixing.NONE}'
                  ELSE ['web', 'reference', 'forum'][1 + coalesce(try_cast(regexp_extract(source, '([0-9]{{1,4}})$', 1) AS INT), 0) % 3]
             END AS domain,
             coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::HUGEINT AS tokens
      FROM documents),
    leaves AS (SELECT domain, language, origin, sum(tokens)::HUGEINT AS tokens FROM d GROUP BY ALL),
    n3 AS (SELECT *, {weight(3)}::HUGEINT AS w, CASE WHEN {weight(3)} > 0 THEN tokens * {max_epochs} ELSE 0 END AS cap FROM leaves),
    n2 AS (SELECT *, {weight(2)}::HUGEINT AS w FROM (SELECT domain, language, sum(cap)::HUGEINT AS cap FROM n3 GROUP BY ALL)),
    n1 AS (SELECT *, {weight(1)}::HUGEINT AS w FROM (SELECT domain, sum(cap)::HUGEINT AS cap FROM n2 GROUP BY ALL)),
    whole AS (SELECT sum(tokens)::HUGEINT * {share[0]} // {share[1]} AS budget FROM leaves),
    {shares(1)}, {shares(2)}, {shares(3)},
    parts AS (
      SELECT l.domain, l.language, l.origin,
             CASE WHEN tokens > 0 THEN coalesce(budget, 0) // tokens ELSE 0 END AS epochs,
             CASE WHEN tokens > 0 THEN coalesce(budget, 0) % tokens ELSE 0 END AS rest
      FROM leaves l LEFT JOIN s3 USING (domain, language, origin)),
    ranked AS (
      SELECT doc_id, lang, source, domain, tokens, epochs, rest,
             sum(tokens) OVER (PARTITION BY domain, language, origin
               ORDER BY md5('{mixing.SEED}:' || epochs::BIGINT || ':' || coalesce(doc_id::VARCHAR, '')), doc_id) AS after
      FROM d JOIN parts USING (domain, language, origin))
    SELECT doc_id, lang, source, domain, tokens::BIGINT AS n_tokens, n_times::BIGINT AS n_times
    FROM (SELECT *, epochs + CASE WHEN after <= rest AND epochs < {max_epochs} THEN 1 ELSE 0 END AS n_times FROM ranked)
    WHERE n_times > 0"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

DECONTAMINATE_SQL = f"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS gram
  FROM (SELECT item_id, w, least(len(w), 10) AS size FROM items WHERE len(w) > 0),
       LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS s)),
docs AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
grams AS (
  SELECT k, s, size, array_to_string(list_slice(w, s, s + size - 1), ' ') AS gram
  FROM docs, (SELECT DISTINCT size FROM windows) z,
       LATERAL (SELECT unnest(generate_series(1, len(w) - size + 1)) AS s)
  WHERE len(w) >= size),
found AS (SELECT k, s, size, item_id FROM grams JOIN windows USING (size, gram)),
hits AS (
  SELECT k, count(DISTINCT p) AS n FROM (SELECT DISTINCT k, s, size FROM found),
       LATERAL (SELECT unnest(generate_series(s, s + size - 1)) AS p) GROUP BY k),
named AS (
  SELECT k, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM found GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(named.n, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (k) LEFT JOIN named USING (k)"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
    AND len(list_filter(embedding, lambda e: e <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
    ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
parts AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, (SELECT count(*) FROM links WHERE a = vec_id) AS n_links,
       component_id, vec_id = component_id AS kept
FROM embeddings JOIN parts ON vec_id = a"""

def _license_sql() -> str:
    """The scan in SQL: every rule on every text, without the keyword filter."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rules = ", ".join(
        f"({r.number}, {r.priority}, {quoted(r.label)}, {quoted(license_scan.over_words(r.expression))})" for r in read_rules()
    )
    phrases = ", ".join(
        f"({-1 - i}, 0, {quoted(v)}, {quoted(license_scan.over_words(p))})" for i, (p, v) in enumerate(license_scan.PHRASES.items())
    )
    levels = sorted({r.priority for r in read_rules()})
    reach = " ".join(f"WHEN priority = {p} THEN max(CASE WHEN priority >= {p} THEN ends END) OVER before" for p in levels)
    words = "list_sum(list_transform({}, lambda x: (len(x) - len(replace(x, ' ', ''))) // 2))"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS k, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{_WORD}') AS w FROM documents),
    t AS (SELECT k, ' ' || array_to_string(w, '  ') || ' ' AS t FROM d WHERE len(w) > 0),
    rules(number, priority, label, pattern) AS (VALUES {rules}, {phrases}),
    pieces AS (
      SELECT k, number, priority, label, regexp_extract_all(t, pattern) AS inside, string_split_regex(t, pattern) AS outside
      FROM t JOIN rules ON regexp_matches(t, pattern)),
    found AS (
      SELECT k, number, priority, label, start, start + {words.format("[inside[i]]")} AS ends
      FROM (SELECT *, ({words.format("outside[1:i]")} + coalesce({words.format("inside[1:i - 1]")}, 0))::BIGINT AS start
            FROM pieces, LATERAL (SELECT unnest(generate_series(1, len(inside))) AS i))),
    kept AS (
      SELECT k, label, priority FROM (
        SELECT *, CASE {reach} END AS reached FROM found WHERE number >= 0
        WINDOW before AS (PARTITION BY k ORDER BY start, ends DESC, priority DESC, number
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
      WHERE reached IS NULL OR reached < ends),
    base AS (
      SELECT k, count(*) AS n, min(start) AS first_word, max(start) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found WHERE number < 0 GROUP BY k),
    named AS (
      SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(priority) AS priority
      FROM (SELECT * FROM kept UNION ALL SELECT k, label, 0 FROM found WHERE number < 0) GROUP BY k)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_base, first_word, last_word,
           coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels,
           coalesce(priority, 0) / 10.0::DOUBLE AS score
    FROM d LEFT JOIN base USING (k) LEFT JOIN named USING (k)"""


PERIODIC_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_reduce(flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: [ascii(x), -1, -1, -1, -1, -1, -1, -1, -1])),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x::BIGINT) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295::BIGINT) AS c
  FROM documents),
planted AS (
  SELECT k, doc_id, w, len(w) AS n, xor(c, 4294967295) % 10 = 0 AND len(w) > 0 AS is_planted,
         CASE WHEN len(w) > 0 THEN (xor(c, 4294967295) // 10) % len(w) END AS a, xor(c, 4294967295) // 10 AS g FROM d),
words AS (
  SELECT k, doc_id, CASE WHEN is_planted THEN
           list_concat(w[1:a], list_transform(range(a, n), lambda i: w[1 + a + (i - a) % (1 + (n - a) // (3 + g % 8))]))
         ELSE w END AS w
  FROM planted),
grams AS (
  SELECT k, i, hash(w[i + 1], w[i + 2], w[i + 3], w[i + 4], w[i + 5], w[i + 6]) AS gram
  FROM words, LATERAL (SELECT unnest(range(0, len(w) - 5)) AS i)),
equal AS (
  SELECT a.k, a.i, b.i - a.i AS p FROM grams a JOIN grams b ON a.k = b.k AND a.gram = b.gram AND a.i < b.i),
-- six words equal to those p later, over consecutive places
islands AS (
  SELECT k, p, min(i) AS s, max(i) + 6 + p AS e
  FROM (SELECT *, i - row_number() OVER (PARTITION BY k, p ORDER BY i) AS island FROM equal) GROUP BY k, p, island),
runs AS (
  SELECT k, s, e - s AS length, min(p) AS p FROM islands
  WHERE e - s >= greatest(12, 2 * p) GROUP BY k, s, e),
dropped AS (
  SELECT DISTINCT k, i FROM runs, LATERAL (SELECT unnest(range(s + p, s + length)) AS i)),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY i) AS t
  FROM (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS i FROM words) ANTI JOIN dropped USING (k, i) GROUP BY k),
best AS (SELECT DISTINCT ON (k) * FROM runs ORDER BY k, length DESC, s, p),
lists AS (
  SELECT k, count(*) AS n_runs, string_agg(s || ',' || length || ',' || p || chr(10), '' ORDER BY s, p) AS lines FROM runs GROUP BY k)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, length, p AS period, length * 1000 // p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM words LEFT JOIN lists USING (k) LEFT JOIN best USING (k) LEFT JOIN kept USING (k)"""

NEGATIVES_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS row, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
scores AS (
  SELECT a.row AS arow, a.vec_id AS anchor_id, b.vec_id AS id, b.row AS row, a.label = b.label AS same,
         list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.x) = len(b.x)),
positives AS (
  SELECT arow, anchor_id, id AS positive_id, row AS prow, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY arow ORDER BY score DESC, id, row) <= 5)
SELECT p.anchor_id, positive_id, s.id AS negative_id, positive_score, s.score AS negative_score,
       row_number() OVER (PARTITION BY p.arow, prow ORDER BY s.score DESC, s.id, s.row)::INT AS rank
FROM positives p JOIN scores s ON p.arow = s.arow AND NOT s.same
  AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10"""

ORACLES: dict[str, str] = {
    "op2_mixture": _mix_sql((2, 1), 4),
    "op3_decontaminate": DECONTAMINATE_SQL,
    "op7_embedding_links": EMBEDDING_SQL,
    "op11_license_scan": _license_sql(),
    "op12_periodic_runs": PERIODIC_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
