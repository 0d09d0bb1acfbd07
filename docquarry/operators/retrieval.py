"""Filters, over-fetching, keyword reranking, rank fusion and context packing."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docquarry.functions.binding import let
from docquarry.functions.text import squeeze, token_length, words
from docquarry.operators.ranking import top_k_per_group

# Fixed values.
FILTER_PATTERN = r'filter:(\w+)=(?:"([^"]+)"|([^\s]+))'
STOP_WORDS = ("a", "an", "the", "of", "and", "or")
RRF_CONSTANT = 60
MAX_CONTEXT_TOKENS = 4096
OVERFETCH = 3


def clean_question(question: Column) -> Column:
    """The question without its ``filter:key=value`` directives."""
    return squeeze(F.regexp_replace(question, FILTER_PATTERN, ""))


def question_filters(question: Column) -> Column:
    """Directives as ``map<string,string>``; the last one of a repeated key counts."""

    def group(number: int) -> Column:
        return F.regexp_extract_all(question, F.lit(FILTER_PATTERN), F.lit(number))

    values = F.zip_with(group(2), group(3), lambda q, bare: F.when(q == "", bare).otherwise(q))
    pairs = F.zip_with(group(1), values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))

    def last_wins(found: Column) -> Column:
        keys = F.array_distinct(F.transform(found, lambda p: p["key"]))
        last = F.transform(
            keys, lambda k: F.element_at(F.filter(found, lambda p: p["key"] == k), -1)["value"]
        )
        return F.map_from_arrays(keys, last)

    return let(pairs, last_wins)


def value_matches(value: Column, dtype: T.DataType, wanted: Column) -> Column:
    """Numbers compare after casting *wanted*; strings contain it, ignoring case."""
    if isinstance(dtype, T.StringType):
        hit = F.contains(F.lower(value), F.lower(wanted))
    elif isinstance(dtype, (T.BooleanType, T.IntegralType)):
        hit = value.cast("bigint") == wanted.try_cast("bigint")
    elif isinstance(dtype, T.FractionalType):
        hit = value == wanted.try_cast("double")
    else:
        hit = F.lit(False)
    return F.coalesce(hit, F.lit(False))


def matches_filters(fields: Mapping[str, T.DataType], filters: Column) -> Column:
    """True when every entry of the *filters* map holds; a key that is absent or null never does."""
    tests = [
        ~F.map_contains_key(filters, F.lit(name))
        | value_matches(F.col(f"`{name}`"), dtype, F.try_element_at(filters, F.lit(name)))
        for name, dtype in fields.items()
    ]
    known = F.array(*[F.lit(name) for name in fields])
    tests.append(F.size(F.array_except(F.map_keys(filters), known)) == 0)
    return reduce(lambda a, b: a & b, tests)


def map_matches_filters(metadata: Column, filters: Column) -> Column:
    """As :func:`matches_filters` for metadata held as ``map<string,string>``."""
    return F.forall(
        F.map_entries(filters),
        lambda e: F.coalesce(
            F.contains(F.lower(F.try_element_at(metadata, e["key"])), F.lower(e["value"])),
            F.lit(False),
        ),
    )


def search_width(k: int, filters: Column, overfetch: int = OVERFETCH) -> Column:
    """How many neighbours to fetch: three times k when there are filters to apply later."""
    return F.when(F.size(filters) > 0, F.lit(k * overfetch)).otherwise(F.lit(k))


def filter_ranked(
    ranked: DataFrame, keep: Column, k: int, filters: Column, overfetch: int = OVERFETCH
) -> DataFrame:
    """Apply filters to lists fetched at ``overfetch * k`` and renumber the first *k*."""
    kept = ranked.where(F.col("rank") <= search_width(k, filters, overfetch)).where(keep)
    return top_k_per_group(
        kept.withColumnRenamed("rank", "found_rank"), ["qid"], [F.asc("found_rank")], k
    ).drop("found_rank")


def keyword_score(question: Column, content: Column, stop_words=STOP_WORDS) -> Column:
    """How often the words of the question occur in *content*; repeated words count again."""
    stop = F.array(*[F.lit(w) for w in stop_words])
    asked = F.filter(words(question), lambda t: ~F.array_contains(stop, t))
    # one pass over the text leaves the few words that count
    return let(
        asked,
        lambda q: let(
            F.array_distinct(q),
            lambda different: let(
                F.filter(words(content), lambda w: F.array_contains(different, w)),
                lambda h: F.aggregate(
                    q, F.lit(0), lambda total, t: total + F.size(h) - F.size(F.array_remove(h, t))
                ),
            ),
        ),
    )


def keyword_rerank(
    ranked: DataFrame, k: int, question: str = "question", content: str = "content"
) -> DataFrame:
    """Reorder each list by keyword score; equal scores keep their order."""
    scored = ranked.withColumn(
        "keyword_score", keyword_score(F.col(question), F.col(content))
    ).withColumnRenamed("rank", "prior_rank")
    return top_k_per_group(
        scored, ["qid"], [F.desc("keyword_score"), F.asc("prior_rank")], k
    )


def reciprocal_rank_fusion(
    *lists: DataFrame, k: int = 4, constant: int = RRF_CONSTANT, doc_id: str = "doc_id"
) -> DataFrame:
    """Fuse ranked lists ``(qid, doc_id, rank)``: sum of 1 / (constant + rank).

    Equal sums go to the list given first, then to the better rank in it.
    """
    tagged = [
        part.select(
            "qid",
            doc_id,
            (F.lit(1.0) / (F.lit(constant) + F.col("rank"))).alias("part"),
            F.struct(F.lit(number).alias("list"), F.col("rank").alias("rank")).alias("place"),
        )
        for number, part in enumerate(lists)
    ]
    fused = (
        reduce(DataFrame.unionByName, tagged)
        .groupBy("qid", doc_id)
        .agg(F.round(F.sum("part"), 12).alias("score"), F.min("place").alias("place"))
    )
    return top_k_per_group(fused, ["qid"], [F.desc("score"), F.asc("place")], k).drop("place")


def pack_context(
    ranked: DataFrame,
    max_tokens: int = MAX_CONTEXT_TOKENS,
    content: str = "content",
    token_count: str | None = None,
    token_model: str = "words",
) -> DataFrame:
    """Leading documents of each list whose running token sum stays within *max_tokens*.

    Counts are never negative, so the running sum passes the limit once and stays above it: a plain
    comparison equals stopping at the first document that does not fit.
    """
    measured = token_length(F.col(content), token_model)
    tokens = F.coalesce(F.col(token_count), measured) if token_count else measured
    window = (
        Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        ranked.withColumn("tokens", tokens.cast("bigint"))
        .withColumn("tokens_used", F.sum("tokens").over(window))
        .where(F.col("tokens_used") <= max_tokens)
    )


def rank_scores(ranked: DataFrame, doc: str = "source", keep: str = "best") -> DataFrame:
    """Rank lists as evaluation runs ``(qid, doc_id, score)`` with score 1 / rank per source.

    Several chunks of one source: ``best`` keeps its best rank, ``last`` its worst, ``both`` gives
    them as columns of these names.
    """
    score = F.lit(1.0) / F.col("rank")
    best, last = F.max(score), F.min(score)
    values = {
        "best": [best.alias("score")],
        "last": [last.alias("score")],
        "both": [best.alias("best"), last.alias("last")],
    }
    return ranked.groupBy("qid", F.col(doc).alias("doc_id")).agg(*values[keep])
