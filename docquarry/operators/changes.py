"""Exact deduplication and change detection for incremental indexing."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keep_first(
    df: DataFrame,
    within: Sequence[str],
    content: str = "content",
    order: str = "chunk_index",
) -> DataFrame:
    """One row per exact content within each group, the one with the smallest *order*.

    Grouping by digest keeps the first row per group already on the map side, so a group of copies
    of any size costs one row per task and the input is computed once.
    """
    row = F.struct(*[F.col(c) for c in df.columns])
    return (
        df.groupBy(*[F.col(c).alias(f"__{c}") for c in within], F.sha2(content, 256).alias("__digest"))
        .agg(F.min_by(row, F.col(order)).alias("__row"))
        .select("__row.*")
    )


def content_filter(df: DataFrame, tests: Sequence[Column]) -> DataFrame:
    """Rows that pass every test; a null result fails."""
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


# What makes an indexed source stale, besides being unknown.
def reindex_reasons(
    incoming: DataFrame,
    indexed: DataFrame,
    *,
    chunk_size: int,
    chunk_overlap: int,
    model: str | Column,
    model_version: str,
    keep_newer: bool = False,
) -> DataFrame:
    """Add ``reason`` (null when the source is up to date) to every incoming source.

    Both sides have ``source_id, content_hash, last_modified``; *indexed* also has
    ``chunk_size, chunk_overlap, embedding_model, embedding_model_version``. *model* may be a column
    of the incoming side. With *keep_newer* a version older than the indexed one is no reason; times of 0
    or null are unknown and not compared.
    """
    old = indexed.select(
        "source_id",
        F.lit(True).alias("__known"),
        *[
            F.col(c).alias(f"__{c}")
            for c in (
                "content_hash",
                "last_modified",
                "chunk_size",
                "chunk_overlap",
                "embedding_model",
                "embedding_model_version",
            )
        ],
    )

    def differs(left: Column, right: Column) -> Column:
        return ~left.eqNullSafe(right)

    def known(time: Column) -> Column:
        return F.nullif(time.cast("double"), F.lit(0.0))

    late = F.lit(keep_newer) & F.coalesce(
        known(F.col("last_modified")) < known(F.col("__last_modified")), F.lit(False)
    )
    reason = (
        F.when(F.col("__known").isNull(), F.lit("new"))
        .when(late, F.lit(None).cast("string"))
        .when(differs(F.col("content_hash"), F.col("__content_hash")), F.lit("content"))
        .when(
            differs(F.col("__chunk_size"), F.lit(chunk_size))
            | differs(F.col("__chunk_overlap"), F.lit(chunk_overlap)),
            F.lit("chunking"),
        )
        .when(
            (F.coalesce("__last_modified", F.lit(0.0)) != 0)
            & (F.col("__last_modified") < F.col("last_modified")),
            F.lit("modified"),
        )
        .when(
            differs(F.col("__embedding_model"), F.lit(model))
            | differs(F.col("__embedding_model_version"), F.lit(model_version)),
            F.lit("model"),
        )
    )
    return (
        incoming.join(old, "source_id", "left")
        .withColumn("reason", reason)
        .select(*incoming.columns, "reason")
    )


def chunk_changes(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """``(source_id, chunk_hash, status)`` with status ``new``, ``kept`` or ``gone``.

    Hashes are counted per side first, so repeated chunks never multiply in the join.
    """
    key = ["source_id", "chunk_hash"]
    both = (
        incoming.select(*key, F.lit(1).alias("now"), F.lit(0).alias("before"))
        .unionByName(stored.select(*key, F.lit(0).alias("now"), F.lit(1).alias("before")))
        .groupBy(*key)
        .agg(F.max("now").alias("now"), F.max("before").alias("before"))
    )
    status = (
        F.when(F.col("before") == 0, F.lit("new"))
        .when(F.col("now") == 0, F.lit("gone"))
        .otherwise(F.lit("kept"))
    )
    return both.select(*key, status.alias("status"))
