"""Sources that are already tables: parquet fixtures and in-memory rows."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMORY = "source_id string, text string, content_type string, metadata map<string,string>"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a scan with fewer partitions than cores as many as there are cores.

    A file of one row group is one task, however large. Large tables have partitions enough and
    come back unchanged. Only for plain scans: the number of partitions is read from the plan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def memory_source(spark: SparkSession, rows: Iterable[tuple]) -> DataFrame:
    """``(source_id, text, content_type, metadata)`` rows as a source."""
    return spark.createDataFrame(list(rows), MEMORY)


def select_sources(
    sources: DataFrame,
    prefix: str | None = None,
    content_type: str | None = None,
    metadata_filter: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Sources by id prefix, type and metadata equality, all optional, sorted by id."""
    out = sources
    if prefix:
        out = out.where(F.col("source_id").startswith(prefix))
    if content_type:
        out = out.where(F.col("content_type") == content_type)
    for key, value in (metadata_filter or {}).items():
        held = F.col(key) if key in sources.columns else F.try_element_at("metadata", F.lit(key))
        out = out.where(held == value)
    return out.orderBy("source_id")


def text_sources(
    df: DataFrame, source_id: Column, text: Column, content_type: Column, **metadata: Column
) -> DataFrame:
    """Any table as a ``sources`` frame with text."""
    from docquarry.operators.chunking import metadata_map

    return df.select(
        source_id.cast("string").alias("source_id"),
        source_id.cast("string").alias("location"),
        content_type.alias("content_type"),
        text.alias("text"),
        F.sha2(text, 256).alias("content_hash"),
        F.length(text).cast("bigint").alias("size_bytes"),
        F.lit(None).cast("double").alias("last_modified"),
        (metadata_map(metadata) if metadata else F.expr("cast(map() as map<string,string>)")).alias(
            "metadata"
        ),
    )
