"""Relational stores over JDBC, for tables that live in a database server."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_jdbc(
    spark: SparkSession, url: str, table: str, *, partition: tuple[str, int, int, int] | None = None, **options
) -> DataFrame:
    """A table; *partition* ``(column, low, high, count)`` reads it in parallel."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition:
        column, low, high, count = partition
        reader = reader.options(
            partitionColumn=column, lowerBound=low, upperBound=high, numPartitions=count
        )
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
