"""What several operators of this folder share: written steps, row keys, batches of bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.session import scratch_path
from docquarry.sources.tables import read_table

# A-Z lower-cased byte by byte, whatever the locale.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


class Written:
    """A DataFrame written once below the shared folder, to be read many times and then deleted."""

    def __init__(self, df: DataFrame, label: str) -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, label)
        self.schema = df.schema
        df.write.parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def append(self, df: DataFrame) -> None:
        """Add the rows of *df*."""
        df.select(*self.schema.names).write.mode("append").parquet(self.path)

    def delete(self) -> None:
        delete_path(self.spark, self.path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table whose heavy per-row work reaches every core: a scan of fewer tasks is dealt anew."""
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def ascii_lower(text: Column) -> Column:
    """*text* with A-Z lower-cased and every other letter kept."""
    return F.translate(text, UPPER, LOWER)


def fold(key: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo *parts*; a null id is in fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def utf8_rows(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each value of a string column; null is empty."""
    for value in column.cast(pa.large_binary()).to_pylist():
        yield value or b""


def mix64(values):
    """Spread the bits of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    import numpy as np

    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))
