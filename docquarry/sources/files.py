"""Files below a folder, through Spark's ``binaryFile`` source."""

from __future__ import annotations

import posixpath
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry.errors import PathOutsideRoot, SourceError
from docquarry.functions import mime as M
from docquarry.functions.text import path_glob_match
from docquarry.operators.chunking import metadata_map


def _file_system(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def folder_exists(spark: SparkSession, root: str) -> bool:
    files, path = _file_system(spark, root)
    return files.exists(path) and files.getFileStatus(path).isDirectory()


def qualified(spark: SparkSession, root: str) -> str:
    files, path = _file_system(spark, root)
    return files.makeQualified(path).toString().rstrip("/")


def resolve(root: str, source_id: str) -> str:
    """Location of *source_id*; it must stay below *root*."""
    joined = posixpath.normpath(posixpath.join("/", source_id.lstrip("/")))
    plain = posixpath.normpath(source_id)
    if plain.startswith("..") or posixpath.isabs(source_id) or joined == "/":
        raise PathOutsideRoot("document id outside its folder", source_id=source_id)
    return f"{root.rstrip('/')}{joined}"


def is_supported_path(path: Column) -> Column:
    """Extension test only; hidden files never count. Null for unregistered extensions."""
    hidden = F.regexp_extract(path, r"([^/]*)$", 1).startswith(".")
    return F.when(hidden, F.lit(False)).otherwise(M.is_supported(M.by_extension(path)))


def path_filter(
    path: Column, file_types: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> Column:
    """Keep the given extensions, drop the excluded glob patterns."""
    tests = [M.extension(path).isin([t.lower() for t in file_types])] if file_types else []
    tests += [~path_glob_match(path, pattern) for pattern in exclude]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """All visible files with content, as columns of ``binaryFile`` plus ``source_id``.

    Spark leaves out names that start with ``.`` or ``_``.
    """
    if not folder_exists(spark, root):
        raise SourceError("folder not found", root=root)
    base = qualified(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    decoded = F.regexp_replace(F.col("path"), "^file:/+", "/")
    plain = base.replace("file://", "").replace("file:", "")
    relative = F.substr(decoded, F.lit(len(plain.rstrip("/")) + 2))
    return files.withColumn("source_id", relative)


def list_documents(
    spark: SparkSession,
    root: str,
    file_types: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Sorted ids of the supported files; decided by name, so no content is read."""
    ids = scan(spark, root).select("source_id")
    return ids.where(
        is_supported_path(F.col("source_id")) & path_filter(F.col("source_id"), file_types, exclude)
    ).orderBy("source_id")


def describe(files: DataFrame) -> DataFrame:
    """Source rows of scanned files: type, text when it is valid UTF-8 text, hash, stats."""
    kind = M.content_type(F.col("source_id"), F.col("content"))
    raw = F.col("content").cast("string")
    text = F.when(F.col("content_type").startswith("text/") & F.is_valid_utf8(raw), raw)
    name = F.regexp_extract("source_id", r"([^/]*)$", 1)
    modified = F.col("modificationTime").cast("double")
    return (
        files.withColumn("content_type", kind)
        .where(M.is_supported(F.col("content_type")))
        .withColumn("text", text)
        .withColumn("content_hash", F.sha2("content", 256))
        .select(
            "source_id",
            F.col("path").alias("location"),
            "content_type",
            "content",
            "text",
            "content_hash",
            F.col("length").alias("size_bytes"),
            modified.alias("last_modified"),
            metadata_map(
                {
                    "file_name": name,
                    "file_size": F.col("length"),
                    "modified_time": F.date_format("modificationTime", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
                    "file_extension": F.regexp_extract(name, r".(\.[^.]+)$", 1),
                    "content_hash": F.col("content_hash"),
                }
            ).alias("metadata"),
        )
    )


def read_documents(
    spark: SparkSession,
    root: str,
    file_types: Sequence[str] | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Supported files of a folder as a ``sources`` frame with content."""
    files = scan(spark, root).where(path_filter(F.col("source_id"), file_types, exclude))
    return describe(files)


def get_document(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """One file, or no row when it is missing or unsupported."""
    location = resolve(root, source_id)
    files, path = _file_system(spark, location)
    if not files.exists(path) or not files.getFileStatus(path).isFile():
        return describe(scan(spark, root).where(F.lit(False)))
    one = spark.read.format("binaryFile").load(location).withColumn("source_id", F.lit(source_id))
    return describe(one)


def get_documents(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """The files named in *ids*; missing ones are left out."""
    return read_documents(spark, root).join(ids.select("source_id"), "source_id", "left_semi")


def document_exists(spark: SparkSession, root: str, source_id: str) -> bool:
    """Whether the id names a file of a supported type; a folder is none."""
    return not get_document(spark, root, source_id).isEmpty()


def document_metadata(spark: SparkSession, root: str) -> DataFrame:
    """Size and time per file without reading any content."""
    return scan(spark, root).select(
        "source_id",
        M.by_extension(F.col("source_id")).alias("content_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").cast("double").alias("last_modified"),
    )
