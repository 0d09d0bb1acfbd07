"""Document store on parquet tables, bucketed by key.

A write touches only the buckets of its keys: they are read, merged and replaced with Spark's
dynamic partition overwrite, which stages the new files before it moves them in place. Deleted rows
stay as markers without content until :meth:`BucketTable.purge`, so an emptied bucket is replaced
too. One writer at a time; readers never need a lock.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docquarry import schema as S
from docquarry.functions.text import words
from docquarry.session import Scratch, cut_lineage

# ---------------------------------------------------------------- plain operators


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row with the largest *version* per key; partial maxima keep hot keys cheap."""
    packed = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(packed, F.col(version)).alias("__row")).select("__row.*")


def upsert(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """*existing* with the rows of *incoming* (unique keys) replacing or added to it."""
    kept = existing.join(incoming.select(key), key, "left_anti").select(*existing.columns)
    return kept.unionByName(incoming.select(*existing.columns))


def delete_rows(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return existing.join(ids.select(key), key, "left_anti").select(*existing.columns)


def delete_status(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """``(key, deleted)`` per requested id: whether there was such a row."""
    known = existing.select(key, F.lit(True).alias("__known"))
    return (
        ids.select(key).distinct().join(known, key, "left")
        .select(key, F.coalesce("__known", F.lit(False)).alias("deleted"))
    )


def lookup(existing: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of the requested ids; unknown ids are left out."""
    return existing.join(ids.select(key), key, "left_semi")


def generated_ids(df: DataFrame, ordinal: str, given: str | None = None) -> DataFrame:
    """``doc_id`` from the metadata, else ``doc_`` and the ordinal."""
    made = F.concat(F.lit("doc_"), F.col(ordinal).cast("string"))
    return df.withColumn("doc_id", F.coalesce(F.col(given).cast("string"), made) if given else made)


def contains_text(content: Column, query: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(content), F.lit(query.lower()))


def has_all_terms(content: Column, query: str) -> Column:
    """Every word of *query* occurs as a word of *content*, ignoring case."""
    return F.size(F.array_except(words(F.lit(query)), words(content))) == 0


def metadata_equals(filters: Mapping[str, str], metadata: str = "metadata") -> Column:
    test = F.lit(True)
    for key, value in filters.items():
        held = F.try_element_at(F.col(metadata), F.lit(key))
        test = test & F.coalesce(held == F.lit(str(value)), F.lit(False))
    return test


def search(
    docs: DataFrame,
    *,
    match: Column | None = None,
    where: Column | None = None,
    limit: int | None = None,
    order: str = "doc_id",
    limit_first: bool = True,
) -> DataFrame:
    """Text match, metadata filter and limit.

    With *limit_first* the limit takes the first matching rows before the filter sees them, so
    fewer rows may come back; otherwise the filter goes first. No limit or 0 means all rows.
    """
    if match is not None:
        docs = docs.where(match)
    if where is not None and not (limit_first and limit):
        docs = docs.where(where)
    if limit:
        docs = docs.orderBy(order).limit(limit)
    if where is not None and limit_first and limit:
        docs = docs.where(where)
    return docs


def source_list(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Sources with ``chunk_count``; chunks are counted before the join."""
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("__n"))
    return (
        sources.join(counts, "source_id", "left")
        .withColumn("chunk_count", F.coalesce("__n", F.lit(0)).cast("bigint"))
        .drop("__n")
    )


def ordered_chunks(chunks: DataFrame, sources: DataFrame | None = None) -> DataFrame:
    """Chunks in ``(source_id, chunk_order)`` order, of the given sources only."""
    if sources is not None:
        chunks = chunks.join(sources.select("source_id"), "source_id", "left_semi")
    return chunks.orderBy("source_id", "chunk_order")


def file_listing(listed: DataFrame) -> DataFrame:
    """Display columns of indexed files with defaults for what is unknown."""

    def held(key: str) -> Column:
        return F.coalesce(F.try_element_at("metadata", F.lit(key)), F.lit("")).alias(key)

    return listed.select(
        F.col("location").alias("file_path"),
        F.coalesce("content_type", F.lit("unknown")).alias("file_type"),
        F.col("chunk_count").alias("num_chunks"),
        F.coalesce("size_bytes", F.lit(0)).alias("file_size"),
        "indexed_at",
        F.coalesce("last_modified", F.lit(0.0)).alias("last_modified"),
        *[
            held(key)
            for key in (
                "embedding_model",
                "embedding_model_version",
                "document_loader",
                "tokenizer",
                "text_splitter",
            )
        ],
    )


def size_label(size: Column) -> Column:
    return F.when(size.isNotNull(), F.format_string("%.1f KB", F.bround(size / F.lit(1024.0), 1))).otherwise(
        F.lit("N/A")
    )


def display_listing(listed: DataFrame) -> DataFrame:
    """File path, type, local time of the last change, size in KB and chunks."""
    changed = F.date_format(F.timestamp_seconds("last_modified"), "yyyy-MM-dd HH:mm:ss")
    return listed.select(
        F.col("location").alias("file_path"),
        F.coalesce("content_type", F.lit("text/plain")).alias("file_type"),
        F.coalesce(changed, F.lit("N/A")).alias("last_modified"),
        size_label(F.col("size_bytes")).alias("size"),
        F.col("chunk_count").alias("chunks"),
    )


def largest_sources(listed: DataFrame, k: int = 5) -> DataFrame:
    """The k largest sources with a one-line summary; unknown sizes count as 0."""
    return (
        listed.orderBy(F.desc(F.coalesce("size_bytes", F.lit(0))), "source_id")
        .limit(k)
        .select(
            F.col("location").alias("file_path"),
            F.coalesce("content_type", F.lit("text/plain")).alias("file_type"),
            F.format_string("Document with %d chunks", F.col("chunk_count")).alias("summary"),
            F.col("chunk_count").alias("num_chunks"),
        )
    )


def index_stats(listed: DataFrame) -> DataFrame:
    return listed.agg(
        F.count(F.lit(1)).alias("document_count"),
        F.coalesce(F.sum(F.coalesce("size_bytes", F.lit(0))), F.lit(0)).alias("total_size"),
        F.coalesce(F.sum("chunk_count"), F.lit(0)).alias("chunk_count"),
    )


def merge_metadata(old: Column, new: Column) -> Column:
    """Union of two maps; the new value wins."""
    kept = F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k))
    return F.coalesce(F.map_concat(kept, new), old, new)


# ---------------------------------------------------------------- stored tables


class BucketTable:
    """A keyed parquet table, partitioned by the hash bucket of *by*, its key unless given.

    Whatever concerns some values of *by* reads and rewrites their buckets only. Rows that replace
    nothing are appended. A rewritten bucket holds one placeholder row that is not ``live``, so that
    a bucket that lost all its rows is overwritten like the others.
    """

    def __init__(
        self, spark: SparkSession, path: str, ddl: str, key: str, buckets: int, by: str | None = None
    ) -> None:
        self.spark, self.path, self.ddl, self.key, self.buckets = spark, path, ddl, key, buckets
        self.by = by or key

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(self.buckets)).cast("int")

    def _stored(self) -> DataFrame:
        full = f"{self.ddl}, live boolean, bucket int"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return S.empty(self.spark, full)
        return self.spark.read.schema(full).parquet(self.path)

    def located(self) -> DataFrame:
        """All rows with their ``bucket``, the partition column that joins and filters prune by."""
        return self._stored().where("live").drop("live")

    def read(self) -> DataFrame:
        return self.located().drop("bucket")

    def _buckets_of(self, values: DataFrame) -> list[int]:
        """Buckets of some values of *by*; at most ``buckets`` rows reach the driver."""
        return [r[0] for r in values.select(self._bucket()).distinct().collect()]

    def of(self, owners: DataFrame) -> DataFrame:
        """Rows whose *by* is in *owners*; only their buckets are read."""
        rows = self.located().where(F.col("bucket").isin(self._buckets_of(owners)))
        return rows.drop("bucket").join(owners.select(self.by), self.by, "left_semi")

    def of_value(self, value: str) -> DataFrame:
        """Rows of one value of *by*, from its bucket."""
        held = self.spark.createDataFrame([(value,)], f"{self.by} string")
        rows = self.located().where(F.col("bucket").isin(self._buckets_of(held)))
        return rows.where(F.col(self.by) == value).drop("bucket")

    def get(self, ids: Sequence[str]) -> DataFrame:
        """Rows of some keys; the filter reaches the scan, and the buckets where the key names them."""
        rows = self.located()
        if self.by == self.key:
            held = self.spark.createDataFrame([(i,) for i in ids], f"{self.key} string")
            rows = rows.where(F.col("bucket").isin(self._buckets_of(held)))
        return rows.where(F.col(self.key).isin(list(ids))).drop("bucket")

    def _write(self, incoming: DataFrame | None, gone: DataFrame, on: str) -> None:
        """Remove the rows whose *on* is in *gone*, then add *incoming*; both are written tables."""
        stored = self.located()
        if on == self.by:
            stored = stored.where(F.col("bucket").isin(self._buckets_of(gone)))
        # two narrow columns decide which buckets hold a row to remove
        held = stored.select(on, "bucket").join(gone, on, "left_semi").select("bucket").distinct()
        rewrite = [r[0] for r in held.collect()]
        rows = S.empty(self.spark, self.ddl) if incoming is None else incoming
        placed = rows.withColumns({"live": F.lit(True), "bucket": self._bucket()})
        if rewrite:
            kept = self.located().where(F.col("bucket").isin(rewrite)).join(gone, on, "left_anti")
            full = S.conform(kept.withColumn("live", F.lit(True)), f"{self.ddl}, live boolean, bucket int")
            holders = self.spark.createDataFrame([(b, False) for b in rewrite], "bucket int, live boolean")
            merged = (
                full.unionByName(placed.where(F.col("bucket").isin(rewrite)))
                .unionByName(S.conform(holders, f"{self.ddl}, live boolean, bucket int"))
            )
            self._save(merged, "overwrite")
        if incoming is not None:
            self._save(placed.where(~F.col("bucket").isin(rewrite)), "append")

    def _save(self, rows: DataFrame, mode: str) -> None:
        (
            # rebalancing by bucket lets Spark split large buckets and join small ones at run time
            rows.hint("rebalance", "bucket")
            .write.mode(mode)
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy("bucket")
            .parquet(self.path)
        )

    def upsert(self, rows: DataFrame) -> None:
        """Insert or replace *rows*; their keys must be unique."""
        with Scratch(self.spark) as scratch:
            incoming = scratch.cut(S.conform(rows, self.ddl))
            self._write(incoming, incoming.select(self.key), self.key)

    def replace(self, rows: DataFrame, owners: DataFrame) -> None:
        """Put *rows* in the place of all rows whose *by* is in *owners*; both are written tables."""
        self._write(S.conform(rows, self.ddl), owners.select(self.by).distinct(), self.by)

    def delete(self, ids: DataFrame, on: str | None = None) -> None:
        """Delete the rows whose key, or column *on*, is in *ids*."""
        column = on or self.key
        with Scratch(self.spark) as scratch:
            gone = scratch.cut(ids.select(column).distinct())
            self._write(None, gone, column)

    def clear(self) -> None:
        S.empty(self.spark, f"{self.ddl}, live boolean, bucket int").write.mode("overwrite").option(
            "partitionOverwriteMode", "static"
        ).partitionBy("bucket").parquet(self.path)

    def purge(self, target: str) -> BucketTable:
        """A compact copy without placeholders and small files at *target*."""
        copy = BucketTable(self.spark, target, self.ddl, self.key, self.buckets, self.by)
        copy._save(self._stored().where("live"), "overwrite")
        return copy


class DocumentStore:
    """Sources, chunks, vectors and settings below one folder."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.sources = BucketTable(spark, f"{self.root}/sources", S.SOURCES, "source_id", buckets)
        self.chunks = BucketTable(spark, f"{self.root}/chunks", S.CHUNKS, "doc_id", buckets, "source_id")
        self.vectors = BucketTable(spark, f"{self.root}/vectors", S.VECTORS, "doc_id", buckets, "source_id")
        self.unfinished = BucketTable(spark, f"{self.root}/unfinished", S.UNFINISHED, "doc_id", buckets, "source_id")
        self.settings = BucketTable(spark, f"{self.root}/settings", S.SETTINGS, "key", 1)

    # documents
    def add_documents(self, docs: DataFrame) -> None:
        self.chunks.upsert(docs)

    def get_document(self, doc_id: str) -> DataFrame:
        return self.chunks.get([doc_id])

    def get_documents_by_ids(self, ids: DataFrame) -> DataFrame:
        return lookup(self.chunks.read(), ids, "doc_id")

    def document_exists(self, doc_id: str) -> bool:
        return not self.chunks.get([doc_id]).isEmpty()

    def list_document_ids(self) -> DataFrame:
        return self.chunks.read().select("doc_id").orderBy("doc_id")

    def document_total(self) -> DataFrame:
        return self.chunks.read().agg(F.count(F.lit(1)).alias("documents"))

    def count_documents(self) -> int:
        return self.document_total().first()[0]

    def delete_documents(self, ids: DataFrame) -> DataFrame:
        """Delete chunks with their vectors; the status per id is taken before the deletion."""
        status = cut_lineage(delete_status(self.chunks.read(), ids, "doc_id"))
        self.chunks.delete(ids)
        self.vectors.delete(ids)
        self.unfinished.delete(ids)
        return status

    def search_documents(
        self,
        query: str | None = None,
        metadata_filter: Mapping[str, str] | None = None,
        limit: int | None = None,
        *,
        mode: str = "terms",
        limit_first: bool = False,
    ) -> DataFrame:
        """Chunks that match; *limit_first* takes the first chunks and filters those only."""
        match = None
        if query:
            test = has_all_terms if mode == "terms" else contains_text
            match = test(F.col("content"), query)
        where = metadata_equals(metadata_filter) if metadata_filter else None
        return search(
            self.chunks.read(), match=match, where=where, limit=limit, limit_first=limit_first
        )

    # sources
    def add_sources(self, sources: DataFrame) -> None:
        self.sources.upsert(sources)

    def list_sources(self) -> DataFrame:
        listed = source_list(self.sources.read(), self.chunks.read())
        return listed.orderBy(F.desc("indexed_at"), "source_id")

    def get_source(self, source_id: str) -> DataFrame:
        return source_list(self.sources.get([source_id]), self.chunks.of_value(source_id))

    def source_chunks(self, source_id: str) -> DataFrame:
        return ordered_chunks(self.chunks.of_value(source_id))

    def remove_sources(self, ids: DataFrame) -> None:
        """Delete sources, their chunks and their vectors."""
        for table in (self.vectors, self.unfinished, self.chunks, self.sources):
            table.delete(ids, "source_id")

    def update_source_metadata(self, changes: DataFrame) -> None:
        """Merge ``(source_id, metadata)`` into known sources."""
        new = changes.select("source_id", F.col("metadata").alias("__new"))
        merged = (
            self.sources.read()
            .join(new, "source_id")
            .withColumn("metadata", merge_metadata(F.col("metadata"), F.col("__new")))
            .drop("__new")
        )
        self.sources.upsert(merged)

    def chunk_hashes(self) -> DataFrame:
        return self.chunks.read().select("source_id", "chunk_order", "chunk_hash")

    def clear_catalog(self) -> None:
        """Forget the sources; chunks and vectors stay."""
        self.sources.clear()

    def clear(self) -> None:
        for table in (self.sources, self.chunks, self.vectors, self.unfinished):
            table.clear()

    # settings
    def set_setting(self, key: str, value: str) -> None:
        self.settings.upsert(self.spark.createDataFrame([(key, value)], S.SETTINGS))

    def get_setting(self, key: str) -> str | None:
        row = self.settings.get([key]).first()
        return row["value"] if row else None

