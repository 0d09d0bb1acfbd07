"""Indexing: sources to chunks, vectors and catalog rows."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry import schema as S
from docquarry.clock import SystemClock
from docquarry.config import EngineConfig
from docquarry.operators import changes, chunking, embed, metadata
from docquarry.operators.store import DocumentStore, merge_metadata
from docquarry.session import Scratch, cut_lineage

Parser = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Transforms:
    """Optional steps between loading and storing.

    ``parsers``: per content type, sources to chunks (``content``, ``chunk_index``, ``chunk_total``);
    ``extractors``: new chunk columns; ``filters``: tests every chunk must pass.
    """

    parsers: Mapping[str, Parser] = field(default_factory=dict)
    extractors: Mapping[str, Column] = field(default_factory=dict)
    filters: Sequence[Column] = ()
    deduplicate: bool = False


@dataclass(frozen=True)
class IngestResult:
    """Counters per stage and the error rows ``(stage, error_type, error_message, source_id)``."""

    counts: dict[str, int]
    errors: DataFrame

    @property
    def success(self) -> bool:
        return self.counts["errors"] == 0


COUNTERS = ("documents_loaded", "chunks_stored", "embeddings_reused", "vectors_stored", "errors")
CHUNK_COLUMNS = (
    "source_id",
    "location",
    "content_type",
    "title",
    "chunk_index",
    "chunk_total",
    "content",
    "chunk_start_char",
    "chunk_end_char",
    "closest_heading",
    "heading_path",
    "text_splitter",
)


def transform(
    sources: DataFrame, config: EngineConfig, steps: Transforms | None = None
) -> DataFrame:
    """Chunks of *sources* (``source_id, location, content_type, text``), all steps row-local
    except the optional deduplication."""
    steps = steps or Transforms()
    special = list(steps.parsers)
    plain = sources.where(~F.col("content_type").isin(special)) if special else sources
    described = metadata.extract_metadata(plain.where(F.length("text") > 0))
    chunks = chunking.split_documents(described, config.chunks).select(*CHUNK_COLUMNS)
    for mime, parser in steps.parsers.items():
        parsed = parser(sources.where(F.col("content_type") == mime))
        missing = [c for c in CHUNK_COLUMNS if c not in parsed.columns]
        types = {f.name: f.dataType for f in chunks.schema.fields}
        parsed = parsed.withColumns({c: F.lit(None).cast(types[c]) for c in missing})
        chunks = chunks.unionByName(parsed.select(*CHUNK_COLUMNS))
    if steps.extractors:
        chunks = chunks.withColumns(dict(steps.extractors))
    chunks = changes.content_filter(chunks, steps.filters)
    if steps.deduplicate:
        chunks = changes.keep_first(chunks, ["source_id"])
    return chunks


def chunk_id(source_id: Column, order: Column) -> Column:
    return F.concat(source_id, F.lit("#chunk"), order.cast("string"))


def chunk_rows(chunks: DataFrame, config: EngineConfig, now: float) -> DataFrame:
    """Rows of the ``chunks`` table."""
    enriched = chunking.enrich(chunks, now, config.chunks.token_model)
    kept = {
        "source": F.col("source_id"),
        "content_type": F.col("content_type"),
        "chunk_index": F.col("chunk_index"),
        "total_chunks": F.col("chunk_total"),
        "text_splitter": F.col("text_splitter"),
        "tokenizer": F.col("tokenizer"),
        "processed_at": F.col("processed_at"),
    }
    extra = [c for c in chunks.columns if c not in CHUNK_COLUMNS]
    kept.update({c: F.col(c) for c in extra})
    return enriched.select(
        chunk_id(F.col("source_id"), F.col("chunk_index")).alias("doc_id"),
        "source_id",
        F.col("chunk_index").alias("chunk_order"),
        "content",
        "chunk_start_char",
        "chunk_end_char",
        "token_count",
        F.sha2("content", 256).alias("chunk_hash"),
        "title",
        "heading_path",
        "closest_heading",
        chunking.metadata_map(kept).alias("metadata"),
    )


def chosen_model(config: EngineConfig) -> Column:
    """Name of the model of a source, by its path."""
    return embed.model_for_path(F.col("source_id"), config.model_map, config.embedding_model)


def source_rows(sources: DataFrame, config: EngineConfig, now: float) -> DataFrame:
    """Rows of the ``sources`` table, with the settings they were indexed under."""
    settings = {
        "chunk_size": F.lit(config.chunks.size),
        "chunk_overlap": F.lit(config.chunks.overlap),
        "embedding_model": chosen_model(config),
        "embedding_model_version": F.lit(config.embedding_version),
        "tokenizer": F.lit(config.chunks.token_model),
        "text_splitter": chunking.splitter_name(F.col("content_type"), config.chunks.semantic),
    }
    if "document_loader" in sources.columns:
        settings["document_loader"] = F.col("document_loader")
    described = chunking.metadata_map(settings)
    if "metadata" in sources.columns:
        described = merge_metadata(F.col("metadata"), described)
    return S.conform(
        sources.withColumns(
            {
                "indexed_at": F.lit(float(now)),
                "metadata": described,
            }
        ),
        S.SOURCES,
    )


def indexed_settings(stored: DataFrame) -> DataFrame:
    """Stored sources with their indexing settings as columns."""

    def held(key: str) -> Column:
        return F.try_element_at("metadata", F.lit(key))

    return stored.select(
        "source_id",
        "content_hash",
        "last_modified",
        held("chunk_size").cast("int").alias("chunk_size"),
        held("chunk_overlap").cast("int").alias("chunk_overlap"),
        held("embedding_model").alias("embedding_model"),
        held("embedding_model_version").alias("embedding_model_version"),
    )


def stale_sources(sources: DataFrame, store: DocumentStore, config: EngineConfig) -> DataFrame:
    """``(source_id, reason)`` of sources that are new or whose content, settings or model changed.

    A version that arrives after a newer one was indexed is left out.
    Only ids, hashes and times are compared; no text passes the join.
    """
    judged = changes.reindex_reasons(
        sources.select("source_id", "content_hash", "last_modified"),
        indexed_settings(store.sources.read()),
        chunk_size=config.chunks.size,
        chunk_overlap=config.chunks.overlap,
        model=chosen_model(config),
        model_version=config.embedding_version,
        keep_newer=True,
    )
    stale = judged.where(F.col("reason").isNotNull())
    return stale.groupBy("source_id").agg(F.min("reason").alias("reason"))


def ordinals(vectors: DataFrame, first: int, scratch: Scratch) -> DataFrame:
    """Number rows in ``(source_id, doc_id)`` order from *first*, without gaps.

    Rows are numbered within range partitions that are in order; the partitions' sizes, one row each, are
    added up. So all rows never pass one task.
    """
    ordered = vectors.repartitionByRange("source_id", "doc_id").sortWithinPartitions("source_id", "doc_id")
    placed = scratch.cut(
        ordered.withColumn("__part", F.spark_partition_id()).withColumn(
            "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    numbered = placed.join(offsets, "__part").withColumn("ordinal", F.lit(first) + F.col("__offset") + F.col("__at"))
    return numbered.drop("__part", "__at", "__offset")


def embed_by_model(chunks: DataFrame, models: Mapping[str, embed.Model]) -> DataFrame:
    """Vectors of *chunks*, each by the model that its column ``model`` names."""
    parts = [
        embed.embed(chunks.where(F.col("model") == name) if len(models) > 1 else chunks, model)
        for name, model in models.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def embed_unfinished(
    store: DocumentStore, config: EngineConfig, models: Mapping[str, embed.Model], but: DataFrame | None, scratch: Scratch
) -> tuple[int, DataFrame]:
    """Embed the chunks whose model failed in an earlier run: how many got a vector, and error rows.

    A chunk is tried in ``config.embedding_attempts`` runs. Sources of *but* are left out. Only the chunks
    that wait, and the buckets of their sources, are read. Vectors are keyed, so a run that was lost
    halfway is repeated without harm.
    """
    noted = store.unfinished.read()
    if noted.isEmpty():
        return 0, S.empty(store.spark, S.ERRORS)
    waiting = noted.where(
        (F.col("attempts") < config.embedding_attempts) & F.col("model").isin(list(models))
    )
    if but is not None:
        waiting = waiting.join(but.select("source_id"), "source_id", "left_anti")
    waiting = scratch.cut(waiting)
    if waiting.isEmpty():
        return 0, S.empty(store.spark, S.ERRORS)
    owners = waiting.select("source_id").distinct()
    texts = store.chunks.of(owners).select("doc_id", "content").join(waiting.drop("error"), "doc_id")
    made = scratch.cut(embed_by_model(texts, models).drop("content"))
    done = made.where(F.col("embedding").isNotNull())
    versioned = F.concat_ws(":", "model", F.lit(config.embedding_version))
    last = store.vectors.read().agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
    store.vectors.upsert(ordinals(done.withColumn("model", versioned), last, scratch))
    failed = made.where(F.col("embedding").isNull()).select(
        "doc_id", "source_id", "model", (F.col("attempts") + 1).alias("attempts"), F.col("embedding_error").alias("error")
    )
    others = store.unfinished.of(owners).join(waiting.select("doc_id"), "doc_id", "left_anti")
    store.unfinished.replace(scratch.cut(others.unionByName(failed)), owners)
    errors = failed.select(
        F.lit("embedding").alias("stage"), F.lit("EmbeddingError").alias("error_type"),
        F.col("error").alias("error_message"), "source_id",
    )
    return done.count(), cut_lineage(errors)


def ingest(
    sources: DataFrame,
    store: DocumentStore,
    config: EngineConfig,
    *,
    model: embed.Model | None = None,
    models: Mapping[str, embed.Model] | None = None,
    steps: Transforms | None = None,
    clock=None,
    force: bool = False,
    load: Callable[[DataFrame], DataFrame] | None = None,
) -> IngestResult:
    """Index *sources* (with ``text``, optionally ``load_error``) into *store*.

    Unchanged sources are skipped unless *force*; *load* turns the others into texts, so nothing is
    parsed before it is known to be needed. A changed source replaces its old chunks; vectors of
    chunks with the same text and model are reused. Chunks whose model failed are noted, and the next run embeds
    them, whether or not their source comes again. *models* are those of ``config.model_map`` that
    are not native; *model* is the default one.
    """
    now = (clock or SystemClock()).time()
    named = {config.embedding_model: model or embed.native_model(config.embedding_model, config.embedding_dim)}
    for name in config.model_map.values():
        if name not in named:
            given = (models or {}).get(name)
            named[name] = given or embed.native_model(name, config.embedding_dim)
    spark = sources.sparkSession
    with Scratch(spark) as scratch:
        if force:
            wanted = sources.withColumn("reason", F.lit("forced"))
            completed, late_errors = embed_unfinished(store, config, named, sources, scratch)
        else:
            stale = scratch.cut(stale_sources(sources, store, config))
            completed, late_errors = embed_unfinished(store, config, named, stale, scratch)
            if stale.isEmpty():
                counts = dict.fromkeys(COUNTERS, 0) | {"vectors_stored": completed, "errors": late_errors.count()}
                return IngestResult(counts, late_errors)
            wanted = sources.join(stale, "source_id")
        if load:
            wanted = load(wanted)
        if "load_error" not in wanted.columns:
            wanted = wanted.withColumn("load_error", F.lit(None).cast("string"))
        loaded = scratch.cut(wanted.drop("content") if "content" in wanted.columns else wanted)
        unusable = F.col("load_error").isNotNull() | F.col("text").isNull()
        errors = loaded.where(unusable).select(
            F.lit("loading").alias("stage"),
            F.lit("LoadError").alias("error_type"),
            F.coalesce("load_error", F.lit("no text")).alias("error_message"),
            "source_id",
        )
        usable = loaded.where(~unusable)
        owners = usable.select("source_id")
        chunks = scratch.cut(
            chunk_rows(transform(usable, config, steps), config, now).withColumn("model", chosen_model(config))
        )

        key = ["source_id", "chunk_hash", "model"]
        kept = (
            store.vectors.of(owners)
            .select("doc_id", "model", "embedding")
            .join(store.chunks.of(owners).select("doc_id", "source_id", "chunk_hash"), "doc_id")
            .groupBy(*key)
            .agg(F.any_value("embedding").alias("embedding"))
        )
        if force:
            kept = kept.where(F.lit(False))
        # names of models are stored with their version, so another version is another model
        versioned = F.concat_ws(":", "model", F.lit(config.embedding_version))
        # texts stay where they are written: only keys meet the stored vectors
        found = scratch.cut(
            chunks.select("doc_id", "source_id", "chunk_hash", F.col("model").alias("named"), versioned.alias("model"))
            .join(kept, key)
            .select("doc_id", "source_id", "chunk_hash", F.col("named").alias("model"), "embedding")
        )
        asked = chunks.select("doc_id", "source_id", "content", "model", "chunk_hash")
        if not found.isEmpty():
            asked = asked.join(found.select("doc_id", "chunk_hash").distinct(), ["doc_id", "chunk_hash"], "left_anti")
        columns = ["doc_id", "source_id", "model", "embedding", "embedding_error", "reused"]
        fresh = embed_by_model(asked.drop("chunk_hash"), named)
        reused = found.withColumn("embedding_error", F.lit(None).cast("string"))
        embedded = scratch.cut(
            fresh.withColumn("reused", F.lit(False)).select(*columns)
            .unionByName(reused.withColumn("reused", F.lit(True)).select(*columns))
        )
        errors = cut_lineage(
            errors.unionByName(late_errors).unionByName(
                embedded.where(F.col("embedding_error").isNotNull()).select(
                    F.lit("embedding").alias("stage"),
                    F.lit("EmbeddingError").alias("error_type"),
                    F.col("embedding_error").alias("error_message"),
                    "source_id",
                )
            )
        )
        vectors = embedded.where(F.col("embedding").isNotNull()).drop("reused")
        last = store.vectors.read().agg(F.coalesce(F.max("ordinal") + 1, F.lit(0))).first()[0]
        store.chunks.replace(chunks, owners)
        store.vectors.replace(scratch.cut(ordinals(vectors.withColumn("model", versioned), last, scratch)), owners)
        waiting = embedded.where(F.col("embedding").isNull() & (F.col("embedding_error") != embed.BLANK)).select(
            "doc_id", "source_id", "model", F.lit(1).alias("attempts"), F.col("embedding_error").alias("error")
        )
        if not (waiting.isEmpty() and store.unfinished.read().isEmpty()):
            store.unfinished.replace(waiting, owners)
        # last, so that a run that was lost before finds its sources stale
        store.sources.replace(source_rows(usable, config, now), owners)
        counts = embedded.agg(
            F.count_if("reused").alias("reused"), F.count("embedding").alias("vectors")
        ).first()
        return IngestResult(
            {
                "documents_loaded": usable.count(),
                "chunks_stored": chunks.count(),
                "embeddings_reused": counts["reused"],
                "vectors_stored": counts["vectors"] + completed,
                "errors": errors.count(),
            },
            errors,
        )


def processing_summary(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per content type: sources, sources that gave chunks, sources that failed, chunks."""
    counts = chunks.groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        sources.select("source_id", "content_type")
        .join(counts, "source_id", "left")
        .groupBy("content_type")
        .agg(
            F.count(F.lit(1)).alias("sources"),
            F.count("n").alias("succeeded"),
            (F.count(F.lit(1)) - F.count("n")).alias("failed"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"),
        )
    )
