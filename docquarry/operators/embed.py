"""Embedding of chunks: text preparation, model choice, cache, failure rows, remote models."""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.errors import EmbeddingError, ServiceError
from docquarry.functions import embedding as E
from docquarry.functions.text import glob_match, strip
from docquarry.operators.expand import slices

# Metadata written in front of the text, and copied to the vector rows.
PREFIX_KEYS = ("title", "author", "source", "category", "tags")
VECTOR_KEYS = ("title", "author", "date", "category", "content_type")
PREVIEW_CHARS = 1000
# Rows up to a count, and the batch size used there.
BATCH_STEPS = ((10, 1), (50, 5), (200, 10), (1000, 20))
LARGEST_BATCH = 50

NATIVE: dict[str, Callable[[Column, int], Column]] = {
    "sha256": E.sha256_embedding,
    "md5": E.md5_embedding,
    "codepoints": E.codepoint_embedding,
}


def prepared_text(content: Column, fields: Mapping[str, Column]) -> Column:
    """``key: value`` lines of the present *fields* in fixed order, a blank line, the content."""
    lines = F.concat_ws(
        "\n",
        *[
            F.when(fields[key].isNotNull(), F.concat(F.lit(f"{key}: "), fields[key]))
            for key in PREFIX_KEYS
            if key in fields
        ],
    )
    return F.when(F.length(lines) > 0, F.concat(lines, F.lit("\n\n"), content)).otherwise(content)


def vector_metadata(chunks: DataFrame, content: str = "content") -> DataFrame:
    """Columns stored beside a vector, with their defaults."""

    def column(name: str, default) -> Column:
        if name not in chunks.columns:
            return F.lit(default).alias(name)
        return F.coalesce(F.col(name), F.lit(default)).alias(name)

    extra = [F.col(key) for key in VECTOR_KEYS if key in chunks.columns]
    return chunks.select(
        F.substring(content, 1, PREVIEW_CHARS).alias("text"),
        column("source", ""),
        column("source_id", ""),
        column("chunk_index", 0),
        column("total_chunks", 1),
        *extra,
    )


def batch_size(count: Column) -> Column:
    """Rows per request for a job of *count* rows."""
    chain = F.lit(LARGEST_BATCH)
    for limit, size in reversed(BATCH_STEPS):
        chain = F.when(count <= limit, F.lit(size)).otherwise(chain)
    return chain


def model_for_path(path: Column, model_map: Mapping[str, str], default: str) -> Column:
    """Model of the first glob that matches *path*."""
    chain = F.lit(default)
    for pattern, model in reversed(list(model_map.items())):
        chain = F.when(glob_match(path, pattern), F.lit(model)).otherwise(chain)
    return chain


def load_model_map(lines: Sequence[str]) -> dict[str, str]:
    """Flat ``glob: model`` lines of a YAML file, in order."""
    out: dict[str, str] = {}
    for line in lines:
        body = line.split("#", 1)[0].strip() if not line.strip().startswith(("'", '"')) else line.strip()
        if not body or body == "---":
            continue
        key, separator, value = body.rpartition(":")
        if not separator:
            raise EmbeddingError("not a 'glob: model' line", line=line)
        out[key.strip().strip("'\"")] = value.strip().strip("'\"")
    return out


def cache_key(source: Column, chunk_index: Column, content: Column) -> Column:
    digest = F.substring(F.sha2(content, 256), 1, 16)
    return F.concat_ws(
        ":", F.coalesce(source, F.lit("unknown")), F.coalesce(chunk_index, F.lit(0)).cast("string"), digest
    )


@dataclass(frozen=True)
class Retry:
    """Exponential waits between attempts of a remote call."""

    attempts: int = 8
    first_wait: float = 1.0
    longest_wait: float = 60.0

    def call(self, fn: Callable, *args, sleep: Callable[[float], None] = time.sleep):
        for attempt in range(self.attempts):
            try:
                return fn(*args)
            except Exception as error:
                if attempt + 1 == self.attempts:
                    raise ServiceError("gave up", attempts=self.attempts, cause=str(error)) from error
                wait = min(self.longest_wait, self.first_wait * 2**attempt)
                sleep(random.uniform(self.first_wait, max(self.first_wait, wait)))


@dataclass(frozen=True)
class Model:
    """A named embedding: native (a Column builder) or remote (texts to vectors)."""

    name: str
    dim: int
    version: str = "1"
    native: Callable[[Column, int], Column] | None = None
    remote: Callable[[list[str]], list[list[float]]] | None = None
    retry: Retry = Retry()

    def info(self) -> dict[str, str]:
        return {
            "model_name": self.name,
            "model_version": self.version,
            "dimension": str(self.dim),
            "kind": "native" if self.native else "remote",
        }


#: What is said of a text that has nothing to embed.
BLANK = "blank text"


def native_model(name: str, dim: int = 384) -> Model:
    if name not in NATIVE:
        raise EmbeddingError("unknown native model", name=name)
    return Model(name=name, dim=dim, native=NATIVE[name])


def embed(df: DataFrame, model: Model, text: str = "content", out: str = "embedding") -> DataFrame:
    """Add the vector of *text* as ``array<float>`` and ``embedding_error`` (null when it worked)."""
    if model.native:
        vector = model.native(F.col(text), model.dim).cast("array<float>")
        blank = F.coalesce(F.length(strip(F.col(text))), F.lit(0)) == 0
        return df.withColumns(
            {
                out: F.when(~blank, vector),
                "embedding_error": F.when(blank, F.lit(BLANK)),
            }
        )
    return _embed_remote(df, model, text, out)


def _embed_remote(df: DataFrame, model: Model, text: str, out: str) -> DataFrame:
    added = StructType.fromDDL(f"{out} array<float>, embedding_error string")
    schema = StructType([*df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, batch in ((whole, part) for whole in batches for part in slices(whole)):
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            vectors: list[list[float] | None] = [None] * len(texts)
            errors: list[str | None] = [
                None if value and value.strip() else BLANK for value in texts
            ]
            asked = [i for i, error in enumerate(errors) if error is None]
            # the size of the job decides, not that of the part
            count = len(asked) if batch.num_rows == whole.num_rows else whole.num_rows
            size = next((s for limit, s in BATCH_STEPS if count <= limit), LARGEST_BATCH)
            for start in range(0, len(asked), size):
                part = asked[start : start + size]
                # a failing request costs its own rows only
                try:
                    made = model.retry.call(model.remote, [texts[i] for i in part])
                except ServiceError as error:
                    for i in part:
                        errors[i] = str(error)
                    continue
                for i, vector in zip(part, made, strict=True):
                    if len(vector) == model.dim:
                        vectors[i] = vector
                    else:
                        errors[i] = f"dimension {len(vector)} instead of {model.dim}"
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns,
                    pa.array(vectors, pa.list_(pa.float32())),
                    pa.array(errors, pa.string()),
                ],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def embed_cached(
    chunks: DataFrame,
    cache: DataFrame,
    model: Model,
    *,
    source: str = "source",
    chunk_index: str = "chunk_index",
    content: str = "content",
) -> tuple[DataFrame, DataFrame]:
    """``(chunks with vectors, new cache rows)``; only keys missing from *cache* are embedded.

    *cache* is ``(cache_key, embedding)`` with unique keys.
    """
    keyed = chunks.withColumn(
        "cache_key", cache_key(F.col(source), F.col(chunk_index), F.col(content))
    )
    held = cache.select("cache_key", F.col("embedding").alias("__held"))
    known = F.col("__held").isNotNull()
    # one join; a text that has its vector is not asked for
    asked = keyed.join(held, "cache_key", "left").withColumn("__asked", F.when(~known, F.col(content)))
    made = embed(asked, model, "__asked")
    added = (
        made.where(~known & F.col("embedding").isNotNull())
        .groupBy("cache_key")
        .agg(F.any_value("embedding").alias("embedding"))
    )
    whole = made.withColumns(
        {
            "embedding": F.coalesce("__held", "embedding"),
            "embedding_error": F.when(~known, F.col("embedding_error")),
        }
    )
    return whole.select(*keyed.columns, "embedding", "embedding_error"), added


def with_overrides(df: DataFrame, overrides: DataFrame, text: str, dim: int) -> DataFrame:
    """Replace vectors by those predefined per text: ``overrides(text, embedding)`` of size *dim*."""
    checked = overrides.select(
        F.col("text").alias(text),
        F.when(F.size("embedding") == dim, F.col("embedding"))
        .otherwise(F.raise_error(F.lit(f"predefined embedding is not of dimension {dim}")))
        .cast("array<float>")
        .alias("__given"),
    )
    return (
        df.join(checked, text, "left")
        .withColumn("embedding", F.coalesce("__given", "embedding"))
        .drop("__given")
    )


def request_concurrency(cores: int, limit: int | None = None) -> int:
    """Parallel remote requests worth making from a machine with *cores* cores."""
    best = min(32, cores + 4)
    return best if limit is None else max(1, min(best, limit))
