"""Continuous indexing and embedding with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.operators import embed as E
from docquarry.operators.store import latest


def index_stream(sources: DataFrame, engine, checkpoint: str, trigger: dict | None = None):
    """Index every micro-batch; the upserts are keyed, so a replayed batch changes nothing.

    The last version of a source (by ``last_modified``) counts, within a batch and over all batches: the
    catalog holds the time of what was indexed, and an older version that comes late is left out.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        newest = latest(
            batch.withColumn("__v", F.coalesce("last_modified", F.lit(0.0))), "source_id", "__v"
        ).drop("__v")
        engine.index(newest)

    return (
        sources.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def embed_stream(chunks: DataFrame, model: E.Model, content: str = "content") -> DataFrame:
    """Vectors of a streaming chunk frame, each beside the key columns of its chunk."""
    return E.embed(chunks, model, content)
