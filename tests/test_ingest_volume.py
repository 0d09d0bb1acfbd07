"""Indexing writes each text as often as it must, and keeps vectors of equal chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from docquarry import Engine, EngineConfig
from docquarry.config import ChunkSettings
from docquarry.session import Scratch
from docquarry.sources import tables


def test_texts_are_not_written_to_look_for_vectors(spark, tmp_path, monkeypatch):
    cuts = []
    plain = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df: cuts.append(df.columns) or plain(self, df))
    engine = Engine(spark, EngineConfig(str(tmp_path), embedding_dim=4, buckets=2, chunks=ChunkSettings(size=2, overlap=0)))

    def rows(*texts):
        frame = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "source_id string, text string")
        return tables.text_sources(frame, F.col("source_id"), F.col("text"), F.lit("text/plain"))

    first = engine.index(rows("a b c d", "e f")).counts
    assert (first["embeddings_reused"], first["vectors_stored"]) == (0, 3)
    second = engine.index(rows("a b x y", "e f")).counts
    assert (second["embeddings_reused"], second["vectors_stored"]) == (1, 2)
    assert engine.store.vectors.read().count() == 3
    # the chunks themselves once per run
    assert sum("content" in columns for columns in cuts) == 2
