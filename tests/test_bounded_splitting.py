"""Splitting and embedding in bounded memory and time per row."""

from __future__ import annotations

import random

import pyarrow as pa

from docquarry.operators import chunking, embed, expand, splitting


def test_batches_are_worked_in_parts():
    batch = pa.RecordBatch.from_pydict({"t": ["x" * 1000] * 5000})
    parts = list(expand.slices(batch))
    assert len(parts) > 3 and max(p.nbytes for p in parts) < 2 * expand.PART_BYTES
    assert sum(p.num_rows for p in parts) == 5000
    assert list(expand.slices(batch.slice(0, 0))) == []


def test_expanded_rows_over_many_parts(spark):
    texts = ["ab " * (i % 700) for i in range(3000)]
    frame = spark.createDataFrame([(i, t if i % 5 else None) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    fields = "n int, words array<string>"
    found = expand.expand_rows(frame, ["text"], fields, lambda t: [(k, [t[:k]] if k else None) for k in range(len(t or "") % 4)])
    got = sorted((r.i, r.text, r.n, r.words) for r in found.collect())
    assert got == sorted((i, t, k, [t[:k]] if k else None) for i, t in enumerate(texts) if i % 5 for k in range(len(t) % 4))


def test_requests_keep_the_size_of_the_job(spark):
    frame = spark.range(1500).selectExpr("id", "repeat('x', 3000) AS text").coalesce(1)
    model = embed.Model("m", 1, remote=lambda texts: [[float(len(texts))] for _ in texts])
    sizes = [r.embedding[0] for r in embed.embed(frame, model, "text").collect()]
    assert len(sizes) == 1500 and max(sizes) == embed.LARGEST_BATCH


def test_first_windows_against_search(spark):
    draw = random.Random(7)
    texts = ["", "a", "é" * 100, "ab" * 200, "😀x" * 41, "x" * 40, "x" * 41, "abc" * 13]
    texts += ["".join(draw.choice("ab é😀") for _ in range(draw.randint(1, 400))) for _ in range(60)]
    for text in texts:
        for size, stride in ((40, 40), (3, 3), (5, 2), (1, 1)):
            expected = [text.find(text[s : s + size]) for s in range(0, len(text), stride)]
            assert splitting.first_window_positions(text, size, stride) == expected
    frame = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id int, text string")
    keys = ["doc_id", "chunk_index", "chunk_total", "chunk_start_char", "chunk_end_char"]
    plain = chunking.first_positions(chunking.char_windows(frame, size=6, overlap=2)).select(*keys)
    assert sorted(chunking.window_positions(frame, size=6, overlap=2).select(*keys).collect()) == sorted(plain.collect())
