"""Suffix-array dedup: remove bytes of 50-byte strings that start in an earlier document too.

1. *Texts* are written once with a row number. Equal texts are one text with the smallest id; the
   later copies are removed as a whole.
2. *Anchors.* The smallest hash among the 20-byte strings of a window is its anchor; equal windows
   have equal anchors, and neighbouring windows mostly share one. A run of windows with one anchor
   is a record of 22 bytes. Records are dealt by anchor into shards; an anchor seen in a single text
   can repeat nothing and goes.
3. *Shards.* The bytes of the remaining runs go to the shard of their anchor, equal segments once per
   task, so all equal windows meet in one shard. A shard is one byte string: its suffix array is
   built by induced sorting, and permuted common prefixes of 50 bytes or more give the groups of
   equal windows. A window is removed unless its document has the smallest id of its group.
4. Runs go back to their texts.

The number of shards follows the bytes of the table, so a shard's arrays stay small. An anchor of
very many documents is settled within each task first, which sends one record and one segment of it.
Nothing is broadcast. Texts meet their runs in a bucketed table, so they are not shuffled for it.

Null texts are empty. Null ids count as larger than all others. Rows with equal ids are one
document for comparison: neither is smaller. Texts below ``width`` bytes lose nothing. Extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written, mix64, utf8_rows
from docquarry.llm.suffix_sort import permuted_prefixes, suffix_array
from docquarry.session import scratch_path

WIDTH = 50
GRAM = 20
SHARD_BYTES = 6 << 20
PIECE = 1 << 20
FLUSH_RUNS = 2_000_000
FLUSH_SEGMENT_BYTES = 48 << 20
MAX_SHARDS = 1 << 20
MAX_FILES = 20_000
NO_ID = (1 << 63) - 1
SOMEWHERE = np.int64(-1)
_BASE = 0x100000001B3


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` = 16 + 4 bytes from every place, by doubling the length."""

    def joined(x: np.ndarray, y: np.ndarray, gap: int) -> np.ndarray:
        power = np.uint64(pow(_BASE, gap, 1 << 64))
        n = len(y) - gap
        return x[:n] * power + y[gap:]

    one = text.astype(np.uint64) + np.uint64(1)
    two = joined(one, one, 1)
    four = joined(two, two, 2)
    eight = joined(four, four, 4)
    sixteen = joined(eight, eight, 8)
    n = len(four) - 16
    return mix64(sixteen[:n] * np.uint64(pow(_BASE, 4, 1 << 64)) + four[16:])


def sliding_minimum(x: np.ndarray, size: int) -> np.ndarray:
    """Minimum of every *size* consecutive values, by doubling."""
    have = 1
    while have * 2 <= size:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = size - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def window_runs(texts: list[np.ndarray], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, text, first window and number of windows of every run in *texts*."""
    sizes = np.array([len(t) for t in texts])
    if not len(texts) or sizes.sum() < width:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    buffer = np.concatenate(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    anchors = sliding_minimum(gram_hashes(buffer), width - GRAM + 1)
    n = len(buffer) - width + 1
    anchors, first_owner = anchors[:n], owner[:n]
    inside = first_owner == owner[width - 1 :]
    new = np.ones(n, bool)
    new[1:] = (anchors[1:] != anchors[:-1]) | (first_owner[1:] != first_owner[:-1])
    new |= ~inside
    at = np.flatnonzero(new)
    lengths = np.diff(np.append(at, n))
    keep = inside[at]
    # no run is longer than a byte can hold
    at, lengths = at[keep], lengths[keep]
    base = np.cumsum(sizes) - sizes
    if (lengths > 255).any():
        parts = -(-lengths // 255)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at, whole = np.repeat(at, parts) + step * 255, np.repeat(lengths, parts)
        lengths = np.minimum(255, whole - step * 255)
    return anchors[at], first_owner[at], at - base[first_owner[at]], lengths


def _pack(start: np.ndarray, shard: np.ndarray, length: np.ndarray) -> np.ndarray:
    return start.astype(np.int64) << 28 | shard.astype(np.int64) << 8 | length.astype(np.int64)


def _grouped(keys: np.ndarray, values: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Distinct *keys* and, for each, the list of its *values*."""
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    offsets = np.append(first, len(keys)).astype(np.int32)
    return pa.array(keys[first]), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _in_two(anchors: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For records sorted by anchor: whether the anchor is in two texts, and whether it is new."""
    new = np.ones(len(anchors), bool)
    new[1:] = anchors[1:] != anchors[:-1]
    first = np.flatnonzero(new)
    low = np.minimum.reduceat(rows, first)
    high = np.maximum.reduceat(rows, first)
    group = np.cumsum(new) - 1
    return ((low != high) | (low == SOMEWHERE))[group], new


_RECORD = np.dtype([("anchor", "<u8"), ("row", "<i8"), ("start", "<u4"), ("high", "u1"), ("length", "u1")])
_FOUND = "shard int, blob binary, k long, runs array<bigint>"


def _find_runs(width: int, shards: int):
    """Task side of step 2: records per shard, and runs whose anchor repeats within the task."""

    def flush(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        anchors, rows, starts, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(anchors, kind="stable")
        anchors, rows, starts, lengths = anchors[order], rows[order], starts[order], lengths[order]
        shard = (anchors % np.uint64(shards)).astype(np.int64)
        twice, new = _in_two(anchors, rows)
        keys, runs = _grouped(rows[twice], _pack(starts[twice], shard[twice], lengths[twice]))
        if len(keys):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(keys.to_numpy() % shards + shards, pa.int32()), pa.nulls(len(keys), pa.binary()),
                    keys, runs,
                ],
                names=["shard", "blob", "k", "runs"],
            )
        send = ~twice | new
        record = np.zeros(int(send.sum()), _RECORD)
        record["anchor"], record["length"] = anchors[send], lengths[send]
        record["row"] = np.where(twice[send], SOMEWHERE, rows[send])
        record["start"], record["high"] = starts[send] & 0xFFFFFFFF, starts[send] >> 32
        shard = shard[send]
        order = np.argsort(shard, kind="stable")
        record, shard = record[order], shard[order]
        edges = np.searchsorted(shard, np.arange(shards + 1))
        full = np.flatnonzero(np.diff(edges))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(full, pa.int32()),
                pa.array([record[edges[i] : edges[i + 1]].tobytes() for i in full], pa.binary()),
                pa.nulls(len(full), pa.int64()),
                pa.nulls(len(full), pa.list_(pa.int64())),
            ],
            names=["shard", "blob", "k", "runs"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        pieces: list[np.ndarray] = []
        names: list[tuple[int, int]] = []
        size = 0

        def take() -> None:
            nonlocal held, size
            anchors, owner, start, length = window_runs(pieces, width)
            if len(anchors):
                key = np.array([k for k, _ in names], np.int64)
                base = np.array([b for _, b in names], np.int64)
                parts.append((anchors, key[owner], start + base[owner], length.astype(np.uint8)))
                held += len(anchors)
            pieces.clear()
            names.clear()
            size = 0

        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), utf8_rows(batch.column(1)), strict=True):
                whole = np.frombuffer(text, np.uint8)
                for base in range(0, max(1, len(whole) - width + 1), PIECE):
                    piece = whole[base : base + PIECE + width - 1]
                    pieces.append(piece)
                    names.append((k, base))
                    size += len(piece)
                    if size >= PIECE:
                        take()
                        if held >= FLUSH_RUNS:
                            yield from flush(parts)
                            parts, held = [], 0
        take()
        if parts:
            yield from flush(parts)

    return run


def _flat(group: pa.Table, lists: str, name: str) -> pa.Table:
    """The rows of *group* with a list, one row for each of its values."""
    held = group.filter(group.column(lists).is_valid()).combine_chunks()
    if not held.num_rows:
        return pa.table({"k": pa.array([], pa.int64()), name: pa.array([], pa.int64())})
    values = held.column(lists).chunk(0)
    return pa.table({"k": held.column("k").take(values.value_parent_indices()), name: values.flatten()})


def _repeated_runs(group: pa.Table) -> pa.Table:
    """Shard side of step 2: runs whose anchor is in two texts."""
    blobs = group.column("blob").drop_null()
    records = np.concatenate([np.zeros(0, _RECORD), *[np.frombuffer(b.as_buffer(), _RECORD) for b in blobs]])
    passed = _flat(group, "runs", "run")
    if not len(records):
        return passed
    records = records[np.argsort(records["anchor"], kind="stable")]
    rows = records["row"].astype(np.int64)
    twice, _ = _in_two(records["anchor"], rows)
    keep = twice & (rows != SOMEWHERE)
    start = records["start"][keep].astype(np.int64) | records["high"][keep].astype(np.int64) << 32
    shard = np.full(len(start), group.column("shard")[0].as_py(), np.int64)
    run = _pack(start, shard, records["length"][keep])
    return pa.concat_tables([passed, pa.table({"k": rows[keep], "run": run})])


_SEGMENT = np.dtype([("id", "<i8"), ("row", "<i8"), ("start", "<i8"), ("length", "u1")])
_SPANS = "shard int, blob binary, k long, spans array<bigint>"


def _settle(segments: list[tuple[bytes, int, int, int]]) -> tuple[list[tuple[bytes, int, int, int]], list[tuple[int, int, int]]]:
    """Equal segments once: those of the smallest id stay, the others are repeats as a whole."""
    least: dict[bytes, int] = {}
    for text, ident, _, _ in segments:
        if ident < least.get(text, NO_ID + 1):
            least[text] = ident
    stay = [s for s in segments if s[1] == least[s[0]]]
    return stay, [(s[2], s[3], len(s[0])) for s in segments if s[1] != least[s[0]]]


def _spans(found: list[tuple[int, int, int]]) -> tuple[pa.Array, pa.Array]:
    """``(k, spans)`` from row, first byte and bytes removed."""
    rows = np.array(found, np.int64).reshape(-1, 3)
    return _grouped(rows[:, 0], rows[:, 1] << 16 | rows[:, 2])


def _send_segments(width: int, shards: int):
    """Task side of step 3: the bytes of runs, per shard, equal ones of a task settled."""

    def flush(by_shard: dict[int, list[tuple[bytes, int, int, int]]]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        gone: list[tuple[int, int, int]] = []
        numbers, blobs = [], []
        for shard, segments in by_shard.items():
            stay, out = _settle(segments)
            gone += out
            head = np.array([(i, k, s, len(t) - width + 1) for t, i, k, s in stay], _SEGMENT)
            numbers.append(shard)
            blobs.append(pack.compress(len(head).to_bytes(4, "little") + head.tobytes() + b"".join([s[0] for s in stay])))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(numbers, pa.int32()), pa.array(blobs, pa.binary()),
                pa.nulls(len(blobs), pa.int64()), pa.nulls(len(blobs), pa.list_(pa.int64())),
            ],
            names=["shard", "blob", "k", "spans"],
        )
        keys, spans = _spans(gone)
        if len(keys):
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.to_numpy() % shards + shards, pa.int32()), pa.nulls(len(keys), pa.binary()), keys, spans],
                names=["shard", "blob", "k", "spans"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_shard: dict[int, list[tuple[bytes, int, int, int]]] = {}
        held = 0
        for batch in batches:
            for k, ident, text, runs in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8_rows(batch.column(2)),
                batch.column(3).to_pylist(), strict=True,
            ):
                for packed in runs:
                    start, shard, length = packed >> 28, packed >> 8 & 0xFFFFF, packed & 0xFF
                    segment = text[start : start + length + width - 1]
                    by_shard.setdefault(shard, []).append((segment, ident, k, start))
                    held += len(segment) + 150
                if held > FLUSH_SEGMENT_BYTES:
                    yield from flush(by_shard)
                    by_shard, held = {}, 0
        if by_shard:
            yield from flush(by_shard)

    return run


def earlier_windows(segments: list[bytes], ids: np.ndarray, width: int) -> list[np.ndarray]:
    """Per segment, which of its windows are equal to one of a segment with a smaller id."""
    text = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    order = suffix_array(text, width)
    prefixes = permuted_prefixes(text, order)
    owner = np.repeat(np.arange(len(segments)), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(text))
    group = np.cumsum(prefixes[order] < width)  # neighbours that share a window
    valid = left[order] >= width
    at, group = order[valid], group[valid]
    ident = ids[owner[at]]
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    least = np.repeat(np.minimum.reduceat(ident, first), np.diff(np.append(first, len(group))))
    repeated = np.zeros(len(text), bool)
    repeated[at] = ident > least
    ends = np.cumsum(sizes)
    return [repeated[e - n : e - width + 1] for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]


def _shard_spans(width: int):
    """Shard side of step 3."""

    def found(group: pa.Table) -> pa.Table:
        passed = _flat(group, "spans", "span")
        segments: list[tuple[bytes, int, int, int]] = []
        unpack = zstandard.ZstdDecompressor()
        for blob in group.column("blob").drop_null():
            data = unpack.decompress(blob.as_py())
            n = int.from_bytes(data[:4], "little")
            head = np.frombuffer(data, _SEGMENT, n, 4)
            at = 4 + n * _SEGMENT.itemsize
            for ident, row, start, length in head.tolist():
                segments.append((data[at : at + length + width - 1], ident, row, start))
                at += length + width - 1
        if not segments:
            return passed
        stay, gone = _settle(segments)
        del segments
        distinct = {s[0]: s[1] for s in stay}
        masks = dict(
            zip(distinct, earlier_windows(list(distinct), np.array(list(distinct.values()), np.int64), width), strict=True)
        )
        for text, _, row, start in stay:
            edge = np.flatnonzero(np.diff(np.concatenate(([0], masks[text].view(np.int8), [0]))))
            gone += [(row, start + a, b - a + width - 1) for a, b in edge.reshape(-1, 2).tolist()]
        rows = np.array(gone, np.int64).reshape(-1, 3)
        return pa.concat_tables([passed, pa.table({"k": rows[:, 0], "span": rows[:, 1] << 16 | rows[:, 2]})])

    return found


RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(width: int, keep_bytes: bool):
    """Step 4: what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, copy, parts in zip(
                utf8_rows(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True
            ):
                if copy and len(text) >= width:
                    kept, removed, spans = b"", len(text), 1
                elif not copy and parts:
                    packed = np.array(parts, np.int64)
                    start, size = packed >> 16, packed & 0xFFFF
                    depth = np.zeros(len(text) + 1, np.int32)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + size, -1)
                    gone = np.cumsum(depth[:-1]) > 0
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                else:
                    kept, removed, spans = text, 0, 0
                made.append((len(text), removed, spans, hashlib.sha256(kept).hexdigest(), kept if keep_bytes else None))
            columns = list(zip(*made, strict=True)) if made else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]],
                names=["doc_id", *RESULT.replace(",", "").split()[::2]],
            )

    return run


def suffix_dedup(
    docs: DataFrame, width: int = WIDTH, *, key: str = "doc_id", text: str = "text", keep_bytes: bool = True
) -> DataFrame:
    """Per row ``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)``.

    *kept* holds the remaining bytes with *keep_bytes*, else null.
    """
    if not GRAM < width < 60_000:
        raise ValueError(f"width must be over {GRAM} and below 60000")
    spark = docs.sparkSession
    path = scratch_path(spark, "texts")
    name = "texts_" + path.rsplit("-", 1)[1]
    scans = docs.rdd.getNumPartitions()
    buckets = max(scans, spark.sparkContext.defaultParallelism)
    plain = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select(
        F.monotonically_increasing_id().alias("k"), "doc_id", "text",
        F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("ident"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    if scans * buckets > MAX_FILES:
        plain = plain.repartition(buckets, "k")
    plain.write.bucketBy(buckets, "k").option("path", path).option("compression", "zstd").saveAsTable(name)
    texts = spark.table(name)
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = min(MAX_SHARDS - 1, max(16, -(-int(total) // SHARD_BYTES)))

    # one row per distinct text
    firsts = texts.groupBy("digest").agg(F.min(F.struct("ident", "k")).alias("first"))
    state = texts.select("k", "digest", "ident").join(firsts, "digest").select(
        "k", F.col("first.k").alias("first_k"), (F.col("ident") > F.col("first.ident")).alias("copy")
    )
    rows = Written(state, "textrows")
    own = rows.read().where("k = first_k").select("k")
    found = (
        texts.select("k", "text").join(own.hint("shuffle_hash"), "k", "left_semi")
        .mapInArrow(_find_runs(width, shards), _FOUND)
        .groupBy("shard")
        .applyInArrow(_repeated_runs, "k long, run long")
    )
    runs = Written(found, "runs")
    lists = runs.read().groupBy("k").agg(F.collect_list("run").alias("runs"))
    spans = Written(
        texts.select("k", "ident", "text").join(lists.hint("shuffle_hash"), "k")
        .select("k", "ident", "text", "runs")
        .mapInArrow(_send_segments(width, shards), _SPANS)
        .groupBy("shard")
        .applyInArrow(_shard_spans(width), "k long, span long"),
        "spans",
    )
    runs.delete()
    removed = spans.read().groupBy(F.col("k").alias("first_k")).agg(F.collect_list("span").alias("spans"))
    of_row = rows.read().join(removed, "first_k", "left").select("k", "copy", "spans")
    return (
        texts.select("k", "doc_id", "text").join(of_row.hint("shuffle_hash"), "k")
        .select("doc_id", "text", "copy", "spans")
        .mapInArrow(_cut(width, keep_bytes), f"doc_id {docs.schema[key].dataType.simpleString()}, {RESULT}")
    )

