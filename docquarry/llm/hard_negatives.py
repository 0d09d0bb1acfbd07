"""Hard negatives of anchor vectors, with segment summaries that bound a score before it is computed.

Components become whole numbers, ``floor(SCALE * x)``; a score is the inner product of two rows. A vector is
cut into segments, and of every segment the mean and the deviation (the length of what is left after the
mean is taken off) are stored. For two segments of n components with means a, b and deviations d, e the
inner product lies in ``n * a * b -+ d * e``; sums over segments bound the score. Summaries of
longer segments follow from those of shorter ones, so a pair is looked at with one segment first, then with
2, 4, ... up to ``SEGMENTS``, as long as its bounds allow a place in the answer, and scored exactly after that.

*Positives* of an anchor: its best ``POSITIVES`` other rows of the same label. *Negatives* of an anchor and
a positive of score s: the best ``NEGATIVES`` rows of another label with ``low * s <= 100 * score <= high * s``.
Both are searches of the anchors in all rows: a block of anchors, bounded in rows and bytes, goes to all tasks;
a task keeps the best rows per anchor and its worst kept score tightens the bounds of the rows that follow. What
is shuffled are tasks x anchors x kept rows. More anchors than a block are searched block by block.

Order is by score, higher first, ties by smaller id (rows without an id last, equal ids in any order). Rows
with a null label or vector, or with null or non-finite components, take no part, nor do those with a
component of ``LARGEST`` or more after scaling, whose products may not fit a long. Rows of different lengths
are not compared. Repeated ids are rows of their own: as anchors they give their answers once each, as
others they count each. An anchor without positives, or a positive without negatives, gives no row. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Written

SCALE = 256
LARGEST = 1 << 20
SEGMENTS = 8
POSITIVES = 5
NEGATIVES = 10
LOW, HIGH = 30, 90
#: Bounds of a block of anchors, and rows looked at in a step.
BLOCK_ROWS = 1024
BLOCK_BYTES = 16 << 20
STEP_ROWS = 2048
_LAST_ID = np.iinfo(np.int64).max


def scaled(vector: str, scale: int = SCALE) -> Column:
    """The whole numbers of a vector; null if it is null or cannot take part."""
    def usable(x: Column) -> Column:
        y = F.abs(x.cast("double"))
        return x.isNotNull() & ~F.isnan(x) & (y < F.lit(float(LARGEST - 1) / scale))

    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("long"))
    return F.when(F.coalesce(F.forall(vector, usable), F.lit(False)), whole)


def _summaries(x: np.ndarray, segments: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level, from one segment to *segments*: weighted means and deviations.

    Means are multiplied by the root of the segment's size, so that a product of two rows of them is
    the sum of the products of means.
    """
    n, d = x.shape
    cuts = np.linspace(0, d, segments + 1).astype(np.int64)
    size = np.diff(cuts).astype(float)
    total = np.add.reduceat(np.hstack((x, np.zeros((n, 1)))), np.minimum(cuts[:-1], d), axis=1) * (size > 0)
    square = np.add.reduceat(np.hstack((x * x, np.zeros((n, 1)))), np.minimum(cuts[:-1], d), axis=1) * (size > 0)
    levels = []
    while True:
        mean = total / np.sqrt(np.maximum(size, 1))
        # what rounding may have taken from a difference of squares is given back
        levels.append((mean, np.sqrt(np.maximum(square - mean * mean, 0) + 1e-12 * square)))
        if len(size) == 1:
            return levels[::-1]
        total, square = total[:, 0::2] + total[:, 1::2], square[:, 0::2] + square[:, 1::2]
        size = size[0::2] + size[1::2]


class _Rows:
    """Equally long vectors with labels, ids and summaries."""

    def __init__(self, label: np.ndarray, ids: np.ndarray, row: np.ndarray, x: np.ndarray, segments: int) -> None:
        self.label, self.ids, self.row = label, ids, row
        self.exact = x
        self.x = x.astype(float)
        self.largest = int(np.abs(x).max(initial=0))
        self.levels = _summaries(self.x, segments)

    def scores(self, other: _Rows) -> np.ndarray:
        """All inner products, exact: in floating point only where every partial sum is a whole number below 2^53."""
        if self.largest * other.largest * max(1, self.x.shape[1]) < 1 << 53:
            return (self.x @ other.x.T).astype(np.int64)
        return self.exact @ other.exact.T


def _by_length(batch: pa.RecordBatch, segments: int) -> Iterator[_Rows]:
    """The rows of a batch ``(row, id, label, x)``, those of one length together."""
    vectors = batch.column(3)
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for length in np.unique(size):
        part = batch.filter(pa.array(size == length))
        ids = part.column(1).fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
        x = part.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(part.num_rows, int(length))
        yield _Rows(part.column(2).to_numpy(zero_copy_only=False), ids, part.column(0).to_numpy(zero_copy_only=False), x, segments)


class _Kept:
    """The best *k* rows per key, of scores within the key's bounds."""

    def __init__(self, keys: int, k: int) -> None:
        self.k = k
        self.need = np.full(keys, np.iinfo(np.int64).min)
        self.rows = [np.zeros((0, 4), np.int64)]
        self.held = 0

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray) -> None:
        self.rows.append(np.stack((key, score, ids, row), axis=1))
        self.held += len(key)
        if self.held > 4 * self.k * len(self.need) or len(self.rows) > 64:
            self.cut()

    def cut(self) -> np.ndarray:
        """Forget what cannot be among the best; the worst of k kept scores is needed from now on."""
        all_rows = np.concatenate(self.rows)
        all_rows = all_rows[np.lexsort((all_rows[:, 3], all_rows[:, 2], -all_rows[:, 1], all_rows[:, 0]))]
        start = np.searchsorted(all_rows[:, 0], all_rows[:, 0])
        place = np.arange(len(all_rows)) - start
        last = all_rows[place == self.k - 1]
        self.need[last[:, 0]] = np.maximum(self.need[last[:, 0]], last[:, 1])
        kept = all_rows[place < self.k]
        self.rows, self.held = [kept], len(kept)
        return kept


def _survivors(anchors: _Rows, rows: _Rows, fits: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The pairs of *fits* whose bounds meet the anchors' [low, high], refined level by level."""
    for (mean_a, dev_a), (mean_r, dev_r) in zip(anchors.levels, rows.levels, strict=True):
        if not fits.any():
            break
        middle, spread = mean_a @ mean_r.T, dev_a @ dev_r.T
        spread += 1e-6 * (np.abs(middle) + spread) + 1e-3
        fits = fits & (middle + spread >= low[:, None]) & (middle - spread <= high[:, None])
    return fits


def _search(
    blocks: list[_Rows], wanted: list[np.ndarray] | None, k: int, segments: int, batches: Iterator[pa.RecordBatch]
) -> Iterator[np.ndarray]:
    """The best rows of *batches* per anchor (same label) or per anchor and positive (*wanted* bounds).

    *wanted* holds, per anchor, ``(key, low, high)`` of each positive; without it the key is the anchor.
    """
    lowest, highest = np.iinfo(np.int64).min, np.iinfo(np.int64).max
    keys_of = [len(a.ids) if wanted is None else int(w[..., 0].max(initial=0)) + 1 for a, w in zip(blocks, wanted or blocks, strict=True)]
    state = [_Kept(n, k) for n in keys_of]
    for whole in batches:
        for start in range(0, whole.num_rows, STEP_ROWS):
            for rows in _by_length(whole.slice(start, STEP_ROWS), segments):
                for at, anchors in enumerate(blocks):
                    if anchors.x.shape[1] != rows.x.shape[1]:
                        continue
                    kept, own = state[at], np.arange(len(anchors.ids))
                    other = anchors.row[:, None] != rows.row[None, :]
                    same = anchors.label[:, None] == rows.label[None, :]
                    if wanted is None:
                        low, high = kept.need, np.full(len(own), highest)
                        fits = _survivors(anchors, rows, same & other, low, high)
                    else:
                        keys = wanted[at]
                        real = keys[..., 0] >= 0
                        need = np.where(real, np.maximum(keys[..., 1], kept.need[keys[..., 0]]), highest)
                        low = need.min(axis=1, initial=highest)
                        high = np.where(real, keys[..., 2], lowest).max(axis=1, initial=lowest)
                        fits = _survivors(anchors, rows, ~same, low, high)
                    a, r = np.flatnonzero(fits.any(axis=1)), np.flatnonzero(fits.any(axis=0))
                    if not len(a):
                        continue
                    score = _part(anchors, a).scores(_part(rows, r))
                    inside = fits[np.ix_(a, r)]
                    if wanted is None:
                        i, j = np.nonzero(inside & (score >= kept.need[a][:, None]))
                        kept.add(a[i], score[i, j], rows.ids[r[j]], rows.row[r[j]])
                        continue
                    for p in range(keys.shape[1]):
                        least = need[a, p][:, None]
                        i, j = np.nonzero(inside & real[a, p][:, None] & (score >= least) & (score <= keys[a, p, 2][:, None]))
                        kept.add(keys[a[i], p, 0], score[i, j], rows.ids[r[j]], rows.row[r[j]])
    for at, kept in enumerate(state):
        best = kept.cut()
        if len(best):
            yield np.column_stack((np.full(len(best), at), best))


def _part(rows: _Rows, at: np.ndarray) -> _Rows:
    """Some of the *rows*, for exact scores only."""
    part = object.__new__(_Rows)
    part.exact, part.x, part.largest = rows.exact[at], rows.x[at], rows.largest
    return part


def _blocks(anchors: DataFrame, rows: int, size: int) -> Iterator[pa.Table]:
    """Anchors dealt by hash of the row number into parts of half a block, each fetched and cut to the bounds."""
    n, largest = anchors.agg(F.count("*"), F.max(F.size("x"))).first()
    fit = max(1, min(rows, size // (8 * max(1, largest or 1))))
    parts = -(-2 * n // fit)
    for part in range(parts):
        whole = anchors.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).toArrow()
        for start in range(0, whole.num_rows, fit):
            yield whole.slice(start, fit)


def _batches(table: pa.Table) -> Iterator[pa.RecordBatch]:
    yield from table.select(["row", "id", "label", "x"]).combine_chunks().to_batches()


def _emit(found: Iterator[np.ndarray], columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """Found ``(block, key, score, id, row)`` with the columns of the key in front."""
    for rows in found:
        front = [c[0][rows[:, 1]] if c.ndim == 2 else c[rows[:, 0], rows[:, 1]] for c in columns]
        none = rows[:, 3] == _LAST_ID
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, front), pa.array(rows[:, 2]), pa.array(rows[:, 3], mask=none), pa.array(rows[:, 4])],
            names=[str(i) for i in range(len(front) + 3)],
        )


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    id_column: str = "vec_id",
    label: str | Column = "label",
    vector: str = "embedding",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    scale: int = SCALE,
    segments: int = SEGMENTS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of all rows where *anchor*.

    *low* and *high* are percent of the positive's score; *segments* is a power of two.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    made = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"),
        label.cast("long").alias("label"), scaled(vector, scale).alias("x"),
        F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
    )
    rows = Written(made.where("label is not null and x is not null"), "vectors")
    table = rows.read()
    corpus = table.select("row", "id", "label", "x")
    tasks = spark.sparkContext.defaultParallelism
    if corpus.rdd.getNumPartitions() < tasks:
        corpus = corpus.repartition(tasks)
    answers: Written | None = None

    def one_block(block: pa.Table) -> DataFrame:
        anchors = [a for batch in _batches(block) for a in _by_length(batch, segments)]

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _search(anchors, None, positives, segments, batches):
                part = anchors[int(found[0, 0])]
                columns = [part.row[None, :], part.ids[None, :]]
                yield from _emit(iter([found]), columns)

        named = "anchor long, anchor_id long, score long, id long, row long"
        order = Window.partitionBy("anchor").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        best = (
            corpus.mapInArrow(near, named).withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives)
        )
        chosen = best.select("anchor", "anchor_id", "place", "id", "score").toArrow()
        wanted, pairs = _wanted(anchors, chosen, positives, low, high)

        def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for found in _search(anchors, wanted, negatives, segments, batches):
                columns = [c[None, :] for c in pairs[int(found[0, 0])]]
                yield from _emit(iter([found]), columns)

        named = "anchor long, place long, anchor_id long, positive_id long, positive_score long, score long, id long, row long"
        order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
        ranked = corpus.mapInArrow(far, named).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
        none = F.lit(_LAST_ID)
        return ranked.select(
            F.nullif("anchor_id", none).alias("anchor_id"), F.nullif("positive_id", none).alias("positive_id"), "rank",
            F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        )

    for block in _blocks(table.where("is_anchor"), block_rows, BLOCK_BYTES):
        found = one_block(block)
        if answers is None:
            answers = Written(found, "negatives")
        else:
            answers.append(found)
    if answers is None:
        schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        rows.delete()
        return spark.createDataFrame([], schema)
    rows.delete()
    return answers.read()


def _wanted(
    anchors: list[_Rows], chosen: pa.Table, positives: int, low: int, high: int
) -> tuple[list[np.ndarray], list[list[np.ndarray]]]:
    """Per block of anchors: ``(key, least, most)`` of every positive, and the columns of every key."""
    row = chosen.column("anchor").to_numpy()
    place, score = chosen.column("place").to_numpy(), chosen.column("score").to_numpy()
    ids = chosen.column("id").combine_chunks().fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
    wanted, pairs = [], []
    for part in anchors:
        order = np.argsort(part.row)
        at = order[np.minimum(np.searchsorted(part.row[order], row), len(order) - 1)]
        mine = np.flatnonzero(part.row[at] == row)
        keys = np.full((len(part.row), positives, 3), -1, np.int64)
        keys[at[mine], place[mine] - 1, 0] = np.arange(len(mine))
        keys[at[mine], place[mine] - 1, 1] = -((-low * score[mine]) // 100)
        keys[at[mine], place[mine] - 1, 2] = (high * score[mine]) // 100
        wanted.append(keys)
        pairs.append([row[mine], place[mine].astype(np.int64), part.ids[at[mine]], ids[mine], score[mine]])
    return wanted, pairs
