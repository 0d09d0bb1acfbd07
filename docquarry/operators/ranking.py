"""Top-k per group, and exact scoring of a corpus against many questions in one scan.

The scan never materialises question-document pairs. A task scores one Arrow batch against a block
of questions with a matrix product, keeps the best k per question, and emits only those; the
shuffle then carries at most tasks x questions x k rows.

Questions reach the tasks in blocks within a row and a byte bound, shipped with the task. With more
than one block the questions are written once below the shared folder, and the corpus is scanned once
per block; each scan appends its leaders to one table. The corpus is never shuffled, and the driver
holds one block at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from docquarry.session import Scratch, scratch_path

# Bounds on what one task receives as its block of questions.
MAX_BLOCK_ROWS = 4_096
MAX_BLOCK_BYTES = 64 * 1024 * 1024
# Scores closer than this are ties; hides the rounding noise of matrix kernels.
SCORE_DECIMALS = 9
# Above this k Spark no longer cuts a ranking window before its shuffle.
GROUP_LIMIT_MAX_K = 1_000

# (questions) -> function giving a [rows, questions] score matrix for a record batch
ScorerFactory = Callable[[pa.Table], Callable[[pa.RecordBatch], np.ndarray]]


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First *k* rows of every group, numbered from 1.

    Up to k = 1000 Spark cuts each group before the shuffle, so a hot group costs k rows per task.
    For a larger k the cut is made here on salted sub-groups first.
    """
    if k > GROUP_LIMIT_MAX_K:
        salt = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in group]), F.lit(64))
        local = Window.partitionBy(*group, "__salt").orderBy(*order)
        df = (
            df.withColumn("__salt", salt)
            .withColumn("__local", F.row_number().over(local))
            .where(F.col("__local") <= k)
            .drop("__salt", "__local")
        )
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def best_rows(scores: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k best scores per column, ties to the earlier row: ``[columns, k]``."""
    rows, columns = scores.shape
    if rows <= k:
        return np.argsort(-scores, axis=0, kind="stable").T
    kth = np.partition(scores, rows - k, axis=0)[rows - k]
    above = scores > kth
    level = scores == kth
    room = k - above.sum(axis=0)
    keep = above | (level & (np.cumsum(level, axis=0) <= room))
    chosen = np.nonzero(keep.T)[1].reshape(columns, k)
    picked = np.take_along_axis(scores, chosen.T, axis=0).T
    order = np.argsort(-picked, axis=1, kind="stable")
    return np.take_along_axis(chosen, order, axis=1)


class _Leaders:
    """Best k rows per question over the batches of one task."""

    def __init__(self, k: int, tie_descending: bool) -> None:
        self.k = k
        self.descending = tie_descending
        self.scores: np.ndarray | None = None
        self.ids: np.ndarray | None = None
        self.ties: np.ndarray | None = None

    def add(self, ids: pa.Array, ties: pa.Array, scores: np.ndarray) -> None:
        order = "descending" if self.descending else "ascending"
        by_tie = pc.sort_indices(ties, sort_keys=[("", order)]) if len(ties) else pa.array([], pa.int64())
        by_tie = by_tie.to_numpy()
        scores = np.round(scores[by_tie], SCORE_DECIMALS)
        scores = np.where(np.isfinite(scores), scores, -np.inf)
        chosen = best_rows(scores, self.k)
        new_scores = np.take_along_axis(scores, chosen.T, axis=0).T
        new_ids = _values(ids)[by_tie][chosen]
        new_ties = _values(ties)[by_tie][chosen]
        if self.scores is not None:
            new_scores = np.concatenate([self.scores, new_scores], axis=1)
            new_ids = np.concatenate([self.ids, new_ids], axis=1)
            new_ties = np.concatenate([self.ties, new_ties], axis=1)
            tie_rank = np.unique(new_ties, return_inverse=True)[1].reshape(new_ties.shape)
            order = np.lexsort((-tie_rank if self.descending else tie_rank, -new_scores), axis=1)
            order = order[:, : self.k]
            new_scores, new_ids, new_ties = (
                np.take_along_axis(a, order, axis=1) for a in (new_scores, new_ids, new_ties)
            )
        self.scores, self.ids, self.ties = new_scores, new_ids, new_ties

    def result(self, question_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
        if self.scores is None:
            return None
        width = self.scores.shape[1]
        scores = self.scores.ravel()
        kept = np.isfinite(scores)
        columns = [
            question_ids.take(pa.array(np.repeat(np.arange(len(question_ids)), width)[kept])),
            pa.array(self.ids.ravel()[kept], schema.field(1).type),
            pa.array(self.ties.ravel()[kept], schema.field(2).type),
            pa.array(scores[kept]),
        ]
        return pa.RecordBatch.from_arrays(columns, names=schema.names)


def _values(column: pa.Array) -> np.ndarray:
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        return np.array(column.to_pylist(), dtype=str)
    return column.to_numpy(zero_copy_only=False)


def list_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column of equal lengths as a float64 matrix, without a Python loop."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return values.reshape(rows, -1) if rows else np.zeros((0, 1))


def _question_blocks(kept: DataFrame, rows: int, size: int) -> Iterator[pa.Table]:
    """The written questions in blocks of at most *rows* rows and *size* bytes.

    Rows are dealt by hash into parts of half a block on average; a part that came out too large is
    cut after it was fetched, so no block exceeds the bounds (but for one question larger than *size*).
    """
    sample = kept.limit(rows).toArrow()
    fit = max(1, min(rows, size * max(1, sample.num_rows) // max(1, sample.nbytes)))
    parts = max(1, -(-2 * kept.count() // fit))
    dealt = kept.withColumn("__part", F.pmod(F.xxhash64(*kept.columns), F.lit(parts)))
    for part in range(parts):
        pending = [dealt.where(F.col("__part") == part).drop("__part").toArrow()]
        while pending:
            block = pending.pop()
            if block.num_rows > rows or (block.nbytes > size and block.num_rows > 1):
                half = block.num_rows // 2
                pending += [block.take(list(range(a, b))) for a, b in ((half, block.num_rows), (0, half))]
            elif block.num_rows:
                yield block


def scan_top_k(
    questions: DataFrame,
    corpus: DataFrame,
    factory: ScorerFactory,
    k: int,
    *,
    question_id: str,
    corpus_id: str,
    tie: str | None = None,
    tie_descending: bool = False,
    required: tuple[str, str] | None = None,
    block_rows: int = MAX_BLOCK_ROWS,
    block_bytes: int = MAX_BLOCK_BYTES,
) -> DataFrame:
    """Exact top-k of *corpus* for every question: ``(question_id, corpus_id, rank, score)``.

    Rows with a non-finite score are left out, and those whose *required* question or corpus column
    is null; testing that here keeps Spark from computing the column twice, once for a filter. Ties go to the smaller (or, with *tie_descending*,
    larger) value of *tie*, by default the corpus id.
    """
    tie = tie or corpus_id
    corpus = corpus.withColumn("__tie", F.col(tie))
    out = StructType(
        [
            questions.schema[question_id],
            corpus.schema[corpus_id],
            corpus.schema["__tie"],
        ]
    ).add("score", "double")

    def scan(table: pa.Table, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if required:
            table = table.filter(pc.is_valid(table.column(required[0])))
        if not table.num_rows:
            return
        scorer = factory(table)
        leaders = _Leaders(k, tie_descending)
        # keep every matrix of a step at about 32 MB
        step = max(1, 4_000_000 // max(table.num_rows, getattr(scorer, "width", 1)))
        schema = None
        for whole in batches:
            if required:
                whole = whole.filter(pc.is_valid(whole.column(required[1])))
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                ids, ties = batch.column(corpus_id), batch.column("__tie")
                schema = schema or pa.schema(
                    [
                        (question_id, table.schema.field(question_id).type),
                        (corpus_id, ids.type),
                        ("__tie", ties.type),
                        ("score", pa.float64()),
                    ]
                )
                leaders.add(ids, ties, scorer(batch))
        result = leaders.result(table.column(question_id).combine_chunks(), schema)
        if result is not None:
            yield result

    def scanned(block: pa.Table) -> DataFrame:
        return corpus.mapInArrow(lambda batches: scan(block, batches), out)

    head = questions.limit(block_rows + 1).toArrow()
    if head.num_rows <= block_rows and head.nbytes <= block_bytes:
        partial = scanned(head)
    else:
        del head
        spark = questions.sparkSession
        with Scratch(spark) as scratch:
            kept = scratch.cut(questions)
            target = scratch_path(spark, "leaders")
            for block in _question_blocks(kept, block_rows, block_bytes):
                scanned(block).write.mode("append").parquet(target)
            partial = spark.read.schema(out).parquet(target)
    by_tie = F.desc("__tie") if tie_descending else F.asc("__tie")
    return top_k_per_group(partial, [question_id], [F.desc("score"), by_tie], k).select(
        question_id, corpus_id, "rank", "score"
    )
