"""One input row to many output rows, batch by batch, for splitters SQL cannot express."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StructType

# Rows go in and back in parts of about this many bytes or characters, so a worker's memory does not grow
# with the batches that Spark gives it.
PART_BYTES = 1 << 20
PART_CHARACTERS = 4 << 20


def _size(row: tuple) -> int:
    return sum(len(value) for value in row if isinstance(value, (str, bytes, list)))


def slices(batch: pa.RecordBatch, bytes_: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """*batch* in parts of about *bytes_* bytes, by the mean size of its rows; they are views, not copies."""
    rows = max(1, int(bytes_ * batch.num_rows / max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def expand_rows(
    df: DataFrame, inputs: list[str], fields: str, fn: Callable[..., Iterable[tuple]], drop: tuple[str, ...] = ()
) -> DataFrame:
    """Append the columns *fields* (DDL); each input row yields one row per tuple of *fn*.

    *fn* gets the values of *inputs*; columns of *drop* do not come back. The tuples of a row come back as one list beside the row, whose
    other columns cross once; the list is exploded in the JVM, where unused columns are pruned.
    """
    added = StructType.fromDDL(fields)
    kept = [c for c in df.columns if c not in drop]
    out = StructType([df.schema[c] for c in kept]).add("__rows", ArrayType(added))
    kind = to_arrow_schema(out).field("__rows").type

    fields_of = [kind.value_type.field(i) for i in range(len(added.names))]

    def part(batch: pa.RecordBatch, columns: list[list], sizes: list[int]) -> pa.RecordBatch:
        offsets = pa.array([0, *accumulate(sizes)], pa.int32())
        held = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields_of, strict=True)], fields=fields_of)
        lists = pa.ListArray.from_arrays(offsets, held, type=kind)
        return pa.RecordBatch.from_arrays([*batch.select(kept).columns, lists], names=out.names)

    def expand(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        values = [batch.column(name).to_pylist() for name in inputs]
        columns: list[list] = [[] for _ in fields_of]
        sizes: list[int] = []
        start = held = 0
        for i, args in enumerate(zip(*values, strict=True)):
            n = 0
            for row in fn(*args):
                n += 1
                held += _size(row)
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            sizes.append(n)
            if held > PART_CHARACTERS:
                yield part(batch.slice(start, i + 1 - start), columns, sizes)
                columns, sizes, start, held = [[] for _ in fields_of], [], i + 1, 0
        if sizes:
            yield part(batch.slice(start), columns, sizes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch):
                yield from expand(piece)

    return df.mapInArrow(run, out).select(*[F.col(f"`{c}`") for c in kept], F.inline("__rows"))
