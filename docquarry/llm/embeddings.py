"""Embedding near-duplicates: hyperplane sign hashing, exact cosines, connected components.

Vectors are compared only within a label. Equal (label, vector) rows are one class from the start.
``tables`` signatures of ``bits`` hyperplane signs each deal the classes into buckets; every pair of
a bucket is verified by the exact cosine in double precision. A pair is counted in the first table
in which its signatures agree, so tasks emit counts and a spanning link per vector, never pairs.

A bucket of more than ``tile`` classes is cut into tiles and its pairs of tiles are dealt to separate
tasks: exact, bounded in memory, and no cap on partners. At a cosine of 0.98 the signs agree with
probability 0.936, so a pair of exactly that cosine is missed by all tables with probability
(1 - 0.936^bits)^tables, 0.0001 for 8 bits and 10 tables; closer pairs are missed less often.

Null, empty or zero vectors, those with null or non-finite components, and null labels link with
nothing; such rows stay. Repeated ids count as rows of their own. Vectors of different lengths
never link. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written
from docquarry.llm.components import Forest, smallest_reachable

THRESHOLD = 0.98
TABLES = 10
BITS = 8
TILE = 2048
SEED = 7
STEP = 512


def _usable(vector: str, label: str) -> Column:
    """Whether the row can link with any other."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    nonzero = F.exists(vector, lambda x: x != 0)
    return F.coalesce(F.col(label).isNotNull() & (F.size(vector) > 0) & finite & nonzero, F.lit(False))


def _signatures(classes: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """*classes* with ``sigs``: one signature per table as a list of longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        powers = 1 << np.arange(bits)
        for batch in batches:
            out = []
            for vector in batch.column("vector"):
                x = np.array(vector.as_py(), np.float64)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng((seed, len(x))).standard_normal((len(x), tables * bits))
                out.append((x / np.abs(x).max()) @ planes[len(x)] > 0)
            signs = np.array(out, bool).reshape(len(out), tables, bits)
            sigs = (signs * powers).sum(2).tolist() if len(out) else []
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sigs, pa.list_(pa.int64()))], names=[*batch.schema.names, "sigs"]
            )

    return classes.mapInArrow(run, f"{_ddl(classes)}, sigs array<bigint>")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Equal-length lists as rows of length one, in double precision."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(lists), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _verify(threshold: float):
    def verify(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        table = part.column("tab")[0].as_py()
        side = part.column("side").to_numpy()
        ids = part.column("cid").to_numpy()
        units = unit_rows(part.column("vector").chunk(0))
        sigs = part.column("sigs").chunk(0).flatten().to_numpy().reshape(len(ids), -1)
        sizes = part.column("n").to_numpy()
        # a tile with itself, or two tiles
        a = np.flatnonzero(side == 0)
        alone = part.column("i")[0].as_py() == part.column("j")[0].as_py()
        b = a if alone else np.flatnonzero(side == 1)
        forest = Forest(len(ids))
        partners = np.zeros(len(ids), np.int64)
        for start in range(0, len(a), STEP):
            rows = a[start : start + STEP]
            close = units[rows] @ units[b].T >= threshold
            for t in range(table):  # found in an earlier table already
                close &= sigs[rows, t][:, None] != sigs[b, t][None, :]
            close &= rows[:, None] != b[None, :]
            partners[rows] += close @ sizes[b]
            if not alone:
                partners[b] += sizes[rows] @ close
            x, y = np.nonzero(close)
            forest.unite(rows[x], b[y])
        hit = np.flatnonzero(partners > 0)
        return pa.table({"a": ids[hit], "b": ids[forest.roots(hit)], "links": partners[hit]})

    return verify


def near_duplicates(
    vectors: DataFrame,
    threshold: float = THRESHOLD,
    *,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    tables: int = TABLES,
    bits: int = BITS,
    tile: int = TILE,
    seed: int = SEED,
) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of *vectors*."""
    rows = Written(
        vectors.select(
            F.col(key).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector"),
            _usable(vector, label).alias("usable"),
        ).withColumn("cid", F.when(F.col("usable"), F.xxhash64("label", "vector", F.md5(F.col("vector").cast("string"))))),
        "vectors",
    )
    classes = (
        rows.read().where("usable")
        .groupBy("cid")
        .agg(F.count("*").alias("n"), F.min("vec_id").alias("least"), F.first("label").alias("label"), F.first("vector").alias("vector"))
    )
    signed = Written(_signatures(classes, tables, bits, seed), "signed")
    dealt = signed.read().select(
        "cid", "n", "label", "vector", "sigs", F.posexplode("sigs").alias("tab", "sig")
    ).withColumn("length", F.size("vector"))
    bucket = ["label", "length", "tab", "sig"]
    sizes = Written(
        dealt.groupBy(*bucket).agg(F.count("*").alias("m")).where("m > 1").withColumn(
            "tiles", F.ceil(F.col("m") / tile).cast("int")
        ),
        "buckets",
    )
    # a class goes to each pair of tiles (i, j) that holds its own tile
    own = F.pmod(F.xxhash64("cid", "tab"), F.col("tiles")).cast("int")
    cells = (
        dealt.join(sizes.read(), bucket)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        .withColumn("i", F.least("own", "other"))
        .withColumn("j", F.greatest("own", "other"))
        .withColumn("side", F.when(F.col("own") == F.col("i"), 0).otherwise(1))
    )
    found = Written(
        cells.select(*bucket, "i", "j", "side", "cid", "n", "vector", "sigs")
        .groupBy(*bucket, "i", "j")
        .applyInArrow(_verify(threshold), "a long, b long, links long"),
        "veclinks",
    )
    parts = smallest_reachable(found.read().select("a", "b"))
    counts = found.read().groupBy(F.col("a").alias("cid")).agg(F.sum("links").alias("links"))
    known = (
        signed.read().select("cid", "n", "least")
        .join(counts, "cid", "left")
        .join(parts.withColumnRenamed("node", "cid"), "cid", "left")
        .select(
            "cid", "least",
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"),
            F.coalesce("component", "cid").alias("part"),
        )
    )
    smallest = known.groupBy("part").agg(F.min("least").alias("smallest"))
    answer = Written(known.join(smallest, "part").select("cid", "links", "smallest"), "vecparts")
    for used in (signed, sizes, found):
        used.delete()
    return (
        rows.read().select("vec_id", "cid")
        .join(answer.read(), "cid", "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("smallest", "vec_id").cast("long").alias("component_id"),
            F.coalesce(F.col("vec_id") == F.coalesce("smallest", "vec_id"), F.lit(False)).alias("kept"),
        )
    )
