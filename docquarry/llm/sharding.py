"""Shards by a k-d tree: weighted median cuts along the widest metadata dimension. Native Spark.

Every row is a point of a few metadata dimensions, each quantised to ``LEVELS`` steps of its global
range, with its bytes as weight. A node that must give k leaves is cut where floor(k/2)/k of its
bytes lie on the left, along the dimension in which its points spread widest, until every node is
one leaf. The cut is found digit by digit: a histogram of the dimension, then one of ten bits of the
text's hash and two of ten bits of a row hash inside the step that holds the median. Each histogram is one
map-side aggregation of at most ``LEVELS`` rows per node. Equal texts of equal coordinates stay together unless
they straddle a wanted median; those are told apart by the row hash, so a group of copies or a source that
holds a third of all rows is cut like any other.

Slots are numbered from counts per (shard, hash bucket), so no task ever holds a whole shard.

Null texts weigh one byte, null dimensions are the smallest value, rows without an id differ by their texts.
Rows that are equal in every column share a leaf. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docquarry.llm.common import Written

LEVELS = 1024
DIGITS = ("t1", "h1", "h2")
SLOT_BUCKETS = 4096


def prefix_code(column: str) -> Column:
    """The first six UTF-8 bytes of a string as a number that keeps their order; null is 0."""
    head = F.hex(F.substring(F.rpad(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"), 6, F.lit(b"\0")), 1, 6))
    return F.conv(head, 16, 10).cast("double")


def document_dimensions() -> dict[str, Column]:
    """Language, source, length and distance in bits of a document."""
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    return {
        "lang": prefix_code("lang"),
        "source": prefix_code("source"),
        "length": F.log2(size + F.lit(1.0)),
    }


def _points(docs: DataFrame, dimensions: Mapping[str, Column], text: str, key: str) -> DataFrame:
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    texts = F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.lit("text"))
    row = F.xxhash64(F.col(key), texts, F.lit("order"))
    return docs.select(
        F.col(key).alias("doc_id"),
        size.alias("size"),
        crc.alias("text_crc32"),
        F.pmod(texts, F.lit(LEVELS)).cast("int").alias("t1"),
        F.pmod(row, F.lit(LEVELS)).cast("int").alias("h1"),
        F.pmod(F.shiftright(row, 10), F.lit(LEVELS)).cast("int").alias("h2"),
        F.pmod(F.shiftright(row, 20), F.lit(SLOT_BUCKETS)).cast("int").alias("slots"),
        *[expr.cast("double").alias(f"x_{name}") for name, expr in dimensions.items()],
    )


def kd_shards(
    docs: DataFrame,
    leaves: int | None = None,
    target_bytes: int | None = None,
    dimensions: Mapping[str, Column] | None = None,
    text: str = "text",
    key: str = "doc_id",
) -> DataFrame:
    """``(doc_id, size, text_crc32, shard, slot)``; *leaves* shards or as many as *target_bytes* asks.

    One of the two must be given. Shards are numbered from 0 in tree order; slots are gapless from
    0 within a shard.
    """
    dimensions = dict(dimensions or document_dimensions())
    names = list(dimensions)
    raw = Written(_points(docs, dimensions, text, key), "points")
    total = raw.read().agg(
        F.sum("size"),
        *[f(f"x_{n}") for n in names for f in (F.min, F.max)],
    ).first()
    if leaves is None:
        leaves = max(1, -(-int(total[0] or 0) // int(target_bytes)))
    steps = []
    for i, name in enumerate(names):
        low, high = total[1 + 2 * i], total[2 + 2 * i]
        if low is None or not high > low:
            steps.append(F.lit(0))
        else:
            scaled = (F.coalesce(F.col(f"x_{name}"), F.lit(low)) - F.lit(low)) * F.lit(LEVELS / (high - low))
            steps.append(F.least(F.floor(scaled), F.lit(LEVELS - 1)).cast("int"))
    state = raw.read().select(
        "doc_id", "size", "text_crc32", "slots", *DIGITS,
        *[s.alias(f"q_{n}") for s, n in zip(steps, names, strict=True)],
        F.lit(0).alias("first"), F.lit(int(leaves)).alias("k"),
    )
    done = [raw]
    for _ in range(max(0, (int(leaves) - 1).bit_length())):
        cuts, used = _cuts(state, names)
        state = _apply(state, cuts.read())
        now = Written(state, "points")
        for old in (*done, cuts, *used):
            old.delete()
        done, state = [now], now.read()
    return _slots(state)


def _coordinate(names: list[str]) -> Column:
    """The row's step along the dimension that its node is cut in."""
    return F.element_at(F.array(*[F.col(f"q_{n}") for n in names]), F.col("dim"))


def _cuts(state: DataFrame, names: list[str]) -> tuple[Written, list[Written]]:
    """Per open node: the dimension and the digits (step, text hash, row hash) of its weighted median."""
    spread = [(F.max(f"q_{n}") - F.min(f"q_{n}")).alias(f"w_{n}") for n in names]
    widest = F.array_position(
        F.array(*[F.col(f"w_{n}") for n in names]), F.greatest(*[F.col(f"w_{n}") for n in names], F.lit(-1))
    )
    nodes = Written(
        state.where("k > 1")
        .groupBy("first", "k")
        .agg(F.sum("size").alias("bytes"), *spread)
        .select(
            "first", "k", widest.cast("int").alias("dim"),
            # bytes that belong on the left of the cut
            F.expr("(bytes * (k div 2)) div k").alias("want"),
        ),
        "nodes",
    )
    used = [nodes]
    digits = ["d0", *DIGITS]
    for level in range(len(digits)):
        rows = state.join(nodes.read(), ["first", "k"]).withColumn("d0", _coordinate(names))
        for chosen in digits[:level]:
            rows = rows.where(F.col(chosen) == F.col(f"c_{chosen}"))
        digit = digits[level]
        histogram = rows.groupBy("first", F.col(digit).alias("digit")).agg(F.sum("size").alias("mass"))
        order = Window.partitionBy("first").orderBy("digit")
        running = histogram.withColumn("after", F.sum("mass").over(order)).withColumn(
            "before", F.col("after") - F.col("mass")
        )
        # the first step whose end passes the wanted mass holds the median
        hit = (
            running.join(nodes.read().select("first", "want"), "first")
            .groupBy("first")
            .agg(
                F.min_by(F.struct("digit", "before"), F.when(F.col("after") > F.col("want"), F.col("digit"))).alias("at")
            )
        )
        narrowed = nodes.read().join(hit, "first").select(
            "first", "k", "dim",
            (F.col("want") - F.col("at.before")).alias("want"),
            *[f"c_{c}" for c in digits[:level]],
            F.col("at.digit").alias(f"c_{digit}"),
        )
        nodes = Written(narrowed, "nodes")
        used.append(nodes)
    return nodes, used[:-1]


def _apply(state: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with the node below the cut that they fall into."""
    names = [c[2:] for c in state.columns if c.startswith("q_")]
    joined = state.join(cuts.drop("want"), ["first", "k"], "left").withColumn("d0", _coordinate(names))
    digits = ("d0", *DIGITS)
    left = F.struct(*digits) < F.struct(*[F.col(f"c_{d}").alias(d) for d in digits])
    half = F.expr("k div 2")
    return joined.select(
        "doc_id", "size", "text_crc32", "slots", *DIGITS, *[f"q_{n}" for n in names],
        F.when(F.col("dim").isNull() | left, F.col("first")).otherwise(F.col("first") + half).cast("int").alias("first"),
        F.when(F.col("dim").isNull(), F.col("k")).when(left, half).otherwise(F.col("k") - half).cast("int").alias("k"),
    )


def _slots(state: DataFrame) -> DataFrame:
    """Number the rows of each shard from counts per hash bucket."""
    rows = state.select("doc_id", "size", "text_crc32", F.col("first").alias("shard"), "slots")
    counts = rows.groupBy("shard", "slots").agg(F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("slots")
    offsets = counts.select("shard", "slots", (F.sum("n").over(order) - F.col("n")).alias("offset"))
    within = Window.partitionBy("shard", "slots").orderBy("doc_id", "text_crc32", "size")
    return (
        rows.withColumn("r", F.row_number().over(within))
        .join(offsets, ["shard", "slots"])
        .select(
            "doc_id", "size", "text_crc32", "shard",
            (F.col("offset") + F.col("r") - 1).cast("long").alias("slot"),
        )
    )
