"""SimHash near-duplicates: fingerprints, a binary-trie self-join, connected components.

*Fingerprints.* Words are runs of non-blanks after lower-casing A-Z; shingles of three words, with
repeats, are hashed by XXH64 with seed 42; a bit is one if it is set in over half the hashes.

*Links.* Two fingerprints link at a Hamming distance of at most ``budget``. Distinct fingerprints
are dealt into tries by one of ``budget + 1`` blocks of their bits: two that differ in at most
``budget`` bits agree in a block at least. Each trie is joined with itself: pairs of nodes go down
together from the root, differing bits add up, and a pair is dropped once they exceed the budget.
A trie emits one link per fingerprint to the smallest fingerprint it hangs together with there,
never its pairs. A trie with more than ``trie_rows`` fingerprints is dealt again by blocks of the
bits that are still free, until it fits, so that no group is unbounded.

*Components.* Links between fingerprints are joined up by large-star/small-star rounds.

Nulls and texts without words have fingerprint zero and link like any other. Repeated rows, equal
ids and extra columns are allowed: the columns needed are selected, and a class of equal
fingerprints is represented by its smallest id. Null ids stay, with the component of their class;
a class of null ids alone has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written, utf8_rows
from docquarry.llm.components import Forest, smallest_reachable

SEED = 42
SHINGLE = 3
BUDGET = 3
TRIE_ROWS = 100_000
FRONTIER = 1 << 18


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        # a shingle is a slice of the words joined once
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], SEED)
            for a, b in zip(
                starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist(), strict=True
            )
        ]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        block = np.array(hashes[at : at + 65_536], dtype=">u8")
        bits = np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    packed = np.packbits(counts * 2 > len(hashes))
    return int(packed.view(">u8")[0])


def with_fingerprints(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", shingle: int = SHINGLE
) -> DataFrame:
    """``(doc_id, fp)`` for every row, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t, shingle) for t in utf8_rows(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"]
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, fp long"
    )


def trie_join(values: np.ndarray, starts: np.ndarray, budget: int) -> np.ndarray:
    """Per fingerprint the index of the first one that it hangs together with in its trie.

    *starts* are the first places of the tries in *values*, which are sorted and distinct within
    each. A node of a trie is a range of values and a depth. Pairs of nodes are kept in arrays and
    go down one bit at a time, the deepest pairs first, so memory stays bounded.
    """
    forest = Forest(len(values))
    # columns: first and end of node A, first and end of node B, differing bits; A == B at first
    ends = np.append(starts[1:], len(values))
    more = ends - starts > 1
    first, end = starts[more], ends[more]
    stack = [(0, np.stack([first, end, first, end, np.zeros_like(first)], 1))]
    while stack:
        depth, pairs = stack.pop()
        if depth == 64:
            forest.unite(pairs[:, 0], pairs[:, 2])
            continue
        if len(pairs) > FRONTIER:
            half = len(pairs) // 2
            stack += [(depth, pairs[half:]), (depth, pairs[:half])]
            continue
        alone = (pairs[:, 1] - pairs[:, 0] == 1) & (pairs[:, 3] - pairs[:, 2] == 1)
        if alone.any():
            # both nodes are single leaves: the rest of the path is one comparison
            a, b = pairs[alone, 0], pairs[alone, 2]
            close = np.bitwise_count(values[a] ^ values[b]) <= budget
            forest.unite(a[close], b[close])
            pairs = pairs[~alone]
            if not len(pairs):
                continue
        mask = np.uint64(1 << (63 - depth))

        def middle(first: np.ndarray, end: np.ndarray, mask: np.uint64 = mask) -> np.ndarray:
            low, high = first.copy(), end.copy()  # first value of the range with the bit set
            while (open_ := low < high).any():
                at = (low + high) // 2
                one = (values[np.minimum(at, len(values) - 1)] & mask) != 0
                high = np.where(open_ & one, at, high)
                low = np.where(open_ & ~one, at + 1, low)
            return low

        a0, a2, b0, b2, bits = pairs.T
        a1, b1 = middle(a0, a2), middle(b0, b2)
        same = (a0 == b0) & (a2 == b2)
        below = [
            (a0, a1, b0, b1, bits, np.ones(len(bits), bool)),
            (a1, a2, b1, b2, bits, np.ones(len(bits), bool)),
            (a0, a1, b1, b2, bits + 1, np.ones(len(bits), bool)),
            (a1, a2, b0, b1, bits + 1, ~same),  # a node with itself: the mirrored pair is the same
        ]
        grown = np.concatenate([np.stack(x[:5], 1)[x[5]] for x in below])
        full = (grown[:, 1] > grown[:, 0]) & (grown[:, 3] > grown[:, 2]) & (grown[:, 4] <= budget)
        # a single leaf with itself has nothing to find
        full &= ~(
            (grown[:, 0] == grown[:, 2]) & (grown[:, 1] == grown[:, 3]) & (grown[:, 1] - grown[:, 0] == 1)
        )
        if full.any():
            stack.append((depth + 1, grown[full]))
    return forest.roots(np.arange(len(values)))


def _blocks(free: int, parts: int) -> list[int]:
    """Masks that cut the set bits of *free* into *parts* blocks of nearly equal size."""
    bits = [1 << i for i in range(64) if free >> i & 1]
    return [sum(bits[i::parts]) for i in range(parts)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _deal(df: DataFrame, free: int, parts: int, *above: str) -> DataFrame:
    """``(fp, free, key)``: *df* once per block of the bits *free*; equal blocks have equal keys."""
    blocks = [
        F.struct(
            F.lit(_signed(free & ~mask)).alias("free"),
            F.xxhash64(*above, F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(mask)))).alias("key"),
        )
        for i, mask in enumerate(_blocks(free, parts))
    ]
    return df.select("fp", F.explode(F.array(*blocks)).alias("g")).select("fp", "g.free", "g.key")


def _join_tries(tries: DataFrame, budget: int, rows: int) -> DataFrame:
    """Links ``(a, b)`` within the tries of ``(key, fp)``; about *rows* rows are held at a time."""

    def links(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        # signed order differs from bit order only in the first bit
        sizes = np.diff(np.append(starts, len(values)))
        order = np.lexsort((values.view(np.uint64), np.repeat(np.arange(len(starts)), sizes)))
        values = values.view(np.uint64)[order]
        root = trie_join(values, starts, budget)
        linked = root != np.arange(len(values))
        return pa.RecordBatch.from_arrays(
            [pa.array(values[linked].view(np.int64)), pa.array(values[root[linked]].view(np.int64))],
            names=["a", "b"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column(0).to_numpy()])
            values = np.concatenate([values, batch.column(1).to_numpy()])
            if len(keys) > rows:
                # the last trie may go on in the next batch
                whole = int(np.searchsorted(keys, keys[-1]))
                if whole:
                    yield links(keys[:whole], values[:whole])
                    keys, values = keys[whole:], values[whole:]
        if len(keys):
            yield links(keys, values)

    dealt = tries.select("key", "fp").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def fingerprint_links(
    fps: DataFrame, budget: int = BUDGET, trie_rows: int = TRIE_ROWS
) -> list[Written]:
    """Written tables of links ``(a, b)`` that connect all distinct *fps* within *budget* bits."""
    if trie_rows < 1 << (budget + 1):
        raise ValueError("a trie must have room for all values of its last free bits")
    pending = Written(_deal(fps, (1 << 64) - 1, budget + 1), "tries")
    found: list[Written] = []
    while pending:
        rows = pending.read()
        sizes = Written(rows.groupBy("key").agg(F.count("*").alias("n")).where(f"n > {trie_rows}"), "sizes")
        fits = rows.join(sizes.read(), "key", "left_anti")
        found.append(Written(_join_tries(fits, budget, trie_rows), "fplinks"))
        # tries that are too large are dealt again by blocks of the bits that are still free
        big = rows.join(sizes.read(), "key", "left_semi")
        frees = [row[0] for row in big.select("free").distinct().collect()]
        after = None
        for free in frees:
            part = _deal(big.where(F.col("free") == free), free & ((1 << 64) - 1), budget + 1, "key")
            after = part if after is None else after.union(part)
        dealt = Written(after, "tries") if after is not None else None
        sizes.delete()
        pending.delete()
        pending = dealt
    return found


def near_duplicates(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    budget: int = BUDGET,
    trie_rows: int = TRIE_ROWS,
    shingle: int = SHINGLE,
) -> DataFrame:
    """``(doc_id, fp, component_id)`` per row; *component_id* is the smallest id reachable."""
    prints = Written(with_fingerprints(docs, id_column, text, shingle), "prints")
    classes = prints.read().groupBy("fp").agg(F.min("doc_id").alias("least"))
    links = fingerprint_links(prints.read().select("fp").distinct(), budget, trie_rows)
    edges = links[0].read()
    for more in links[1:]:
        edges = edges.union(more.read())
    parts = smallest_reachable(edges)
    for used in links:
        used.delete()
    grouped = classes.join(parts, classes.fp == parts.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("part")
    )
    smallest = grouped.groupBy("part").agg(F.min("least").alias("component_id"))
    of_print = grouped.select("fp", "part").join(smallest, "part").select("fp", "component_id")
    return prints.read().join(of_print, "fp").select("doc_id", "fp", "component_id")
