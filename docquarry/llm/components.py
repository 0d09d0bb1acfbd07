"""Connected components as a series of small joins: alternating large-star and small-star steps.

Every step is linear in the links. A node with very many neighbours costs one partial minimum per
task and a join that Spark can split. Each round is written to the shared folder, so a lost
executor repeats one round at most, and the round before is deleted.

Tasks join up their own links first, at most ``TASK_LINKS`` at a time, and hand on one link per node. Links that
fit one such task need no rounds: every round costs the driver thousands of tasks, however few the links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written

#: Links that a task joins up at a time.
TASK_LINKS = 1 << 18


class Forest:
    """Components of the numbers below *n* within one task; a root is its component's smallest."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.parent[x]
            if np.array_equal(up, x):
                return x
            self.parent[x] = self.parent[up]
            x = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.roots(a), self.roots(b)
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def _joined_up(links: DataFrame, tasks: int, held: int) -> DataFrame:
    """One link ``(u, v)`` per node to the smallest it hangs together with among *held* links or so of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            nodes, places = np.unique(np.concatenate(waiting), return_inverse=True)
            places = places.reshape(-1, 2)
            forest = Forest(len(nodes))
            forest.unite(places[:, 0], places[:, 1])
            root = forest.roots(np.arange(len(nodes)))
            linked = root != np.arange(len(nodes))
            return pa.RecordBatch.from_arrays([pa.array(nodes[linked]), pa.array(nodes[root[linked]])], names=["u", "v"])

        waiting: list[np.ndarray] = []
        n = 0
        for batch in batches:
            if n and n + batch.num_rows > held:
                yield out()
                waiting, n = [], 0
            waiting.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1))
            n += batch.num_rows
        if n:
            yield out()

    return links.coalesce(tasks).mapInArrow(run, "u long, v long")


def smallest_reachable(links: DataFrame, max_rounds: int = 60, task_links: int = TASK_LINKS) -> DataFrame:
    """``(node, component)`` for every node of *links* ``(a, b)`` that is not its own component.

    ``component`` is the smallest node reachable. Loops and repeated links are allowed; nodes
    without a smaller reachable node are absent. Nulls are left out. Nodes are whole numbers, read as longs.
    """
    proper = links.where("a is not null and b is not null and a <> b").select(F.col("a").cast("long"), F.col("b").cast("long"))
    tasks = -(-proper.count() // task_links)
    if tasks <= 1:
        alone = Written(_joined_up(proper, 1, task_links), "links").read()
        return alone.select(F.col("u").alias("node"), F.col("v").alias("component"))
    now = Written(_joined_up(proper, tasks, task_links).distinct(), "links")
    seen = None
    for _ in range(max_rounds):
        both = now.read().select("u", "v").union(now.read().select(F.col("v"), F.col("u")))
        # large star: every larger neighbour moves to the smallest of the neighbourhood
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (
            both.join(least, "u")
            .where("v > u and v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        # small star: every smaller neighbour, and the node, move to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = Written(small, "links")
        now.delete()
        now = after
        sums = now.read().agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))
        ).first()
        if sums == seen:
            break
        seen = sums
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.read().select(F.col("u").alias("node"), F.col("v").alias("component"))
