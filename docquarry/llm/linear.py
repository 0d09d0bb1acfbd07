"""Sparse text features, and fitting on a bounded sample, for the two classifiers.

Features are indicators, hashed into ``2**bits`` columns: words and pairs of words after
lower-casing A-Z, beginnings of words, and n-grams of the text's shape (letters in runs, case,
blanks, lines, every sign as itself). The shape makes layout and shouting visible in any language.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import mix64, utf8_rows

BITS = 18

# One number per kind of byte: capital, other letter, digit, blank, line end, or the sign itself.
_KIND = np.array(
    [
        1 if 65 <= b <= 90 else 2 if 97 <= b <= 122 or b >= 128 else 3 if 48 <= b <= 57
        else 5 if b == 10 else 4 if b in (32, 9, 11, 12, 13) else 6 + b
        for b in range(256)
    ],
    np.uint64,
)
_SIGNS = bytes(b if 65 <= b <= 90 or 97 <= b <= 122 or 48 <= b <= 57 or b >= 128 else 32 for b in range(256))
CACHE = 1 << 20


class Features:
    """The distinct feature columns of a text. A worker keeps one, with the hashes of seen words."""

    def __init__(self, bits: int = BITS, words: bool = True, pairs: bool = True, heads: tuple[int, ...] = (), shape: tuple[int, ...] = ()) -> None:
        self.bits, self.words, self.pairs, self.heads, self.shape = bits, words, pairs, heads, shape
        self.seen: dict[bytes, int] = {}

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        seen = self.seen
        if len(seen) > CACHE:
            seen.clear()
        out = [seen.get(w) for w in words]
        for i, value in enumerate(out):
            if value is None:
                out[i] = seen[words[i]] = zlib.crc32(words[i]) | len(words[i]) << 32
        return np.array(out, np.uint64)

    def __call__(self, text: bytes) -> np.ndarray:
        salt = np.uint64(0x9E3779B97F4A7C15)
        found = []
        if self.words or self.pairs or self.heads:
            words = text.translate(_SIGNS).lower().split()
            ids = self._hashes(words)
            if self.words:
                found.append(mix64(ids + salt))
            if self.pairs and len(ids) > 1:
                found.append(mix64(mix64(ids[:-1] + salt) * np.uint64(3) + ids[1:]))
            for n in self.heads:
                heads = self._hashes([w[:n] for w in words if len(w) > n])
                found.append(mix64(heads + np.uint64((0x9E3779B97F4A7C15 * (n + 2)) % 2**64)))
        if self.shape and text:
            kinds = _KIND[np.frombuffer(text, np.uint8)]
            # a run of small letters counts once, two or more capitals or signs count as two
            keep = np.ones(len(kinds), bool)
            keep[1:] = (kinds[1:] != kinds[:-1]) | (kinds[1:] != 2)
            keep[2:] &= (kinds[2:] != kinds[1:-1]) | (kinds[2:] != kinds[:-2])
            kinds = kinds[keep]
            for n in self.shape:
                if len(kinds) >= n:
                    code = np.zeros(len(kinds) - n + 1, np.uint64)
                    for i in range(n):
                        code = code * np.uint64(263) + kinds[i : len(kinds) - n + 1 + i]
                    found.append(mix64(code + np.uint64((0x9E3779B97F4A7C15 * (100 + n)) % 2**64)))
        if not found:
            return np.zeros(0, np.int64)
        return np.unique(np.concatenate(found) >> np.uint64(64 - self.bits)).astype(np.int64)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, seed: int, keep: Column | None = None
) -> tuple[DataFrame, np.ndarray]:
    """``(key, text, grade)`` of at most *per_class* documents of label 0 and of 1, and the labels' counts.

    Labels are chosen by their smallest seeded hashes among those that *keep*, before any text is
    read, so the chosen keys, 2 * *per_class* at most, go to the texts and no text is shuffled for it.
    """
    known = labels.where(F.col(label).isin(0, 1)).select(
        F.col("doc_id").alias("key"), F.col(label).cast("int").alias("grade")
    )
    if keep is not None:
        known = known.where(keep)
    known = known.distinct()
    found = dict(known.groupBy("grade").count().collect())
    chosen = [
        known.where(F.col("grade") == grade).orderBy(F.xxhash64("key", F.lit(seed)), "key").limit(per_class)
        for grade in (0, 1)
    ]
    picked = F.broadcast(chosen[0].union(chosen[1]))
    texts = docs.select(F.col("doc_id").alias("key"), "text").join(picked, "key")
    # a document that stands in several rows counts once
    return texts.dropDuplicates(["key", "grade"]), np.array([found.get(0, 0), found.get(1, 0)])


def class_counts(grades: np.ndarray, rows: list[np.ndarray], classes: int, bits: int) -> np.ndarray:
    """Documents per class that have each feature."""
    counts = np.zeros((classes, 1 << bits), np.int64)
    for grade, columns in zip(grades, rows, strict=True):
        counts[grade, columns] += 1
    return counts


def sample_features(sample: DataFrame, make: Callable[[], Features]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Grades and feature columns of a bounded sample, brought to the driver without texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = make()
        for batch in batches:
            columns = [features(t).astype(np.int32) for t in utf8_rows(batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns, pa.list_(pa.int32()))],
                names=["key", "grade", "features"],
            )

    rows = (
        sample.select(F.col("key").cast("long"), F.col("grade").cast("int"), "text")
        .mapInArrow(run, "key long, grade int, features array<int>")
        .toArrow()
        .sort_by([("key", "ascending"), ("grade", "ascending")])
    )
    return rows.column("grade").to_numpy(), [np.array(x.values) if x.values is not None else np.zeros(0, np.int32) for chunk in rows.column("features").chunks for x in chunk]
