"""Benchmark decontamination: one Aho-Corasick automaton over the words of all test items.

Items and texts are normalised alike: A-Z are lower-cased, words are runs of ASCII letters, digits
and all other characters beyond ASCII. A window is ``size`` consecutive words of an item; an item
of fewer words, but not none, is one window. The automaton's symbols are the numbers of the items'
words, so a pattern has ``size`` symbols at most. A text is mapped to numbers and scanned once; every
occurrence marks its words, and word offsets lead back to characters of the original text.

The item windows are the only data sent to the tasks, and each Python worker builds its automaton
once. Up to ``max_items_bytes`` of items make one automaton. A larger benchmark is cut into blocks
of at most that size (a longer item is a block of its own): every block has its automaton and one
scan, which writes only the hits under the digest of their text, and the hits of all blocks are
then joined to the documents. The answer is the same either way.

Null texts and items have no words. Null item ids are left out of the digest but mark words.
Repeated ids, rows and items are allowed; extra columns are ignored. Without items nothing is hit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import Written, utf8_rows

SIZE = 10
# Measured: a worker with an automaton of 4 MB of random words peaks at about 130 times their bytes.
MAX_ITEMS_BYTES = 4 * 1024 * 1024
# Runs of word characters in a text that is not lower-cased yet.
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Bytes that end a word become blanks, A-Z become a-z; a word is then what split() gives.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
    for b in range(256)
)

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split()


class Scanner:
    """The automaton of all windows, and what it finds in a text."""

    def __init__(self, items: tuple[tuple[str | None, bytes], ...], size: int) -> None:
        self.numbers: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str | None]] = {}
        for item, text in items:
            symbols = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text))
            for start in range(max(1, len(symbols) - size + 1) if symbols else 0):
                owners.setdefault(symbols[start : start + size], set()).add(item)
        self.automaton = None
        if owners:
            self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
            for window, ids in owners.items():
                self.automaton.add_word(window, (len(window), tuple(ids)))
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
        """Maximal runs ``[first, end)`` of hit words, and the items that occur."""
        if self.automaton is None or not words:
            return [], set()
        number = self.numbers.get
        runs: list[list[int]] = []
        items: set[str | None] = set()
        # ends rise, so an occurrence joins or swallows the last runs
        for end, (length, ids) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            first, after = end - length + 1, end + 1
            while runs and runs[-1][1] >= first:
                first = min(first, runs.pop()[0])
            runs.append([first, after])
            items.update(ids)
        return [(a, b) for a, b in runs], items


@lru_cache(maxsize=2)
def _scanner(items: tuple[tuple[str | None, bytes], ...], size: int) -> Scanner:
    return Scanner(items, size)


def _offsets(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets ``[start, end)`` in the original text of runs of words."""
    letters = np.frombuffer(text.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], letters.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # characters before a byte: bytes that are not continuations
    chars = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


Items = tuple[tuple[str | None, bytes], ...]


def _collected(narrow: DataFrame) -> Items:
    return tuple(sorted(((r[0], r[1].encode()) for r in narrow.select("id", "text").distinct().collect()), key=repr))


def _item_blocks(items: DataFrame, item_id: str, text: str, max_items_bytes: int) -> Iterator[Items]:
    """The items in blocks of at most *max_items_bytes*; a longer item is alone in its block."""
    narrow = items.select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text")).where(
        "text is not null"
    )
    size = narrow.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= max_items_bytes:
        yield _collected(narrow)
        return
    written = Written(narrow.distinct().withColumn("hash", F.xxhash64("id", "text")), "items")
    parts = -(-2 * size // max_items_bytes)
    while True:
        dealt = written.read().withColumn("block", F.pmod("hash", F.lit(parts)))
        sizes = dealt.groupBy("block").agg(
            F.sum(F.octet_length("text") + 16).alias("size"), F.count_distinct("hash").alias("n")
        )
        if sizes.where((F.col("size") > max_items_bytes) & (F.col("n") > 1)).isEmpty():
            break
        parts *= 2
    for row in sizes.select("block").orderBy("block").toLocalIterator():
        yield _collected(dealt.where(F.col("block") == row[0]))
    written.delete()


def _text_digest(text: str) -> Column:
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


_RUN = pa.struct([(name, pa.int64()) for name in ("first", "after", "start", "end")])


def _block_hits(docs: DataFrame, known: Items, size: int, text: str) -> Written:
    """``(digest, runs, items)`` of every text that holds a window of *known*, written."""
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent.value, size)
        for batch in batches:
            at, spans, items = [], [], []
            for i, value in enumerate(utf8_rows(batch.column(1))):
                runs, found = scanner.scan(words_of(value))
                if runs:
                    at.append(i)
                    places = _offsets(value, runs)
                    spans.append([(*r, *o) for r, o in zip(runs, places, strict=True)])
                    items.append(list(found))
            names = _RUN.names
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at, pa.int64())),
                    pa.array([[dict(zip(names, r)) for r in x] for x in spans], pa.list_(_RUN)),
                    pa.array(items, pa.list_(pa.string())),
                ],
                names=["digest", "runs", "items"],
            )

    texts = docs.select(_text_digest(text).alias("digest"), F.col(text).alias("text"))
    hits = texts.mapInArrow(
        run,
        "digest string, runs array<struct<first:bigint,after:bigint,start:bigint,end:bigint>>, items array<string>",
    )
    written = Written(hits.dropDuplicates(["digest"]), "hits")
    sent.unpersist()
    return written


def _in_blocks(docs: DataFrame, blocks: Iterator[Items], size: int, text: str) -> DataFrame:
    """``(digest, runs, items)``, lists of lists, per text hit by any block; one scan a block."""
    found = [_block_hits(docs, known, size, text).read() for known in blocks]
    hits = found[0]
    for more in found[1:]:
        hits = hits.union(more)
    return hits.groupBy("digest").agg(
        F.flatten(F.collect_list("runs")).alias("runs"), F.flatten(F.collect_list("items")).alias("items")
    )


def _merged(runs: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Maximal runs of words, with their characters, of the runs of several blocks."""
    out: list[list[int]] = []
    for first, after, start, end in sorted(runs):
        if out and out[-1][1] >= first:
            out[-1][1], out[-1][3] = max(out[-1][1], after), max(out[-1][3], end)
        else:
            out.append([first, after, start, end])
    return out


def _row(n_words: int, runs: list[tuple[int, int]], found: set[str | None]) -> tuple:
    ids = sorted(x for x in found if x is not None)
    hit = sum(b - a for a, b in runs)
    return n_words, hit, len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), hit > 0


def _batch(keys: pa.Array, made: list[tuple], spans: bool) -> pa.RecordBatch:
    columns = list(zip(*made, strict=True)) if made else [[] for _ in range(5 + spans)]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]
    arrays = [pa.array(c, t) for c, t in zip(columns, types)]
    if spans:
        pair = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        arrays.append(pa.array([[{"start": a, "end": b} for a, b in x] for x in columns[5]], pair))
    names = ["doc_id", *RESULT.replace(",", "").split()[::2], *["spans"] * spans]
    return pa.RecordBatch.from_arrays([keys, *arrays], names=names)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    *,
    key: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    spans: bool = False,
    max_items_bytes: int = MAX_ITEMS_BYTES,
) -> DataFrame:
    """Per document the words hit, the items that occur and whether any does.

    With *spans* also ``spans``: maximal hit passages as character offsets of the original text.
    """
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, {RESULT}" + ", spans array<struct<start:bigint,end:bigint>>" * spans
    blocks = _item_blocks(items, item_id, item_text, max_items_bytes)
    known, more = next(blocks), next(blocks, None)
    if more is not None:
        hits = _in_blocks(docs, chain((known, more), blocks), size, text)
        counted = docs.select(
            F.col(key).alias("doc_id"),
            F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long").alias("n_words"),
            _text_digest(text).alias("digest"),
        )

        def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = []
                for n_words, runs, found in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                    whole = _merged([tuple(r.values()) for r in runs or []])
                    row = _row(n_words, [(r[0], r[1]) for r in whole], set(found or []))
                    made.append((*row, *([[(r[2], r[3]) for r in whole]] if spans else [])))
                yield _batch(batch.column(0), made, spans)

        joined = counted.join(hits, "digest", "left").select("doc_id", "n_words", "runs", "items")
        return joined.mapInArrow(join_up, schema)
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent.value, size)
        for batch in batches:
            made = []
            for value in utf8_rows(batch.column(1)):
                words = words_of(value)
                runs, found = scanner.scan(words)
                made.append((*_row(len(words), runs, found), *([_offsets(value, runs)] if spans else [])))
            yield _batch(batch.column(0), made, spans)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def clean_documents(
    docs: DataFrame,
    items: DataFrame,
    size: int = SIZE,
    text: str = "text",
    *,
    max_items_bytes: int = MAX_ITEMS_BYTES,
) -> DataFrame:
    """*docs* without the rows in which a window of *items* occurs; every column is kept."""
    blocks = _item_blocks(items, "item_id", "text", max_items_bytes)
    known, more = next(blocks), next(blocks, None)
    if more is not None:
        hit = _in_blocks(docs, chain((known, more), blocks), size, text).select(F.col("digest").alias("__hit"))
        return docs.join(hit, _text_digest(text) == F.col("__hit"), "left_anti")
    sent = docs.sparkSession.sparkContext.broadcast(known)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner(sent.value, size)
        for batch in batches:
            keep = [not scanner.scan(words_of(value))[0] for value in utf8_rows(batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
