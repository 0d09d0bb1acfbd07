"""Periodic runs of words, found through string synchronising sets.

A *run* is a stretch of words with smallest period q, at least ``max(shortest, 2 * q)`` long, that no
neighbouring word extends. All runs of a text are found:

*Small periods* up to ``SMALL`` are read off directly: the stretches in which every word equals the
one q later.

*Scales.* The scale t = 2, 4, 8, ... finds the periods 3t to 6t - 1. A position belongs to the
synchronising set of t if, of the hashes of the t-word strings starting in [i, i + t], the least one
starts at i or at i + t. Whether it does depends on the words [i, i + 2t) alone, its *context*, so a run
holds positions with equal contexts one period apart; such pairs, grouped by context, propose the period.
Strings of a period of t/3 or less are left out of the choice, because there the same context comes back
too soon; they lie in runs that smaller scales have found already. A run whose first t positions are
all left out begins with such a highly periodic region of 3t - 1 words or more, and the region ends
within the run: the last word of the region is paired with the words at all distances of the scale.

*Verification.* A proposal (position, period) is extended word by word in both directions, so hashes
decide nothing but what is looked at. Of runs with one interval the smallest period counts.

Work and memory are linear in the words per scale; scales end at a sixth of the longest text. Texts are
worked on in blocks of ``BLOCK_WORDS`` words, a longer text by itself.

Words are runs of non-blanks (space, tab, line feed, vertical tab, form feed, carriage return). A null or
blank text has no words, no runs and an empty collapsed text. Rows are taken one by one: equal rows give
equal rows, a null id is kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docquarry.llm.common import mix64, utf8_rows

SHORTEST = 12
SMALL = 5
BLOCK_WORDS = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64((1 << 64) - 1)

Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def _stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal stretches of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return edges[0::2], edges[1::2]


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every *width* consecutive values."""
    span = 1
    while span * 2 <= width:
        values = np.minimum(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of strings of twice the *width*; those beyond the end are of no use."""
    after = np.zeros_like(hashes)
    after[: len(hashes) - width] = hashes[width:]
    return mix64(hashes * _ODD + after)


def _reach(words: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """The stretch around *at* in which every word equals the one a *period* later."""
    end, step, last = at, 64, len(words) - period
    while end < last:
        differ = words[end : min(end + step, last)] != words[end + period : min(end + step, last) + period]
        first = int(differ.argmax())
        if differ[first]:
            end += first
            break
        end += len(differ)
        step *= 2
    begin, step = at, 64
    while begin > 0:
        low = max(0, begin - step)
        differ = words[low:begin] != words[low + period : begin + period]
        first = int(differ[::-1].argmax())
        if differ[len(differ) - 1 - first]:
            begin -= first
            break
        begin = low
        step *= 2
    return begin, end


def _extended(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """The runs ``(begin, end, period)`` that the proposals lie in."""
    order = np.lexsort((at, period))
    found, known, reached = [], 0, -1
    for i, p in zip(at[order].tolist(), period[order].tolist(), strict=True):
        if p == known and i < reached:
            continue
        begin, end = _reach(words, i, p)
        known, reached = p, end
        if end - begin >= p:
            found.append((begin, end + p, p))
    return np.array(found, np.int64).reshape(-1, 3)


def _paired(contexts: np.ndarray, chosen: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Chosen positions with equal contexts, and their distance, where it belongs to the scale."""
    order = np.argsort(contexts[chosen], kind="stable")
    place, key = chosen[order], contexts[chosen][order]
    at, distance = [], []
    for shift in range(1, len(place)):
        apart = place[shift:] - place[:-shift]
        near = (key[shift:] == key[:-shift]) & (apart < 6 * scale)
        if not near.any():
            break
        fits = near & (apart >= 3 * scale)
        at.append(place[:-shift][fits])
        distance.append(apart[fits])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(distance or none)


def _from_regions(hashes: np.ndarray, ends: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """The last words of highly periodic regions, paired at all distances of the scale that may fit."""
    at, distance = [], []
    periods = np.arange(3 * scale, 6 * scale)
    n = len(hashes)
    for last in (ends - 1).tolist():
        for i in (np.full(len(periods), last), last - periods):
            ok = (i >= 0) & (i + periods < n)
            a, p = i[ok], periods[ok]
            back = np.maximum(a - scale + 1, 0)
            ok = (hashes[a] == hashes[a + p]) | (hashes[back] == hashes[back + p])
            at.append(a[ok])
            distance.append(p[ok])
    none = [np.zeros(0, np.int64)]
    return np.concatenate(at or none), np.concatenate(distance or none)


def find_runs(words: np.ndarray, lengths: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """All runs of the texts in *words* as ``(begin, end, period)``, by begin and period.

    *words* holds a number per word and, after every text, a number that occurs nowhere else;
    *lengths* are those of the texts with that number.
    """
    found = []
    for p in range(1, min(SMALL, len(words) - 1) + 1):
        begin, end = _stretches(words[:-p] == words[p:])
        long = end - begin >= max(p, 4 - p)
        found.append(np.stack((begin[long], end[long] + p, np.full(long.sum(), p)), axis=1))
    where = np.arange(len(words))
    hashes = _joined(mix64((words.astype(np.uint64) + np.uint64(1)) * _ODD), 1)
    scale = 2
    while len(lengths) and lengths.max() > 6 * scale:
        enough = lengths > 6 * scale
        if lengths[enough].sum() < 0.8 * len(where):
            stay = np.repeat(enough, lengths)
            where, hashes, lengths = where[stay], hashes[stay], lengths[enough]
        contexts = _joined(hashes, scale)
        known = np.concatenate(found)
        known = known[(3 * known[:, 2] <= scale) & (known[:, 1] - known[:, 0] >= scale)]
        begin = np.searchsorted(where, known[:, 0])
        here = begin < len(where)
        here[here] = where[begin[here]] == known[here, 0]
        begin, size = begin[here], (known[:, 1] - known[:, 0])[here]
        ids = hashes
        if len(begin):
            marks = np.zeros(len(where) + 1, np.int64)
            np.add.at(marks, begin, 1)
            np.add.at(marks, begin + size - scale + 1, -1)
            ids = np.where(np.cumsum(marks[:-1]) > 0, _NEVER, hashes)
        least = _sliding_least(ids, scale + 1)
        chosen = np.flatnonzero(
            (least != _NEVER) & ((least == ids[: len(least)]) | (least == ids[scale : scale + len(least)]))
        )
        at, distance = _paired(contexts, chosen, scale)
        ends = (begin + size)[size >= 3 * scale - 1]
        more, apart = _from_regions(hashes, np.unique(ends), scale)
        at, distance = np.concatenate((at, more)), np.concatenate((distance, apart))
        found.append(_extended(words, where[at], distance))
        hashes = contexts
        scale *= 2
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    size = runs[:, 1] - runs[:, 0]
    runs = runs[size >= np.maximum(shortest, 2 * runs[:, 2])]
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    first = np.ones(len(runs), bool)
    first[1:] = (runs[1:, :2] != runs[:-1, :2]).any(axis=1)
    runs = runs[first]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _blocks(texts: list[list[bytes]], size: int) -> Iterator[list[list[bytes]]]:
    block, held = [], 0
    for words in texts:
        if block and held + len(words) > size:
            yield block
            block, held = [], 0
        block.append(words)
        held += len(words) + 1
    if block:
        yield block


def block_runs(texts: list[list[bytes]], shortest: int = SHORTEST) -> tuple[list[int], np.ndarray, list[bytes]]:
    """Runs per text, all runs ``(start, length, period)`` in order, and the collapsed texts."""
    numbers = defaultdict(count().__next__)
    lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    words = np.fromiter(
        chain.from_iterable(chain(map(numbers.__getitem__, t), (-1,)) for t in texts), np.int64, int(ends[-1])
    )
    words[ends - 1] = len(numbers) + np.arange(len(texts))
    runs = find_runs(words, lengths, shortest)
    text_of = np.searchsorted(ends, runs[:, 0], side="right")
    marks = np.zeros(len(words) + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 1], -1)
    kept = np.cumsum(marks) == 0
    per_text = np.bincount(text_of, minlength=len(texts))
    collapsed = []
    for t, n, end in zip(texts, per_text.tolist(), ends.tolist(), strict=True):
        if n:
            t = [w for w, k in zip(t, kept[end - 1 - len(t) : end - 1].tolist(), strict=True) if k]
        collapsed.append(b" ".join(t))
    begin = (ends - lengths)[text_of]
    return per_text.tolist(), np.stack((runs[:, 0] - begin, runs[:, 1] - runs[:, 0], runs[:, 2]), axis=1), collapsed


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    shortest: int = SHORTEST,
    rewrite: Rewrite | None = None,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``(id, n_words, runs, collapsed)``: the runs by start and period, and the text without repetitions.

    A word is left out of ``collapsed`` if any run holds it after its first period. *rewrite* changes
    the words of a row, given its id, before they are looked at.
    """
    triple = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.split() for t in utf8_rows(batch.column(1))]
            if rewrite:
                texts = [rewrite(i, t) for i, t in zip(batch.column(0).to_pylist(), texts, strict=True)]
            done = 0
            for block in _blocks(texts, block_words):
                per_text, runs, collapsed = block_runs(block, shortest)
                offsets = pa.array(np.concatenate(([0], np.cumsum(per_text))), pa.int32())
                values = pa.StructArray.from_arrays([pa.array(c) for c in runs.T.copy()], fields=list(triple))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(done, len(block)),
                        pa.array([len(t) for t in block], pa.int64()),
                        pa.ListArray.from_arrays(offsets, values),
                        pa.array(collapsed, pa.binary()).cast(pa.string()),
                    ],
                    names=["id", "n_words", "runs", "collapsed"],
                )
                done += len(block)

    kind = docs.schema[id_column].dataType.simpleString()
    out = f"`{id_column}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select(id_column, text).mapInArrow(run, out)
