"""Suffix array of a byte string by induced sorting, and permuted common prefixes, in numpy.

Suffixes are classified as smaller (S) or larger (L) than their right neighbour. The leftmost S
suffixes of runs (LMS) are sorted first: by eight-byte words, and those that tie, recursively, by
their next word, to ``depth`` bytes. From their order all L suffixes are induced in one pass over
the 256 buckets, and from those all S suffixes in a second pass; a bucket is induced as a whole,
with one round more for each repetition of its own byte. Both passes are linear. Suffixes that
agree in ``depth`` bytes are neighbours in an arbitrary order.
"""

from __future__ import annotations

import numpy as np

WORD = 8


def _padded_words(text: np.ndarray, depth: int) -> np.ndarray:
    """A view of the big-endian eight-byte word that starts at every byte; zeros follow the text."""
    padded = np.zeros(len(text) + depth + 2 * WORD, np.uint8)
    padded[: len(text)] = text
    return np.ndarray((len(text) + depth + WORD,), ">u8", padded, strides=(1,))


def smaller_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the one that starts a byte later (type S)."""
    n = len(text)
    rises = np.zeros(n, np.int8)
    rises[:-1] = np.sign(text[1:].astype(np.int16) - text[:-1].astype(np.int16))
    rises[n - 1] = -1  # the empty suffix is the smallest
    # equal neighbours have the type of the next place that differs
    at = np.where(rises != 0, np.arange(n), n - 1)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return rises[at] > 0


def _sort_words(places: np.ndarray, groups: np.ndarray, words: np.ndarray, offset: int, depth: int) -> np.ndarray:
    """*places*, sorted within *groups* by their words from *offset* on, to *depth* bytes."""
    if offset >= depth or not len(places):
        return places
    keys = words[places + offset].astype(np.uint64)
    order = np.lexsort((keys, groups)) if offset else np.argsort(keys, kind="stable")
    places, keys, groups = places[order], keys[order], groups[order]
    new = np.ones(len(places), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (groups[1:] != groups[:-1])
    group = np.cumsum(new)
    tied = ~new
    tied[:-1] |= ~new[1:]
    at = np.flatnonzero(tied)
    places[at] = _sort_words(places[at], group[at], words, offset + WORD, depth)
    return places


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of all suffixes of *text* (uint8) in the order of their first *depth* bytes."""
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    small = smaller_types(text)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    lms = _sort_words(lms, np.zeros(len(lms), np.int64), _padded_words(text, depth), 0, depth)
    counts = np.bincount(text, minlength=256)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(n, -1, np.int64)
    lms_of = np.searchsorted(text[lms], np.arange(257))  # sorted by first byte as well

    # larger suffixes, from the front of the buckets
    head = starts.copy()

    def push_front(found: np.ndarray) -> None:
        byte = text[found]
        order = np.argsort(byte, kind="stable")
        byte, found = byte[order], found[order]
        size = np.bincount(byte, minlength=256)
        first = np.cumsum(size) - size
        out[head[byte] + np.arange(len(found)) - first[byte]] = found
        head[:] += size

    push_front(np.array([n - 1]))
    for c in np.flatnonzero(counts):
        at = starts[c]
        while at < head[c]:
            scanned = out[at : head[c]]
            at = head[c]
            before = scanned[scanned > 0] - 1
            push_front(before[~small[before]])
        push_front(lms[lms_of[c] : lms_of[c + 1]] - 1)

    # smaller suffixes, from the end of the buckets
    tail = ends.copy()

    def push_back(found: np.ndarray) -> None:
        byte = text[found]
        order = np.argsort(byte, kind="stable")
        byte, found = byte[order], found[order]
        size = np.bincount(byte, minlength=256)
        first = np.cumsum(size) - size
        out[tail[byte] - 1 - (np.arange(len(found)) - first[byte])] = found
        tail[:] -= size

    for c in np.flatnonzero(counts)[::-1]:
        at = ends[c]
        while at > tail[c]:
            scanned = out[tail[c] : at][::-1]
            at = tail[c]
            before = scanned[scanned > 0] - 1
            push_back(before[small[before]])
        scanned = out[starts[c] : head[c]][::-1]
        before = scanned[scanned > 0] - 1
        push_back(before[small[before]])
    return out


def permuted_prefixes(text: np.ndarray, suffixes: np.ndarray) -> np.ndarray:
    """For every start, the length of its common prefix with the suffix before it in the array.

    Where a start and its predecessor both move on by one byte the length falls by one, so only the
    other places are compared, word by word.
    """
    n = len(text)
    if n == 0:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int64)
    before[suffixes[1:]] = suffixes[:-1]
    moved = np.zeros(n, bool)
    moved[1:] = (before[1:] > 0) & (before[:-1] == before[1:] - 1)
    moved[1:] &= text[:-1] == text[before[1:] - 1]
    lengths = np.zeros(n, np.int64)
    words = _padded_words(text, WORD)
    open_ = np.flatnonzero(~moved & (before >= 0))
    while len(open_):
        a, b = open_ + lengths[open_], before[open_] + lengths[open_]
        inside = np.maximum(a, b) < n
        open_, a, b = open_[inside], a[inside], b[inside]
        differ = words[a].astype(np.uint64) ^ words[b].astype(np.uint64)
        same = np.full(len(open_), WORD, np.int64)
        for byte in range(WORD):
            same = np.where((same == WORD) & (differ >> np.uint64(8 * (WORD - 1 - byte)) != 0), byte, same)
        lengths[open_] += same
        open_ = open_[same == WORD]
    lengths = np.minimum(lengths, n - np.maximum(np.arange(n), before))
    source = np.maximum.accumulate(np.where(moved, 0, np.arange(n)))
    return lengths[source] - (np.arange(n) - source)
