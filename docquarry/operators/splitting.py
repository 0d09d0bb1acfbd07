"""Text splitters: separator recursion and Markdown sections, as small per-text helpers."""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np

# Fixed value: base of the window hashes, odd.
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix64(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (the finaliser of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))

# Separators from strongest to weakest, per kind of text.
SEMANTIC = ["\n\n\n", "\n\n", "\n", ". ", "! ", "? ", ": ", "; ", ", ", " ", ""]
PAGES = ["\n\n", "\n", ". ", ", ", " ", ""]
HTML = [
    "</h1>",
    "<h1>",
    "</h2>",
    "<h2>",
    "</h3>",
    "<h3>",
    "</h4>",
    "<h4>",
    "</h5>",
    "<h5>",
    "</h6>",
    "<h6>",
    "</div>",
    "<div>",
    "</section>",
    "<section>",
    "</article>",
    "<article>",
    "</aside>",
    "<aside>",
    "</nav>",
    "<nav>",
    "</header>",
    "<header>",
    "</footer>",
    "<footer>",
    "</p>",
    "<p>",
    "<br>",
    "<br/>",
    "<br />",
    "\n\n",
    "\n",
    ". ",
    ", ",
    " ",
    "",
]

LENGTHS: dict[str, Callable[[str], int]] = {
    "chars": len,
    "words": lambda text: len(text.split()),
    "chars4": lambda text: -(-len(text) // 4),
}


def _pieces(text: str, separator: str) -> list[str]:
    """Cut *text* before every separator; the pieces join to *text*."""
    if not separator:
        return list(text)
    first, *rest = text.split(separator)
    return [piece for piece in [first, *(separator + r for r in rest)] if piece]


def _windows(pieces: list[tuple[str, int]], size: int, overlap: int) -> Iterator[str]:
    """Join neighbours up to *size*; the next window starts with up to *overlap* of the last."""
    window: deque[tuple[str, int]] = deque()
    used = 0
    for piece in pieces:
        length = piece[1]
        if window and used + length > size:
            yield "".join(text for text, _ in window)
            while window and (used > overlap or (used + length > size and used > 0)):
                used -= window.popleft()[1]
        window.append(piece)
        used += length
    if window:
        yield "".join(text for text, _ in window)


def split_recursively(
    text: str, separators: list[str], size: int, overlap: int, length: Callable[[str], int]
) -> Iterator[str]:
    """Chunks of at most *size*, cut at the strongest separator that occurs.

    Pieces below *size* are joined again; a longer piece is cut by the weaker separators. When no
    separator is left the piece stays whole.
    """
    at = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    weaker = separators[at + 1 :] if separators[at] else []
    small: list[tuple[str, int]] = []

    def flush() -> Iterator[str]:
        for chunk in _windows(small, size, overlap):
            if chunk.strip():
                yield chunk.strip()
        small.clear()

    for piece in _pieces(text, separators[at]):
        measure = length(piece)
        if measure < size:
            small.append((piece, measure))
            continue
        yield from flush()
        if weaker:
            yield from split_recursively(piece, weaker, size, overlap, length)
        else:
            yield piece
    yield from flush()


_FENCE = re.compile(r"(```|~~~)")
_HEADER = re.compile(r"(#{1,6})(?: (.*))?")


def _paragraphs(text: str) -> Iterator[tuple[list[str | None], str]]:
    """``(headers of level 1 to 6, paragraph)``; header lines and blank lines end a paragraph."""
    headers: list[str | None] = [None] * 6
    lines: list[str] = []
    fence = ""
    for raw in [*text.split("\n"), ""]:
        line = "".join(filter(str.isprintable, raw.strip()))
        opening = _FENCE.match(line)
        if fence and not line.startswith(fence):
            lines.append(line)
            continue
        if not fence and opening and line.count(opening[1]) == 1:
            fence = opening[1]
            lines.append(line)
            continue
        fence = ""
        header = _HEADER.fullmatch(line)
        if line and not header:
            lines.append(line)
            continue
        if lines:
            yield headers, "\n".join(lines)
            lines = []
        if header:
            level = len(header[1])
            headers = [*headers[: level - 1], (header[2] or "").strip(), *[None] * (6 - level)]
    if lines:
        yield headers, "\n".join(lines)


def markdown_sections(text: str) -> Iterator[tuple[list[str | None], str]]:
    """``(headers of level 1 to 6, body)`` per run of paragraphs under the same headers.

    Header lines are not part of the body. Lines are trimmed; the paragraphs of a section are
    joined by two blanks and a line break. Fenced code is never read as a header.
    """
    for headers, run in groupby(_paragraphs(text), key=lambda pair: pair[0]):
        yield headers, "  \n".join(paragraph for _, paragraph in run)


def first_window_positions(text: str, size: int, stride: int) -> list[int]:
    """Where the window of *size* characters at every *stride* first occurs in *text*.

    Hashes of all strings of *size* characters are sorted once, so the work does not grow with the square of the
    text; equal hashes of unlike strings are searched for.
    """
    starts = range(0, len(text), stride)
    last = len(text) - size
    found: list[int] = []
    if last >= 0:
        codes = mix64(np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1))
        powers = np.cumprod(np.full(len(codes), _BASE))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(codes * powers)))
        # the base is odd, so each place's power has an inverse modulo 2^64
        inverse = np.cumprod(np.full(last + 1, np.uint64(pow(int(_BASE), -1, 1 << 64))))
        hashes = (sums[size:] - sums[: last + 1]) * inverse
        _, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        whole = starts[: last // stride + 1]
        for start, at in zip(whole, first[number[:: stride]].tolist(), strict=True):
            part = text[start : start + size]
            found.append(at if at == start or text.startswith(part, at) else text.find(part))
    found.extend(text.find(text[start : start + size]) for start in starts[len(found) :])
    return found
