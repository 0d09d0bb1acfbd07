"""Deterministic embeddings computed by the JVM from a digest or from code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.binding import let
from docquarry.functions.text import strip


def _digest_values(hex_digest: Column, count: int, scale) -> Column:
    """The digest bytes as doubles, each mapped by *scale*."""
    places = F.sequence(F.lit(0), F.lit(count - 1))

    def value(i: Column) -> Column:
        return scale(F.conv(F.substr(hex_digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double"))

    return F.transform(places, value)


def _tile(core: Column, width: int, dim: int) -> Column:
    """Repeat the *width* core values cyclically up to *dim*."""
    if dim == width:
        return core
    tiled = F.flatten(F.array_repeat(core, -(-dim // width)))
    return tiled if dim % width == 0 else F.slice(tiled, 1, dim)


def _unit(values: Column, copies: int = 1) -> Column:
    """Divide by the length of *values* repeated *copies* times."""
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x) * copies
    return let(F.sqrt(square), lambda size: F.transform(values, lambda x: x / size))


def sha256_embedding(text: Column, dim: int = 384) -> Column:
    """Unit vector of the SHA-256 bytes mapped to [-1, 1], repeated up to *dim*; null if blank."""

    def from_hex(digest: Column) -> Column:
        values = _digest_values(digest, 32, lambda b: (b - 127.5) / 127.5)
        if dim % 32 == 0:
            # whole turns: normalise the 32 values once, then repeat them
            return _tile(let(values, lambda v: _unit(v, dim // 32)), 32, dim)
        return let(_tile(values, 32, dim), lambda v: _unit(v))

    return F.when(F.length(strip(text)) > 0, let(F.sha2(text, 256), from_hex))


def md5_embedding(text: Column, dim: int = 1536) -> Column:
    """MD5 bytes mapped to [-1, 1] and repeated up to *dim*, not normalised."""

    def from_hex(digest: Column) -> Column:
        return _tile(_digest_values(digest, 16, lambda b: b / 255.0 * 2.0 - 1.0), 16, dim)

    return let(F.md5(text), from_hex)


def codepoint_pattern(text: Column) -> Column:
    """Sum of the code points modulo 100."""
    # ascii() gives the code point of the first character, beyond ASCII too
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    total = F.aggregate(codes, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return F.pmod(total, F.lit(100).cast("bigint"))


def codepoint_embedding(text: Column, dim: int = 384) -> Column:
    """Unit ramp that starts at the code-point pattern; null if blank."""
    # sum of ((p + i) / 100)^2 over i = 0 .. dim - 1 in closed form
    s1 = dim * (dim - 1) / 2
    s2 = (dim - 1) * dim * (2 * dim - 1) / 6

    def ramp_from(start: Column) -> Column:
        square = (start * start * dim + start * (2 * s1) + s2) / 10000.0
        steps = F.sequence(F.lit(0), F.lit(dim - 1))
        return let(
            F.sqrt(square), lambda size: F.transform(steps, lambda i: (start + i) / 100.0 / size)
        )

    ramp = let(codepoint_pattern(text).cast("double"), ramp_from)
    return F.when(F.length(strip(text)) > 0, ramp)
