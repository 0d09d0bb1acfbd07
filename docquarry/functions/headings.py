"""Heading lists and their hierarchy paths, one array column per document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.functions.binding import let
from docquarry.functions.text import match_spans, strip, strip_tags
from docquarry.schema import HEADINGS

SEPARATOR = " > "
PDF_SIZES = 5
PDF_MAX_TEXT = 200
PDF_SLOTS = 10


def _heading(text, level, position, page, font_size, path) -> Column:
    return F.struct(
        text.alias("text"),
        level.cast("int").alias("level"),
        position.cast("int").alias("position"),
        page.cast("int").alias("page"),
        font_size.cast("double").alias("font_size"),
        path.alias("path"),
    )


def markdown_headings(text: Column) -> Column:
    """``#`` headings with the paths of a stack: skipped levels close up."""
    spans = match_spans(text, r"(?md)^(#+)\s+(.+?)$")
    flat = F.transform(
        spans,
        lambda s: _heading(
            strip(F.regexp_extract(s["match"], r"(?sd)^#+\s+(.+)$", 1)),
            F.length(F.regexp_extract(s["match"], r"^(#+)", 1)),
            s["position"],
            F.lit(1),
            F.lit(12.0),
            F.lit(""),
        ),
    )
    return stack_paths(flat)


def html_headings(html: Column) -> Column:
    """``h1`` to ``h6`` in document order with slot paths."""

    def of_level(level: int) -> Column:
        pattern = rf"(?is)<h{level}[^>]*>(.+?)</h{level}>"
        found = F.transform(
            match_spans(html, pattern),
            lambda s: F.struct(
                s["position"].alias("position"),
                F.lit(level).alias("level"),
                strip(strip_tags(F.regexp_extract(s["match"], pattern, 1))).alias("text"),
            ),
        )
        none = F.expr("cast(array() as array<struct<position:int,level:int,text:string>>)")
        # most pages lack most levels; a substring test is far cheaper than two regex passes
        return F.when(F.contains(F.lower(html), F.lit(f"<h{level}")), found).otherwise(none)

    ordered = F.array_sort(F.concat(*[of_level(level) for level in range(1, 7)]))
    flat = F.transform(
        ordered,
        lambda h: _heading(
            h["text"],
            h["level"],
            h["position"],
            F.lit(1),
            F.lit(12.0) + (F.lit(6) - h["level"]) * F.lit(2.0),
            F.lit(""),
        ),
    )
    return slot_paths(flat, 6)


def font_headings(runs: Column, level_mode: str = "per_size") -> Column:
    """Headings from font runs: the five largest sizes, texts up to 200 characters.

    *runs* is ``array<struct<text,font_size,page,position>>``. ``per_size`` gives every size one
    level; ``per_item`` numbers the headings themselves, largest first, and gives none at all
    beyond ten.
    """
    by_size = F.reverse(F.array_sort(F.array_distinct(F.transform(runs, lambda r: r["font_size"]))))
    return let(
        F.slice(by_size, 1, PDF_SIZES), lambda sizes: _font_headings(runs, sizes, level_mode)
    )


def _font_headings(runs: Column, sizes: Column, level_mode: str) -> Column:
    kept = F.filter(
        runs,
        lambda r: F.array_contains(sizes, r["font_size"]) & (F.length(r["text"]) <= PDF_MAX_TEXT),
    )
    largest_first = F.array_sort(
        F.transform(
            kept,
            lambda r: F.struct(
                (-r["font_size"]).alias("key"), r["position"], r["font_size"], r["page"], r["text"]
            ),
        )
    )

    def leveled(item, index):
        level = index + 1 if level_mode == "per_item" else F.array_position(sizes, item["font_size"])
        return F.struct(
            item["position"],
            level.cast("int").alias("level"),
            item["font_size"],
            item["page"],
            strip(item["text"]).alias("text"),
        )

    ordered = F.array_sort(F.transform(largest_first, leveled))
    flat = F.transform(
        ordered,
        lambda h: _heading(h["text"], h["level"], h["position"], h["page"], h["font_size"], F.lit("")),
    )
    if level_mode == "per_item":
        none = F.expr(f"cast(array() as {HEADINGS})")
        return let(
            flat, lambda h: F.when(F.size(h) <= PDF_SLOTS, slot_paths(h, PDF_SLOTS)).otherwise(none)
        )
    return slot_paths(flat, PDF_SLOTS)


def first_line_heading(text: Column) -> Column:
    """Stand-in when a document shows no headings: its first line, up to 50 characters."""
    line = F.substring(strip(F.get(F.split(strip(text), "\n"), F.lit(0))), 1, 50)
    one = _heading(line, F.lit(1), F.lit(0), F.lit(1), F.lit(12.0), line)
    none = F.expr(f"cast(array() as {HEADINGS})")
    return F.when(F.length(line) > 0, F.array(one)).otherwise(none)


def _with_path(heading, path) -> Column:
    return _heading(
        heading["text"],
        heading["level"],
        heading["position"],
        heading["page"],
        heading["font_size"],
        path,
    )


def stack_paths(headings: Column) -> Column:
    """A heading's path is the stack cut to its level, plus itself."""
    start = F.struct(
        F.expr("cast(array() as array<string>)").alias("stack"),
        F.expr(f"cast(array() as {HEADINGS})").alias("out"),
    )

    def step(acc, h):
        stack = F.concat(
            F.slice(acc["stack"], F.lit(1), F.least(F.size(acc["stack"]), h["level"] - 1)),
            F.array(h["text"]),
        )
        done = F.concat(acc["out"], F.array(_with_path(h, F.array_join(stack, SEPARATOR))))
        return F.struct(stack.alias("stack"), done.alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def slot_paths(headings: Column, slots: int) -> Column:
    """A heading fills the slot of its level and empties the deeper ones; empty slots are skipped."""
    start = F.struct(
        F.expr(f"array_repeat(cast(null as string), {slots})").alias("slots"),
        F.expr(f"cast(array() as {HEADINGS})").alias("out"),
    )

    def step(acc, h):
        # array indexes in a lambda start at 0, levels at 1
        now = F.transform(
            acc["slots"],
            lambda text, i: F.when(i < h["level"] - 1, text).when(i == h["level"] - 1, h["text"]),
        )
        done = F.concat(acc["out"], F.array(_with_path(h, F.array_join(now, SEPARATOR))))
        return F.struct(now.alias("slots"), done.alias("out"))

    return F.aggregate(headings, start, step, lambda acc: acc["out"])


def closest_heading(headings: Column, position: Column) -> Column:
    """Heading at the smallest distance before or after *position*; the earlier one wins a tie."""
    distances = F.transform(
        headings, lambda h, i: F.struct(F.abs(h["position"] - position).alias("d"), i.alias("i"))
    )
    # the smallest struct is the smallest distance, then the earliest heading
    return F.get(headings, F.array_min(distances)["i"])
