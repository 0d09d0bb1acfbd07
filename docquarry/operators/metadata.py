"""Titles and headings per content type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import headings as H
from docquarry.functions import text as X
from docquarry.schema import HEADINGS


def title_of(text: Column, mime: Column, given: Column | None = None) -> Column:
    """*given* if present, else the title rule of the content type."""
    found = (
        F.when(mime == "text/markdown", X.markdown_title(text))
        .when(mime == "text/html", X.html_title(text))
        .otherwise(X.first_short_line(text))
    )
    return found if given is None else F.coalesce(given, found)


def headings_of(text: Column, mime: Column, runs: Column | None = None) -> Column:
    """Heading hierarchy of the content type; PDF headings come from font *runs*."""
    none = F.lit(None).cast(HEADINGS)
    from_runs = H.font_headings(runs) if runs is not None else none
    pdf = F.when(F.size(from_runs) > 0, from_runs).otherwise(H.first_line_heading(text))
    found = (
        F.when(mime == "text/markdown", H.markdown_headings(text))
        .when(mime == "text/html", H.html_headings(text))
        .when(mime == "application/pdf", pdf)
        .otherwise(none)
    )
    return F.when(F.size(found) > 0, found)


def extract_metadata(
    docs: DataFrame, text: str = "text", mime: str = "content_type", runs: str | None = None
) -> DataFrame:
    """Add ``title`` (unless given), ``heading_hierarchy`` and, for PDF, ``page_num``."""
    given = F.col("title") if "title" in docs.columns else None
    return docs.withColumns(
        {
            "title": title_of(F.col(text), F.col(mime), given),
            "heading_hierarchy": headings_of(
                F.col(text), F.col(mime), F.col(runs) if runs else None
            ),
            "page_num": F.when(F.col(mime) == "application/pdf", F.lit(1)),
        }
    )
