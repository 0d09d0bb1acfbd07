"""Loader per content type: file contents to texts, failures to error rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.functions import mime as M
from docquarry.functions.text import html_text
from docquarry.operators.expand import expand_rows
from docquarry.sources import parsers

# Loader per content type; the missing ones have no parser.
LOADERS = {
    "text/plain": "text",
    "text/csv": "csv",
    "text/markdown": "markdown",
    "text/html": "html",
    "application/pdf": "pdf",
    M.DOCX: "docx",
    M.PPTX: "pptx",
    M.XLSX: "xlsx",
}
BINARY = {
    "pdf": parsers.pdf_text,
    "docx": parsers.docx_text,
    "pptx": parsers.pptx_text,
    "xlsx": parsers.xlsx_text,
}


def loader_name(mime: Column) -> Column:
    """Loader of a content type, ``unsupported`` without one."""
    chain = F.lit("unsupported")
    for kind, name in LOADERS.items():
        chain = F.when(mime == kind, F.lit(name)).otherwise(chain)
    return chain


def record_text(columns: list[str]) -> Column:
    """``column: value`` lines of a row of a structured table; null values stay empty."""
    return F.array_join(
        F.array(
            *[
                F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
                for c in columns
            ]
        ),
        "\n",
    )


def load_documents(files: DataFrame, join_records: bool = False) -> DataFrame:
    """Replace ``text`` by the loaded text and add ``part``, ``document_loader``, ``load_error``.

    A CSV file gives one row per record, numbered by ``part``, or with *join_records* one row with
    the records as paragraphs; every other file gives one row.
    HTML keeps its markup in ``raw`` for title and heading extraction.
    """
    routed = files.withColumn("document_loader", loader_name(F.col("content_type")))
    loader = F.col("document_loader")
    decoded = routed.where(loader.isin("text", "markdown", "html", "unsupported"))
    raw = F.col("content").cast("string")
    valid = F.is_valid_utf8(raw)
    error = F.when(loader == "unsupported", F.concat(F.lit("no parser for "), "content_type")).when(
        ~valid, F.lit("invalid UTF-8")
    )
    native = decoded.withColumns(
        {
            "raw": F.when(error.isNull(), raw),
            "load_error": error,
            "part": F.lit(0),
        }
    ).withColumn("text", F.when(loader == "html", html_text(F.col("raw"))).otherwise(F.col("raw")))

    def parse(content: bytes, name: str):
        try:
            texts = list(parsers.csv_rows(content)) if name == "csv" else [BINARY[name](content)]
            if join_records:
                texts = ["\n\n".join(texts)]
            for part, text in enumerate(texts):
                yield part, text, None
        except Exception as failure:
            yield 0, None, f"{type(failure).__name__}: {failure}"

    others = routed.where(loader.isin("csv", *BINARY)).drop("text")
    parsed = expand_rows(
        others, ["content", "document_loader"], "part int, text string, load_error string", parse
    ).withColumn("raw", F.col("text"))
    return native.unionByName(parsed.select(*native.columns))
