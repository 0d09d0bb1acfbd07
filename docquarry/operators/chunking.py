"""Documents to chunks.

Every splitter keeps the columns of its input and adds ``chunk_index``, ``chunk_total``,
``content``, ``chunk_start_char`` and ``chunk_end_char``. All work is row-local: no shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.config import ChunkSettings
from docquarry.functions import headings as H
from docquarry.functions import mime as M
from docquarry.functions.binding import let, unnest
from docquarry.functions.text import spaced_tokens, token_length
from docquarry.operators import splitting
from docquarry.operators.expand import expand_rows

# Splitter per content type.
SPLITTERS = {
    "text/markdown": "markdown_header_splitter",
    "text/html": "html_splitter",
    "application/pdf": "pdf_splitter",
    "text/plain": "token_splitter",
    "text/csv": "token_splitter",
    "application/json": "token_splitter",
    M.DOCX: "document_splitter",
    "application/msword": "document_splitter",
}
DEFAULT_SPLITTER = "semantic_splitter"
SEPARATORS = {
    "html_splitter": splitting.HTML,
    "pdf_splitter": splitting.PAGES,
    "document_splitter": splitting.PAGES,
    "semantic_splitter": splitting.SEMANTIC,
}
# Metadata that the first chunk hands on to the others.
INHERITED = (
    "title",
    "headings",
    "heading_hierarchy",
    "section_headings",
    "page_num",
    "source",
    "source_type",
)

POSITIONS = "chunk_index int, chunk_total int, content string, chunk_start_char int, chunk_end_char int"


def char_windows(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """Windows of *size* characters every ``size - overlap``, as long as they start in the text."""
    stride = size - overlap
    starts = F.when(
        F.length(text) > 0, F.sequence(F.lit(0), F.length(text) - 1, F.lit(stride))
    ).otherwise(F.expr("cast(array() as array<int>)"))
    return (
        df.withColumn("__starts", starts)
        .select("*", F.size("__starts").alias("chunk_total"), F.posexplode("__starts"))
        .withColumn("content", F.substring(F.col(text), F.col("col") + 1, F.lit(size)))
        .select(
            *df.columns,
            F.col("pos").alias("chunk_index"),
            "chunk_total",
            "content",
            F.col("col").alias("chunk_start_char"),
            (F.col("col") + F.length("content")).alias("chunk_end_char"),
        )
    )


# Characters per token of the models whose windows are arithmetic.
CHARACTERS = {"chars": 1, "chars4": 4}


def token_windows(
    df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200, model: str = "words"
) -> DataFrame:
    """Windows of *size* tokens every ``size - overlap`` until one reaches the end."""
    if model in CHARACTERS:
        unit = CHARACTERS[model]
        last = F.greatest(F.lit(0), F.length(text) - overlap * unit - 1)
        starts = F.when(F.length(text) > 0, F.sequence(F.lit(0), last, F.lit((size - overlap) * unit)))
        placed = unnest(df.withColumn("__starts", starts), F.col("__starts"))
        windows = placed.select(
            *df.columns,
            F.col("pos").alias("chunk_index"),
            F.size("__starts").alias("chunk_total"),
            F.substring(F.col(text), F.col("col") + 1, F.lit(size * unit)).alias("content"),
        )
        return first_positions(windows, text)

    def windows_of(tokens: Column) -> Column:
        last = F.greatest(F.lit(0), F.size(tokens) - overlap - 1)
        starts = F.sequence(F.lit(0), last, F.lit(size - overlap))
        texts = F.transform(starts, lambda s: F.array_join(F.slice(tokens, s + 1, F.lit(size)), ""))
        return F.when(F.size(tokens) > 0, texts)

    # the token list stays inside one expression: exploded rows carry window texts only
    listed = df.withColumn("__windows", let(spaced_tokens(F.col(text)), windows_of))
    windows = unnest(listed, F.col("__windows")).select(
        *df.columns,
        F.col("pos").alias("chunk_index"),
        F.size("__windows").alias("chunk_total"),
        F.col("col").alias("content"),
    )
    return first_positions(windows, text)


def first_positions(chunks: DataFrame, text: str = "text", content: str = "content") -> DataFrame:
    """Offsets of the first occurrence of each chunk in its text; null when it does not occur."""
    at = F.instr(F.col(text), F.col(content))
    found = F.when((F.length(content) > 0) & (at > 0), at - 1)
    return chunks.withColumns(
        {
            "chunk_start_char": found.cast("int"),
            "chunk_end_char": (found + F.length(content)).cast("int"),
        }
    )


def window_positions(df: DataFrame, text: str = "text", size: int = 500, overlap: int = 50) -> DataFrame:
    """The windows of :func:`char_windows` without their text, with the offsets of their first occurrence.

    As :func:`first_positions` of them, in one pass per text instead of one search per window.
    """

    def place(body: str | None):
        places = splitting.first_window_positions(body or "", size, size - overlap)
        for i, at in enumerate(places):
            yield i, len(places), at, at + min(size, len(body) - i * (size - overlap))

    fields = "chunk_index int, chunk_total int, chunk_start_char int, chunk_end_char int"
    return expand_rows(df, [text], fields, place, drop=(text,))


def recursive_chunks(
    df: DataFrame,
    text: str = "text",
    size: int = 1000,
    overlap: int = 200,
    separators: list[str] | None = None,
    length: str = "words",
) -> DataFrame:
    """Chunks cut at the strongest separators; *length* names the token model."""
    order = list(separators or splitting.SEMANTIC)
    measure = splitting.LENGTHS[length]

    def cut(body: str | None):
        parts = list(splitting.split_recursively(body, order, size, overlap, measure)) if body else []
        for i, part in enumerate(parts):
            start = body.find(part)
            found = (start, start + len(part)) if start >= 0 else (None, None)
            yield i, len(parts), part, *found

    return expand_rows(df, [text], POSITIONS, cut)


def markdown_chunks(
    df: DataFrame, text: str = "text", size: int = 1000, overlap: int = 200, length: str = "words"
) -> DataFrame:
    """Sections by header, each cut further when too long; adds ``headers array<string>``."""
    named = df.withColumn("__splitter", F.lit("markdown_header_splitter"))
    return separator_chunks(named, "__splitter", text, size, overlap, length).drop("__splitter")


def separator_chunks(
    df: DataFrame,
    splitter: str,
    text: str = "text",
    size: int = 1000,
    overlap: int = 200,
    length: str = "words",
) -> DataFrame:
    """Chunks by the separators, or Markdown headers, that the column *splitter* names per row.

    Adds ``headers array<string>``, null except for Markdown.
    """
    measure = splitting.LENGTHS[length]

    def sections(body: str, name: str):
        if name == "markdown_header_splitter":
            return splitting.markdown_sections(body)
        return [(None, body)]

    def cut(body: str | None, name: str):
        order = SEPARATORS.get(name, splitting.SEMANTIC)
        parts = [
            (part, headers)
            for headers, section in sections(body or "", name)
            for part in splitting.split_recursively(section, order, size, overlap, measure)
        ]
        for i, (part, headers) in enumerate(parts):
            start = body.find(part)
            found = (start, start + len(part)) if start >= 0 else (None, None)
            yield i, len(parts), part, *found, headers

    return expand_rows(df, [text, splitter], POSITIONS + ", headers array<string>", cut)


def header_context(chunks: DataFrame, headers: str = "headers") -> DataFrame:
    """``closest_heading`` is the deepest header, ``heading_path`` the headers joined by ' > '."""
    held = F.filter(headers, lambda h: F.length(h) > 0)
    reachable = F.get(headers, F.lit(0)).isNotNull() | F.get(headers, F.lit(1)).isNotNull()
    deepest = F.when(reachable & (F.size(held) > 0), F.element_at(held, -1))
    path = F.when(deepest.isNotNull(), F.array_join(held, H.SEPARATOR))
    return chunks.withColumns({"closest_heading": deepest, "heading_path": path})


def heading_context(chunks: DataFrame, headings: str = "heading_hierarchy") -> DataFrame:
    """Nearest heading by absolute distance to the chunk start; one-chunk documents get none."""
    nearest = F.when(
        (F.col("chunk_total") > 1) & F.col("chunk_start_char").isNotNull(),
        H.closest_heading(F.col(headings), F.col("chunk_start_char")),
    )
    return chunks.withColumn("__nearest", nearest).select(
        *[c for c in chunks.columns if c not in ("closest_heading", "heading_path")],
        F.col("__nearest.text").alias("closest_heading"),
        F.coalesce("__nearest.path", "__nearest.text").alias("heading_path"),
    )


def inherit(metadata: Column, first: Column, chunk_total: Column) -> Column:
    """Fill the inheritable keys of *metadata* from those of the *first* chunk's map."""
    handed = F.map_filter(
        first, lambda k, v: k.isin(list(INHERITED)) & ~F.map_contains_key(metadata, k)
    )
    return F.when(chunk_total > 1, F.map_concat(metadata, handed)).otherwise(metadata)


def splitter_name(mime: Column, semantic: bool = True) -> Column:
    """Splitter for a content type; without semantic chunking all but Markdown use tokens."""
    if not semantic:
        return F.when(mime == "text/markdown", SPLITTERS["text/markdown"]).otherwise(
            "token_splitter"
        )
    chain = F.lit(None).cast("string")
    for kind, name in SPLITTERS.items():
        chain = F.when(mime == kind, F.lit(name)).otherwise(chain)
    return F.coalesce(chain, F.lit(DEFAULT_SPLITTER))


def split_documents(
    docs: DataFrame,
    settings: ChunkSettings | None = None,
    text: str = "text",
    mime: str = "content_type",
) -> DataFrame:
    """Route every document to the splitter of its content type.

    Adds ``text_splitter``, positions, ``closest_heading`` and ``heading_path``. *docs* may carry
    ``heading_hierarchy``; it is used for the types that have one.
    """
    settings = settings or ChunkSettings()
    size, overlap, model = settings.size, settings.overlap, settings.token_model
    routed = docs.withColumn("text_splitter", splitter_name(F.col(mime), settings.semantic))
    has_headings = "heading_hierarchy" in docs.columns
    if not has_headings:
        from docquarry.schema import HEADINGS

        routed = routed.withColumn("heading_hierarchy", F.lit(None).cast(HEADINGS))
    tokens = F.col("text_splitter") == "token_splitter"
    out = token_windows(routed.where(tokens), text, size, overlap, model).withColumn(
        "headers", F.lit(None).cast("array<string>")
    )
    out = out.unionByName(
        separator_chunks(routed.where(~tokens), "text_splitter", text, size, overlap, model)
    )
    if settings.preserve_headings:
        by_position = heading_context(out)
        by_header = header_context(
            by_position.withColumnsRenamed(
                {"closest_heading": "__heading", "heading_path": "__path"}
            )
        )
        several = F.col("chunk_total") > 1
        out = by_header.withColumns(
            {
                "closest_heading": F.coalesce(
                    "__heading", F.when(several, F.col("closest_heading"))
                ),
                "heading_path": F.coalesce("__path", F.when(several, F.col("heading_path"))),
            }
        ).drop("__heading", "__path")
    return out if has_headings else out.drop("heading_hierarchy")


def enrich(
    chunks: DataFrame,
    now: float,
    token_model: str = "words",
    mime: str = "content_type",
    content: str = "content",
) -> DataFrame:
    """Processing columns: when, what type, which tokenizer, how many tokens (0 if unknown)."""
    return chunks.withColumns(
        {
            "processed_at": F.lit(float(now)),
            "mime_type": F.col(mime),
            "tokenizer": F.lit(token_model),
            "token_count": F.coalesce(token_length(F.col(content), token_model), F.lit(0)),
        }
    )


def metadata_map(columns: Mapping[str, Column]) -> Column:
    """``map<string,string>`` of the non-null values."""
    entries = F.array(
        *[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()]
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
