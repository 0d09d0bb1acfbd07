"""Content types by extension, with a UTF-8 check for unknown ones."""

from __future__ import annotations

import mimetypes
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Supported content types and their file extensions.
SUPPORTED = {
    "text/plain": [".txt", ".log", ".json", ".yml", ".yaml", ".xml"],
    "text/markdown": [".md", ".markdown"],
    "text/csv": [".csv"],
    "text/html": [".html", ".htm"],
    "application/pdf": [".pdf"],
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": [".docx"],
    "application/msword": [".doc"],
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": [".pptx"],
    "application/vnd.ms-powerpoint": [".ppt"],
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": [".xlsx"],
    "application/vnd.ms-excel": [".xls"],
    "application/rtf": [".rtf"],
    "application/vnd.oasis.opendocument.text": [".odt"],
    "application/epub+zip": [".epub"],
}
DOCX = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
PPTX = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
XLSX = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

# Other registered extensions are known, and not supported; only unregistered ones are sniffed. The
# table is the one Python ships: a fresh instance does not read the files of a machine.
BY_EXTENSION = {
    **mimetypes.MimeTypes(filenames=()).types_map[True],
    **{ext: mime for mime, exts in SUPPORTED.items() for ext in exts},
}


def extension(path: Column) -> Column:
    """Lower-cased extension with its dot, empty when there is none."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]+)$", 1))


def by_extension(path: Column) -> Column:
    """Content type from the extension alone; null when unknown."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(BY_EXTENSION.items())])
    return F.try_element_at(table, extension(path))


def content_type(path: Column, content: Column) -> Column:
    """Content type by extension, else plain text when the bytes are valid UTF-8."""
    sniffed = F.when(F.is_valid_utf8(content.cast("string")), F.lit("text/plain")).otherwise(
        F.lit("application/octet-stream")
    )
    return F.coalesce(by_extension(path), sniffed)


def is_supported(mime: Column) -> Column:
    return mime.isin(list(SUPPORTED))
