"""Text of binary office files, one file per call."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from docquarry.errors import UnsupportedFormat


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _paragraphs(xml: bytes) -> Iterator[str]:
    """Text of each paragraph element; Word and PowerPoint both call it ``p`` and its text ``t``."""
    for node in ElementTree.fromstring(xml).iter():
        if _local(node.tag) == "p":
            parts = []
            for leaf in node.iter():
                kind = _local(leaf.tag)
                parts.append(
                    (leaf.text or "") if kind == "t" else {"tab": "\t", "br": "\n"}.get(kind, "")
                )
            yield "".join(parts)


def docx_text(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        return "\n\n".join(_paragraphs(archive.read("word/document.xml")))


def pptx_text(content: bytes) -> str:
    """Slides in order, paragraphs by blank lines."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        numbered = [
            (int(m.group(1)), name)
            for name in archive.namelist()
            if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", name))
        ]
        slides = [
            "\n\n".join(p for p in _paragraphs(archive.read(name)) if p)
            for _, name in sorted(numbered)
        ]
    return "\n\n".join(slides)


def xlsx_text(content: bytes) -> str:
    """Every sheet, one line per row, its non-empty cells joined by blanks."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        names = archive.namelist()
        shared: list[str] = []
        if "xl/sharedStrings.xml" in names:
            for item in ElementTree.fromstring(archive.read("xl/sharedStrings.xml")):
                shared.append("".join(t.text or "" for t in item.iter() if _local(t.tag) == "t"))
        numbered = [
            (int(m.group(1)), name)
            for name in names
            if (m := re.fullmatch(r"xl/worksheets/sheet(\d+)\.xml", name))
        ]
        lines = []
        for _, name in sorted(numbered):
            for row in ElementTree.fromstring(archive.read(name)).iter():
                if _local(row.tag) != "row":
                    continue
                cells = [_cell(cell, shared) for cell in row if _local(cell.tag) == "c"]
                lines.append(" ".join(cell for cell in cells if cell))
    return "\n".join(line for line in lines if line)


def _cell(cell: ElementTree.Element, shared: list[str]) -> str:
    inline = "".join(t.text or "" for t in cell.iter() if _local(t.tag) == "t")
    value = next((v.text or "" for v in cell if _local(v.tag) == "v"), "")
    if cell.get("t") == "s" and value:
        return shared[int(value)]
    return inline or value


def pdf_text(content: bytes) -> str:
    try:
        from pdfminer.high_level import extract_text
    except ImportError as error:
        raise UnsupportedFormat("pdfminer is not installed") from error
    return extract_text(io.BytesIO(content))


def csv_rows(content: bytes) -> Iterator[str]:
    """One text per record: a ``column: value`` line per field."""
    for record in csv.DictReader(io.StringIO(content.decode("utf-8"), newline="")):
        yield "\n".join(
            f"{(key or '').strip()}: {(value if isinstance(value, str) else '').strip()}"
            for key, value in record.items()
            if key is not None
        )
