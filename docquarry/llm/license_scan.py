"""License scan: ordered signature rules behind a keyword filter, overlapping detections resolved.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z. The rules of
``license_rules`` are expressions over those words. A text is searched by the rules whose keywords it has all
of; every match is a detection with the words it covers. A detection is suppressed if another one covers all its
words and has a higher priority, or the same priority and more words, or the same words and an earlier rule.
What is left names the licenses; ``score`` is a tenth of the highest priority left, 0 without any.

*Phrases* are looked for beside the rules: all places where their words stand consecutively. Their labels are
never suppressed.

Whole texts are searched. A null, empty or blank text has no words, places or detections. Rows are taken one by
one: equal rows give equal rows, a null id is kept. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import utf8_rows
from docquarry.llm.license_rules import Rule, read_rules

# The phrases every scan looks for, and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]")
_CLEAN = bytes(b if _WORD_BYTES.match(bytes([b])) else 32 for b in range(256)).lower()

Detection = tuple[int, int, int, int]


def words_of(text: bytes) -> list[bytes]:
    """The words of a UTF-8 text."""
    return text.translate(_CLEAN).split()


def over_words(expression: str) -> str:
    """An expression for texts whose words have a blank on each side."""
    return " (?:" + expression.replace(" ", "  ") + ") "


def surviving(found: list[Detection]) -> list[Detection]:
    """The detections ``(start, end, priority, rule)`` that none suppresses, by start."""
    kept, reach = [], {}
    for d in sorted(found, key=lambda d: (d[0], -d[1], -d[2], d[3])):
        _, end, priority, _ = d
        # what came before starts no later, so it covers this one if it ends no earlier
        if all(p < priority or e < end for p, e in reach.items()):
            kept.append(d)
        reach[priority] = max(reach.get(priority, 0), end)
    return kept


class Scanner:
    """Rules compiled once per task, each behind the longest of its keywords."""

    def __init__(self, rules: list[Rule], phrases: Mapping[str, str]) -> None:
        self.rules = rules
        self.phrases = [(f" {p.replace(' ', '  ')} ".encode(), set(p.encode().split()), v) for p, v in phrases.items()]
        self.behind: dict[bytes, list[tuple[Rule, frozenset[bytes], re.Pattern]]] = {}
        self.keys: set[bytes] = set().union(*(words for _, words, _ in self.phrases))
        for rule in rules:
            keywords = [k.encode() for k in rule.keywords]
            self.keys.update(keywords)
            gate = max(keywords, key=len)
            entry = (rule, frozenset(keywords), re.compile(over_words(rule.expression).encode()))
            self.behind.setdefault(gate, []).append(entry)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[Detection]]:
        """Places of the phrases and surviving detections, by start."""
        has = self.keys.intersection(words)
        tried = [
            (rule, expression)
            for gate in has
            for rule, keywords, expression in self.behind.get(gate, ())
            if keywords <= has
        ]
        phrases = [(p, label) for p, needs, label in self.phrases if needs <= has]
        if not tried and not phrases:
            return [], []
        text = b" " + b"  ".join(words) + b" "
        starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)))
        matches = [(m.start(), m.end(), r.priority, r.number) for r, e in tried for m in e.finditer(text)]
        places = []
        for phrase, label in phrases:
            at = text.find(phrase)
            while at >= 0:
                places.append((at, label))
                at = text.find(phrase, at + 1)
        word = np.searchsorted(starts, [m[:2] for m in matches] or np.zeros((0, 2), np.int64)).tolist()
        found = [(a, b, p, r) for (a, b), (_, _, p, r) in zip(word, matches, strict=True)]
        at = np.searchsorted(starts, [a for a, _ in places]).tolist()
        return sorted((i, label) for i, (_, label) in zip(at, places, strict=True)), surviving(found)


def scan_licenses(
    docs: DataFrame,
    id_column: str = "doc_id",
    text: str = "text",
    rules: list[Rule] | None = None,
    phrases: Mapping[str, str] = PHRASES,
) -> DataFrame:
    """``(id, n_words, places, detections)``: labelled starts of phrases, and what the rules found.

    A detection is ``(start, end, label, priority, rule)`` in words, the end excluded.
    """
    rules = read_rules() if rules is None else rules
    place = pa.struct([("start", pa.int64()), ("label", pa.string())])
    detection = pa.struct(
        [("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("priority", pa.int32()), ("rule", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules, phrases)
        label = {r.number: r.label for r in rules}
        for batch in batches:
            counts, places, detections = [], [], []
            for value in utf8_rows(batch.column(1)):
                words = words_of(value)
                at, found = scanner.scan(words)
                counts.append(len(words))
                places.append([{"start": a, "label": v} for a, v in at])
                detections.append(
                    [{"start": a, "end": b, "label": label[r], "priority": p, "rule": r} for a, b, p, r in found]
                )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(counts, pa.int64()),
                    pa.array(places, pa.list_(place)),
                    pa.array(detections, pa.list_(detection)),
                ],
                names=["id", "n_words", "places", "detections"],
            )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text).mapInArrow(
        run,
        f"`{id_column}` {kind}, n_words long, places array<struct<start: long, label: string>>, "
        "detections array<struct<start: long, end: long, label: string, priority: int, rule: int>>",
    )


def score() -> Column:
    """How sure the surest detection is, from 0 to 1."""
    return F.coalesce(F.array_max("detections.priority"), F.lit(0)) / F.lit(10.0)
