from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

# Rows that every operator must stand: nulls, blanks, ties, repeated rows, one long text, new columns.
LONG = " ".join(f"wort{i % 977} und" for i in range(40_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards watch from a quiet hill and sing"
ODD = [
    (1, PASSAGE + " first", "en", "src1", 5),
    (2, PASSAGE + " first", "en", "src1", 5),
    (3, "", "en", None, 0),
    (4, None, None, "src2", None),
    (5, " \t\n", "de", "src2", 3),
    (6, LONG, "de", "src0", len(LONG)),
    (7, "Größe ÄÖÜ éàü 漢字 " + PASSAGE, "fr", "src9", 1),
    (7, "Größe ÄÖÜ éàü 漢字 " + PASSAGE, "fr", "src9", 1),
    (None, "no id at all, " + PASSAGE, "en", "src1", 1),
    (8, "one", "en", "src1", 3),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(ODD, COLUMNS)
    # names that operators use inside
    return rows.withColumns({n: F.lit("x") for n in ("k", "fp", "size", "tokens", "shard", "first", "m", "n", "cut")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
