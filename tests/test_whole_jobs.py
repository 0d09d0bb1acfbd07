"""Queries that must do their whole job: every row, not a summary of it."""

from __future__ import annotations

import oracle

from docquarry.plans import catalog

QUERIES, ORACLES = catalog.load()


def test_term_weights_gives_a_row_for_every_term(spark, folder):
    found = QUERIES["term_weights"](spark, folder)
    assert found.columns == ["term", "idf"]
    every = "SELECT DISTINCT unnest(regexp_extract_all(text, '\\S+')) AS term FROM documents"
    terms = {r[0] for r in oracle.connect(folder).execute(every).fetchall()}
    rows = found.collect()
    assert len(rows) == len(terms) and {r.term for r in rows} == terms
