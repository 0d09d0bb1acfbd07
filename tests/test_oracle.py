"""Every registered query against its SQL twin; queries without one must give rows."""

from __future__ import annotations

import oracle
import pytest

from docquarry.plans import catalog

QUERIES, ORACLES = catalog.load()


@pytest.fixture(scope="module")
def db(folder):
    return oracle.connect(folder)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, folder, db, name):
    found = oracle.spark_rows(QUERIES[name](spark, folder))
    if name in ORACLES:
        assert found == oracle.sql_rows(db, ORACLES[name])
    else:
        assert found[1]
