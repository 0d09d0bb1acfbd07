"""Compare a query's rows with those of its SQL twin."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def canonical(columns, rows):
    """Columns by name, values as text, rows sorted."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]

    def text(value):
        if isinstance(value, float):
            return repr(value + 0.0)
        return repr(value)

    return names, sorted(tuple(text(row[i]) for i in order) for row in rows)


def spark_rows(df):
    return canonical(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(db, sql):
    result = db.execute(sql)
    columns = [d[0] for d in result.description]
    return canonical(columns, result.fetchall())
