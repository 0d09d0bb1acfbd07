"""Keep expensive expressions from being evaluated more than once per row.

An expression captured by a lambda is evaluated again for every element. Passing it through a
one-element array makes it a lambda variable, evaluated once per row.

A plain explode lets Spark infer a filter on the size of its list, which computes the list a second
time below the projection. The outer form infers none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with *value* evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unnest(df: DataFrame, values: Column, position: str = "pos", value: str = "col") -> DataFrame:
    """*df* with one row per element of *values*, its place from 0 and the element."""
    exploded = df.select("*", F.posexplode_outer(values).alias(position, value))
    return exploded.where(F.col(position).isNotNull())
