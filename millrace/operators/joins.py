"""Equi-joins on one column. Spark picks broadcast by size, and splits skewed keys at run time."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .rows import require

KINDS = ("inner", "left")


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Columns of left, then those of right without the key. Null keys never match; other shared names are an error."""
    if how not in KINDS:
        raise ValueError(f"join kind {how!r} is none of {KINDS}")
    require(left, on)
    require(right, on)
    if type(left.schema[on].dataType) is not type(right.schema[on].dataType):
        raise TypeError(f"key {on!r} has types {left.schema[on].dataType.simpleString()} and {right.schema[on].dataType.simpleString()}")
    if both := (set(left.columns) & set(right.columns)) - {on}:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    return left.join(right, on, how).select(*left.columns, *(c for c in right.columns if c != on))
