"""Aggregate expressions with fixed result types and defaults.

Sums and means are doubles, a sum of nothing is 0, counts are longs (or ints where these are asked for) and count rows. Minimum and maximum keep their
type and skip NaN. Nulls are skipped everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)


class Agg:
    """An aggregate to be: kind, column and result name."""

    def __init__(self, kind: str, column: str | Column | None = None, name: str | None = None):
        self.kind, self.column = kind, column
        self.name = name or (kind if column is None else f"{'avg' if kind == 'mean' else kind}_{column if isinstance(column, str) else 'expr'}")

    def alias(self, name: str) -> Agg:
        return Agg(self.kind, self.column, name)

    def of(self, df: DataFrame) -> Column:
        c = F.col(self.column) if isinstance(self.column, str) else self.column
        if self.kind == "count":
            return F.count(F.lit(1)).alias(self.name)
        if self.kind == "count_int":
            return F.count(F.lit(1)).cast("int").alias(self.name)
        if self.kind == "count_non_null":
            return F.count(c).cast("long").alias(self.name)
        # a named column's type is known; only an expression needs an analysis of its own
        kind = df.schema[self.column].dataType if isinstance(self.column, str) and self.column in df.columns else df.select(c.alias("c")).schema["c"].dataType
        if not isinstance(kind, NUMERIC):
            raise TypeError(f"{self.kind} of a column of type {kind.simpleString()}")
        if self.kind == "sum":
            out = F.coalesce(F.sum(c).cast("double"), F.lit(0.0))
        elif self.kind == "mean":
            out = F.avg(c)
        else:
            held = F.when(~F.isnan(c), c) if isinstance(kind, T.DoubleType | T.FloatType) else c
            out = F.min(held) if self.kind == "min" else F.max(held)
        return out.alias(self.name)


def sum_(column: str | Column) -> Agg:
    return Agg("sum", column)


def min_(column: str | Column) -> Agg:
    return Agg("min", column)


def max_(column: str | Column) -> Agg:
    return Agg("max", column)


def mean(column: str | Column) -> Agg:
    return Agg("mean", column)


def count(as_int: bool = False) -> Agg:
    """Rows, whatever their values; as_int: as an int, which raises from 2 ** 31 rows on."""
    return Agg("count_int", name="count") if as_int else Agg("count")


def count_non_null(column: str | Column) -> Agg:
    return Agg("count_non_null", column)
