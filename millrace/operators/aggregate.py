"""Whole-table and grouped aggregates."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.agg import Agg, count, max_, mean, min_, sum_
from .rows import quoted, require


def scalar(df: DataFrame, agg: Agg, name: str = "value") -> DataFrame:
    """One row with one double; of nothing, 0."""
    return df.agg(F.coalesce(agg.alias(name).of(df).cast("double"), F.lit(0.0)).alias(name))


def total(df: DataFrame, column: str) -> float:
    return scalar(df, sum_(column)).first()[0]


def least(df: DataFrame, column: str) -> float:
    return scalar(df, min_(column)).first()[0]


def largest(df: DataFrame, column: str) -> float:
    return scalar(df, max_(column)).first()[0]


def average(df: DataFrame, column: str) -> float:
    return scalar(df, mean(column)).first()[0]


def boolean(df: DataFrame, column: str) -> Column:
    require(df, column)
    if not isinstance(df.schema[column].dataType, T.BooleanType):
        raise TypeError(f"column {column!r} isn't boolean")
    return quoted(column)


def any_true(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Whether a value is true; nulls don't count, nothing is false."""
    return df.agg(F.coalesce(F.bool_or(boolean(df, column)), F.lit(False)).alias(name))


def all_true(df: DataFrame, column: str, name: str = "value") -> DataFrame:
    """Whether all values are true; nulls don't count, nothing is true."""
    return df.agg(F.coalesce(F.bool_and(boolean(df, column)), F.lit(True)).alias(name))


class Grouped:
    """A table by keys; rows with a null key form groups of their own."""

    def __init__(self, df: DataFrame, keys: tuple[str | Column, ...]):
        if not keys:
            raise ValueError("no key to group by")
        require(df, *(k for k in keys if isinstance(k, str)))
        self.df, self.keys = df, [quoted(k) if isinstance(k, str) else k for k in keys]

    def aggregate(self, *aggs: Agg) -> DataFrame:
        return self.df.groupBy(*self.keys).agg(*(a.of(self.df) for a in aggs))

    def count(self, name: str = "Count", as_int: bool = False) -> DataFrame:
        return self.aggregate(count(as_int).alias(name))

    def sum(self, column: str, name: str | None = None) -> DataFrame:
        return self.aggregate(sum_(column).alias(name or f"Sum_{column}"))

    def min(self, column: str, name: str | None = None) -> DataFrame:
        return self.aggregate(min_(column).alias(name or f"Min_{column}"))

    def max(self, column: str, name: str | None = None) -> DataFrame:
        return self.aggregate(max_(column).alias(name or f"Max_{column}"))

    def mean(self, column: str, name: str | None = None) -> DataFrame:
        return self.aggregate(mean(column).alias(name or f"Mean_{column}"))

    def keys_frame(self) -> DataFrame:
        """The distinct keys."""
        return self.df.select(*self.keys).distinct()

    def group_count(self) -> int:
        return self.keys_frame().count()

    def row_ids(self, row_id: str) -> DataFrame:
        """Each group's row ids, ascending; for inspecting small groups."""
        return self.df.groupBy(*self.keys).agg(F.sort_array(F.collect_list(quoted(row_id))).alias("row_ids"))

    def count_stream(self) -> Iterator[Row]:
        """(key, Count) rows, a partition at a time."""
        return self.count().toLocalIterator(prefetchPartitions=True)


def group_by(df: DataFrame, *keys: str | Column) -> Grouped:
    return Grouped(df, keys)
