"""Projection, filters, computed columns and cleaning. Every function takes a DataFrame and returns one, so that df.transform() chains them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import compare


def require(df: DataFrame, *names: str) -> None:
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"no column {', '.join(map(repr, missing))}")


def quoted(name: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def select(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Columns by name, in the order given, or expressions."""
    require(df, *(c for c in columns if isinstance(c, str)))
    return df.select(*(quoted(c) if isinstance(c, str) else c for c in columns))


def where(df: DataFrame, condition: Column | Callable[[Row], bool], columns: Sequence[str] | None = None) -> DataFrame:
    """Rows that meet a condition. A Python function over rows works too, at the price of a UDF; columns: those that it reads."""
    if isinstance(condition, Column):
        return df.filter(condition)
    return df.filter(row_function(df, condition, T.BooleanType(), columns))


def where_value(df: DataFrame, name: str, op: str, value) -> DataFrame:
    """Rows whose column compares so with a value; nulls never match, NaN only !=."""
    require(df, name)
    kind = df.schema[name].dataType
    return df.filter(compare(quoted(name), op, value, isinstance(kind, T.DoubleType | T.FloatType)))


def row_function(df: DataFrame, function: Callable[[Row], object], kind: T.DataType, columns: Sequence[str] | None = None) -> Column:
    """A Python function over a row of the columns that it reads, batched through Arrow."""
    names = list(columns or df.columns)
    require(df, *names)
    return F.udf(function, kind, useArrow=True)(F.struct(*map(quoted, names)))


def add_column(df: DataFrame, name: str, value: Column | Callable[[Row], object], kind: T.DataType | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """df with one more column, from an expression, or from a Python function and its result type."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    if not isinstance(value, Column):
        if kind is None:
            raise TypeError("a function needs its result type")
        value = row_function(df, value, kind, columns)
    return df.withColumn(name, value)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    require(df, old)
    if new != old and new in df.columns:
        raise ValueError(f"column {new!r} exists")
    return df.withColumnRenamed(old, new)


def drop_nulls(df: DataFrame) -> DataFrame:
    """Rows without a null; NaN is a value and stays."""
    condition = F.lit(True)
    for c in df.columns:
        condition = condition & quoted(c).isNotNull()
    return df.filter(condition)


def fill_null(df: DataFrame, name: str, value) -> DataFrame:
    """Nulls of one column replaced; NaN stays. The value must be of the column's type."""
    require(df, name)
    kind = df.schema[name].dataType
    fits = {T.IntegerType: int, T.LongType: int, T.DoubleType: float, T.StringType: str, T.BooleanType: bool}.get(type(kind))
    if value is None or fits and (type(value) is not fits):
        raise TypeError(f"{value!r} doesn't fit column {name!r} of type {kind.simpleString()}")
    return df.withColumn(name, F.coalesce(quoted(name), F.lit(value).cast(kind)))
