"""Metadata and a text view of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .rows import require


def column_names(df: DataFrame) -> list[str]:
    return list(df.columns)


def column_type(df: DataFrame, name: str) -> T.DataType:
    require(df, name)
    return df.schema[name].dataType


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def shape(df: DataFrame) -> tuple[int, int]:
    """Rows and columns."""
    return df.count(), len(df.columns)


def inspect(df: DataFrame, limit: int = 10) -> str:
    """A table of the first rows with names and types, and how many more there are."""
    rows = [["null" if v is None else str(v) for v in r] for r in df.limit(limit).collect()]
    heads = [df.columns, [f"<{f.dataType.simpleString()}>" for f in df.schema]]
    widths = [max(len(r[i]) for r in [*heads, *rows]) for i in range(len(df.columns))]
    lines = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in [*heads, *rows]]
    lines.insert(2, "-+-".join("-" * w for w in widths))
    more = df.count() - len(rows)
    return "\n".join([*lines, *([f"... ({more} more rows)"] if more else [])])


def release(df: DataFrame) -> DataFrame:
    """Gives back what a cached table holds."""
    return df.unpersist()
