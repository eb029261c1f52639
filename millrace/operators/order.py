"""Sorting, top-n, slices and first rows. What depends on row order takes a row id, or a unique column that serves as one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import quoted, require


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds an ascending id in the order in which the source is read, without gaps known or needed. Assign it at load, once."""
    if name in df.columns:
        raise ValueError(f"column {name!r} exists")
    return df.withColumn(name, F.monotonically_increasing_id())


def sort_keys(df: DataFrame, names: Sequence[str], ascending: Sequence[bool]) -> list[Column]:
    """Nulls come first ascending and last descending; NaN is below every number."""
    require(df, *names)
    out = []
    for name, up in zip(names, ascending, strict=True):
        c = quoted(name)
        if isinstance(df.schema[name].dataType, T.DoubleType | T.FloatType):
            # false < true: numbers after NaN, both after null
            number = F.when(c.isNotNull(), ~F.isnan(c))
            out.append(number.asc_nulls_first() if up else number.desc_nulls_last())
        out.append(c.asc_nulls_first() if up else c.desc_nulls_last())
    return out


def order_by(df: DataFrame, *names: str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """Sorted by columns, each with a direction."""
    up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if not names or len(up) != len(names):
        raise ValueError("a direction for each of one or more columns is needed")
    return df.orderBy(*sort_keys(df, names, up))


def sorted_ids(df: DataFrame, row_id: str, *names: str, ascending: bool | Sequence[bool] = True) -> DataFrame:
    """The row ids in sorted order."""
    return order_by(df, *names, row_id, ascending=([ascending] * len(names) if isinstance(ascending, bool) else list(ascending)) + [True]).select(row_id)


def with_place(df: DataFrame, *names: str, ascending: bool | Sequence[bool] = True, place: str = "place") -> DataFrame:
    """Adds each row's place in an order, from 1, as a long; names: columns that tell all rows apart.

    Rows are ranged by the order, numbered within each partition, and moved by the sizes of the partitions before. The
    ranged rows are kept on disk, so that both uses see the same ranges.
    """
    up = [ascending] * len(names) if isinstance(ascending, bool) else list(ascending)
    if not names or len(up) != len(names):
        raise ValueError("a direction for each of one or more columns is needed")
    if place in df.columns:
        raise ValueError(f"column {place!r} exists")
    keys = sort_keys(df, names, up)
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(count, *keys).withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*keys))
    return ranged.withColumn("__rank", rank).join(F.broadcast(before), "__part").select(*map(quoted, df.columns), (F.col("__before") + F.col("__rank")).cast("long").alias(place))


def smallest(df: DataFrame, n: int, name: str, *ties: str) -> DataFrame:
    """The n rows of the smallest values, sorted; rows without a value don't take part. ties: columns that decide among equals."""
    return top(df, n, name, ties, True)


def largest_rows(df: DataFrame, n: int, name: str, *ties: str) -> DataFrame:
    """The n rows of the largest values, sorted."""
    return top(df, n, name, ties, False)


def top(df: DataFrame, n: int, name: str, ties: Sequence[str], ascending: bool) -> DataFrame:
    require(df, name, *ties)
    if n <= 0:
        return df.limit(0)
    return order_by(df.filter(quoted(name).isNotNull()), name, *ties, ascending=[ascending] + [True] * len(ties)).limit(n)


def head(df: DataFrame, n: int, row_id: str) -> DataFrame:
    """The first n rows: a sort that keeps n rows of each partition."""
    return df.orderBy(quoted(row_id).asc()).limit(max(n, 0))


def tail(df: DataFrame, n: int, row_id: str) -> DataFrame:
    """The last n rows, in order."""
    return df.orderBy(quoted(row_id).desc()).limit(max(n, 0)).orderBy(quoted(row_id).asc())


def slice_rows(df: DataFrame, start: int, length: int, row_id: str) -> DataFrame:
    """Rows start .. start + length - 1; beyond the end there are none."""
    if start < 0:
        raise ValueError("start is negative")
    return df.orderBy(quoted(row_id).asc()).offset(start).limit(max(length, 0))


def distinct(df: DataFrame, *names: str, row_id: str | None = None) -> DataFrame:
    """Distinct rows; with names, the first row by row_id of each key, with all its columns."""
    if not names:
        return df.distinct()
    require(df, *names)
    if row_id is None:
        raise ValueError("which row comes first needs a row id")
    others = [c for c in df.columns if c not in names]
    if not others:
        return df.distinct()
    # a partial aggregate before the shuffle leaves a row for each key and task, where a window would move them all
    first = F.min_by(F.struct(*map(quoted, others)), quoted(row_id)).alias("__first")
    return df.groupBy(*map(quoted, names)).agg(first).select(*(quoted(c) if c in names else F.col("__first").getField(c).alias(c) for c in df.columns))


def category_codes(df: DataFrame, name: str, row_id: str, code: str = "code") -> DataFrame:
    """Adds integer codes in the order in which values first occur, from 1; null has code 0."""
    require(df, name, row_id)
    return df.join(categories(df, name, row_id, code), name, "left").withColumn(code, F.coalesce(code, F.lit(0))).select(*df.columns, code)


def categories(df: DataFrame, name: str, row_id: str, code: str = "code") -> DataFrame:
    """The dictionary: each distinct value with its code.

    Numbering by a window over all values would take them to one task; instead values are ranged by their first row,
    numbered within each partition, and moved by the sizes of the partitions before.
    """
    firsts = df.filter(quoted(name).isNotNull()).groupBy(quoted(name)).agg(F.min(quoted(row_id)).alias("__first"))
    # kept on disk, so that both uses see the same ranges
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = firsts.repartitionByRange(count, "__first").withColumn("__part", F.spark_partition_id()).persist(StorageLevel.DISK_ONLY)
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    before = sizes.select("__part", (F.sum("__n").over(Window.orderBy("__part")) - F.col("__n")).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("__part").orderBy("__first"))
    return placed.withColumn("__rank", rank).join(F.broadcast(before), "__part").select(name, (F.col("__before") + F.col("__rank")).cast("int").alias(code))
