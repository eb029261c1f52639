"""Parquet, Arrow and Python objects in and out."""

from __future__ import annotations

import dataclasses
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..schema import Schema
from ..streaming.iterate import frames


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_parquet_batches(spark: SparkSession, path: str, batch_size: int) -> Iterator[DataFrame]:
    """The table as DataFrames of at most batch_size rows; Spark parts files by size, not by row group."""
    return frames(read_parquet(spark, path), batch_size)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def from_arrow(spark: SparkSession, data: pa.Table | pa.RecordBatch) -> DataFrame:
    """A table of a driver-side Arrow table; dates widen to timestamps."""
    data = pa.Table.from_batches([data]) if isinstance(data, pa.RecordBatch) else data
    for i, f in enumerate(data.schema):
        if pa.types.is_date(f.type) or pa.types.is_timestamp(f.type):
            kind = pa.timestamp("us")
            data = data.set_column(i, pa.field(f.name, kind, f.nullable), data.column(i).cast(kind, safe=False))
    return spark.createDataFrame(data)


def to_arrow(df: DataFrame) -> pa.Table:
    """All rows on the driver: for results that fit there."""
    return df.toArrow()


def empty(spark: SparkSession, schema: Schema | T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema.struct() if isinstance(schema, Schema) else schema)


def values(item: object, schema: Schema) -> tuple:
    return tuple(item[c.name] if isinstance(item, dict) else getattr(item, c.name) for c in schema.columns)


def from_objects(spark: SparkSession, items: Iterable[object], schema: Schema | type | None = None) -> DataFrame:
    """A row for each object; the schema comes from the class of the first one if not given."""
    items = list(items)
    if schema is None:
        if not items:
            raise ValueError("no object to take a schema from")
        schema = type(items[0])
    schema = schema if isinstance(schema, Schema) else Schema.from_class(schema)
    return spark.createDataFrame([values(i, schema) for i in items], schema.struct())


def object_batches(spark: SparkSession, items: Iterable[object], batch_size: int, schema: Schema | type | None = None) -> Iterator[DataFrame]:
    """DataFrames of batch_size objects, the last one shorter; nothing for no object. Objects are drawn as batches are."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def drawn() -> Iterator[DataFrame]:
        rest, own = iter(items), schema
        while part := list(itertools.islice(rest, batch_size)):
            if own is None:
                own = type(part[0])
            own = own if isinstance(own, Schema) else Schema.from_class(own)
            yield from_objects(spark, part, own)

    return drawn()


def to_objects(df: DataFrame, kind: type) -> Iterator[object]:
    """A dataclass instance for each row, a partition at a time."""
    names = [f.name for f in dataclasses.fields(kind)]
    for row in df.select(*names).toLocalIterator():
        yield kind(**row.asDict())
