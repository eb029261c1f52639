"""JSON lines in and out: an extension beyond the surveyed sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import Schema


def read_json(spark: SparkSession, path: str | list[str], schema: Schema) -> DataFrame:
    """A table of a schema; fields that don't parse are null. Nothing is inferred, so the files are read once."""
    return spark.read.schema(schema.struct()).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").json(path, mode="PERMISSIVE")


def write_json(df: DataFrame, path: str) -> None:
    """Nulls are written, so that every line has every field."""
    df.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").json(path, ignoreNullFields=False)
