"""CSV in and out.

Reading is positional: the schema says which physical column each column is. Fields are trimmed; empty or unparsable ones
are null, which is an error where the schema forbids null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rows import quoted
from ..schema import ColumnDef, Schema
from ..streaming.iterate import frames


@dataclass(frozen=True)
class CsvRead:
    separator: str = ","
    header: bool = True
    timestamp_format: str | None = None
    #: Also split fields over lines; the file is then read by one task.
    multi_line: bool = False
    #: A blank line is a row of nulls; files are then read as text, so quoted line ends are not possible.
    keep_blank_lines: bool = False


@dataclass(frozen=True)
class CsvWrite:
    separator: str = ","
    header: bool = True
    null_text: str = ""
    #: One file; the whole table goes through one task.
    single_file: bool = False


def parsed(field: Column, kind: T.DataType, options: CsvRead) -> Column:
    """A field's value, null where it is empty or doesn't parse."""
    text = F.nullif(F.trim(field), F.lit(""))
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.TimestampNTZType) and options.timestamp_format:
        return F.try_to_timestamp(text, F.lit(options.timestamp_format)).cast("timestamp_ntz")
    if isinstance(kind, T.BooleanType):
        return F.when(F.lower(text) == "true", True).when(F.lower(text) == "false", False)
    if isinstance(kind, T.IntegerType | T.LongType):
        return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))
    return text.try_cast(kind)


def width(schema: Schema) -> int:
    return max((c.source_index if c.source_index is not None else i) + 1 for i, c in enumerate(schema.columns))


def without_header(lines: DataFrame) -> DataFrame:
    """Lines without the first one of each file that equals the first line of all."""
    first = lines.limit(1).collect()
    if not first:
        return lines
    numbered = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    firsts = numbered.filter("block = 0").groupBy("file").agg(F.min(F.struct("line", "value")).alias("first"))
    heads = firsts.filter(F.col("first.value") == first[0][0]).select("first.line")
    return numbered.join(heads, "line", "left_anti").select("value")


def fields(spark: SparkSession, path: str | list[str], schema: Schema, options: CsvRead) -> DataFrame:
    """The physical columns as text, named _c0 and so on."""
    names = [f"_c{i}" for i in range(width(schema))]
    if options.keep_blank_lines:
        lines = spark.read.text(path)
        if options.header:
            lines = without_header(lines)
        struct = F.from_csv("value", ", ".join(f"{n} string" for n in names), {"sep": options.separator, "quote": '"', "escape": '"', "mode": "PERMISSIVE"})
        return lines.select(struct.alias("r")).select(*(F.col("r").getField(n).alias(n) for n in names))
    reader = spark.read.schema(", ".join(f"{n} string" for n in names))
    return reader.csv(path, sep=options.separator, header=options.header, quote='"', escape='"', mode="PERMISSIVE", multiLine=options.multi_line, enforceSchema=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def read_csv(spark: SparkSession, path: str | list[str], schema: Schema | type, options: CsvRead = CsvRead()) -> DataFrame:
    """A table of a schema, or of an annotated class's. Only the physical columns that a query needs are parsed."""
    schema = schema if isinstance(schema, Schema) else Schema.from_class(schema)
    raw = fields(spark, path, schema, options)
    out = []
    for i, c in enumerate(schema.columns):
        value = parsed(F.col(f"_c{c.source_index if c.source_index is not None else i}"), c.spark_type, options)
        if not c.nullable:
            value = F.coalesce(value, F.raise_error(F.lit(f"column {c.name!r} has an empty or invalid field and is not nullable")).cast(c.spark_type))
        out.append(value.alias(c.name))
    return raw.select(*out)


def read_csv_lenient(spark: SparkSession, path: str | list[str], schema: Schema, header: bool = True, separator: str = ",") -> DataFrame:
    """A forgiving reader: plain splitting without quotes, short and blank lines skipped, fields that don't parse become their type's default."""
    defaults = {T.IntegerType: F.lit(0), T.LongType: F.lit(0), T.DoubleType: F.lit(0.0), T.BooleanType: F.lit(False), T.StringType: F.lit(""), T.TimestampNTZType: F.lit("0001-01-01 00:00:00")}
    lines = spark.read.text(path)
    if header:
        lines = without_header(lines)
    parts = lines.select(F.split("value", "\\Q" + separator + "\\E", -1).alias("f"), "value").filter((F.trim("value") != "") & (F.size("f") >= width(schema)))
    out = []
    for i, c in enumerate(schema.columns):
        field = F.get("f", F.lit(c.source_index if c.source_index is not None else i))
        kind = c.spark_type
        value = field if isinstance(kind, T.StringType) else parsed(field, kind, CsvRead())
        out.append(F.coalesce(value, defaults[type(kind)].cast(kind)).alias(c.name))
    return parts.select(*out)


def infer_schema(spark: SparkSession, path: str, options: CsvRead = CsvRead(), sample_rows: int = 100) -> Schema:
    """From the first rows: int, double, timestamp, bool, string, in this order for each field. int and double make double, other mixtures string; a blank field makes the column nullable."""
    head = spark.read.csv(path, sep=options.separator, header=False, quote='"', escape='"', inferSchema=False).limit(1)
    first = head.collect()
    names = [(v or "").strip() if options.header else f"Column{i}" for i, v in enumerate(first[0])] if first else []
    raw = spark.read.schema(", ".join(f"_c{i} string" for i in range(len(names))) or "_c0 string").csv(path, sep=options.separator, header=options.header, quote='"', escape='"').limit(sample_rows)
    measures = []
    for i in range(len(names)):
        text = F.nullif(F.trim(F.col(f"_c{i}")), F.lit(""))
        kind = (
            F.when(text.rlike(r"^[+-]?[0-9]+$") & text.try_cast("int").isNotNull(), "int")
            .when(text.try_cast("double").isNotNull() & ~text.rlike("[dDfF]$"), "double")
            .when(text.try_cast("timestamp_ntz").isNotNull() & text.rlike("[-:/]"), "timestamp")
            .when(F.lower(text).isin("true", "false"), "bool")
            .when(text.isNotNull(), "string")
        )
        measures += [F.collect_set(kind).alias(f"k{i}"), F.bool_or(text.isNull()).alias(f"n{i}")]
    if not names:
        return Schema([])
    row = raw.agg(*measures).first()
    out = []
    for i, name in enumerate(names):
        kinds = set(row[f"k{i}"])
        kind = kinds.pop() if len(kinds) == 1 else "double" if kinds == {"int", "double"} else "string"
        out.append(ColumnDef(name, kind, bool(row[f"n{i}"]), i))
    return Schema(out)


def read_csv_batches(spark: SparkSession, path: str, schema: Schema, batch_size: int, options: CsvRead = CsvRead()) -> Iterator[DataFrame]:
    """The table as DataFrames of at most batch_size rows, a partition in memory at a time."""
    return frames(read_csv(spark, path, schema, options), batch_size)


def write_csv(df: DataFrame, path: str, options: CsvWrite = CsvWrite()) -> None:
    """Quotes where needed, quotes doubled; timestamps in ISO form with all digits, booleans True and False, null as a text of choice.

    A text with a line end is quoted over lines: only CsvRead(multi_line=True) reads it back, so where one is written the
    plain readers' rows are not the table's.
    """
    out = []
    for f in df.schema:
        c = quoted(f.name)
        if isinstance(f.dataType, T.BooleanType):
            c = F.initcap(c.cast("string"))
        elif isinstance(f.dataType, T.TimestampNTZType | T.TimestampType):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        out.append(c.alias(f.name))
    rows = df.select(*out)
    if options.single_file:
        rows = rows.coalesce(1)
    rows.write.mode("overwrite").csv(path, sep=options.separator, header=options.header, nullValue=options.null_text, emptyValue='""', quote='"', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
