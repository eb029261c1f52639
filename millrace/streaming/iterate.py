"""Results a part at a time, and incremental file streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rows(df: DataFrame) -> Iterator[Row]:
    """The rows, with one partition on the driver at a time and the next one under way."""
    return df.toLocalIterator(prefetchPartitions=True)


def arrow_batches(df: DataFrame, batch_size: int) -> Iterator[pa.RecordBatch]:
    """Record batches of exactly batch_size rows, the last one shorter. Rows come a partition at a time."""
    if batch_size <= 0:
        raise ValueError("batch_size must be positive")

    def drawn() -> Iterator[pa.RecordBatch]:
        names, held = df.columns, []
        kind = pa.schema([pa.field(f.name, ARROW[type(f.dataType)], f.nullable) for f in df.schema])
        for row in df.toLocalIterator():
            held.append(tuple(row))
            if len(held) == batch_size:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], schema=kind)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kind, strict=True)], names=names)

    return drawn()


#: Arrow types of the element types.
ARROW = {T.IntegerType: pa.int32(), T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.TimestampNTZType: pa.timestamp("us"), T.TimestampType: pa.timestamp("us", "UTC"), T.DateType: pa.date32()}


def frames(df: DataFrame, batch_size: int) -> Iterator[DataFrame]:
    """The table as DataFrames of batch_size rows, the last one shorter."""
    spark = df.sparkSession
    return (spark.createDataFrame(pa.Table.from_batches([b]), df.schema) for b in arrow_batches(df, batch_size))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", files_at_once: int = 1, **options: str) -> DataFrame:
    """A stream over files as they arrive."""
    return spark.readStream.format(kind).schema(schema).options(maxFilesPerTrigger=files_at_once, **options).load(path)


def run_to_end(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch of what is there now to handle, then ends; a restart goes on after the last one handled."""
    query = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by key and time window. On a stream, windows close once they are `late` behind the newest event; on a table all windows come out."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    return timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), key, "n")
