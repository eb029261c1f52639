"""What the operators of this package share: shared-folder tables, Arrow helpers and text rules."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Bytes of text that a Python worker handles at a time; a single longer text forms a chunk of its own.
CHUNK_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, a folder of our own if there is one machine only (tests), else an error."""
    conf = spark.sparkContext.getConf()
    folder = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not one_machine(conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = OWN_FOLDER.get(spark.sparkContext.applicationId) or f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        OWN_FOLDER[spark.sparkContext.applicationId] = folder
    return folder.rstrip("/")


#: The folders of local applications without spark.checkpoint.dir.
OWN_FOLDER: dict[str, str] = {}


def one_machine(master: str) -> bool:
    return master == "local" or master.startswith("local[")


#: For rows of megabytes: Parquet's writer looks at its buffers after each row, not after a hundred.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(8 << 20)}

#: Bytes that go to a Python worker at a time, and rows of a Parquet file read at a time. By Spark's defaults (64 MB, 4096 rows)
#: each task holds several times as much, in buffers that double as they grow and that its executor keeps.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(CHUNK_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512"}


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is executed inside moves its rows in batches of bounded size; the session's own settings come back after it."""
    before = {k: spark.conf.get(k, None) for k in BATCHES}
    try:
        for k, v in BATCHES.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, label: str, wide: bool = False) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: lineage ends there, and lost executors lose nothing.

    wide: the rows are large. The table goes with dropped(), else when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**(WIDE_ROWS if wide else {})).parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing will read again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        place = sc._jvm.org.apache.hadoop.fs.Path(df.written_to)
        place.getFileSystem(sc._jsc.hadoopConfiguration()).delete(place, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of doc_id as text, modulo modulus; a null doc_id gives -1, which is no remainder."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus, F.lit(-1))


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts batches with a column `text` into slices of about size bytes of text."""
    for batch in batches:
        text = batch.column("text")
        start, held = 0, 0
        lengths = pc.fill_null(pc.binary_length(text), 0).to_pylist()
        for i, n in enumerate(lengths):
            if held and held + n > size:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < batch.num_rows:
            yield batch.slice(start)
    trimmed()


def trimmed() -> None:
    """Gives a Python worker's unused memory back to the system; workers live through many tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it
        ctypes.CDLL(None).malloc_trim(0)


def texts(batch: pa.RecordBatch) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in batch.column("text").cast(pa.binary()).to_pylist()]


def record(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


Mapper = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]
