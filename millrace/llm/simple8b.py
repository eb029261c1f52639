"""Token ids as Simple-8b files: 64-bit words whose top four bits select how many ids the other 60 bits hold.

Format of a stream (little endian). Header: magic "S8B1", block size B (uint32), ids (uint64), escapes (uint64),
words (uint64). Then for each block of B ids the index of its first word (uint32), so that blocks decode independently;
the words (uint64); the escaped ids as pairs of position (uint64) and value (uint64). A word's selector s (bits 60-63)
stands for COUNTS[s] ids of BITS[s] bits, the first in the lowest bits; the last word of a block may hold fewer ids
than its selector could, the rest is zero. An id of 2**60 or more is stored as 0 and listed among the escapes.

A shard is a row of a Parquet table: its first document's place in the whole order, a directory of doc_ids and token
counts, and the stream. Parquet carries the rows because Spark's writer commits them atomically from any executor to
any store; the stream in a row is the file format. Shards are written in ascending doc_id order.

Defined results. Null text is empty text: one token, the end id. Repeated rows are separate documents next to each
other; a null doc_id sorts first. Empty table: no shard, empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, record, written
from .tokens import loaded

#: Fixed values of the coding: ids in a word, and bits for each.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
#: The narrowest selector of each id below 2 ** 16.
LEVEL16 = np.searchsorted([1 << b for b in BITS], np.arange(1 << 16), side="right").astype(np.uint8)
MAGIC = b"S8B1"
BLOCK = 256
END_ID = 2
#: Bytes of text whose ids form a shard; a longer text forms one of its own.
SHARD_BYTES = 6 << 20
PARTITION_BYTES = 256 << 20

SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("ahead", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("n_ids", pa.int64()), ("payload", pa.binary())])
SHARD_DDL = "part int, seq int, ahead long, doc_ids array<long>, counts array<long>, n_ids long, payload binary"


def pack(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """A stream of unsigned ids."""
    ids = np.asarray(ids).astype(np.uint64)
    n = len(ids)
    escape = np.flatnonzero(ids >> np.uint64(60))
    escaped = ids[escape]
    if len(escape):
        ids = ids.copy()
        ids[escape] = 0
    blocks = -(-n // block)
    wide = blocks * block
    # the narrowest selector for each id, in rows of a block and a margin that fits anything
    level = np.searchsorted(np.array([1 << b for b in BITS], np.uint64), ids, side="right").astype(np.uint8) if n and ids.max() >> np.uint64(16) else LEVEL16[ids.astype(np.int64)]
    row = np.zeros((blocks, block + COUNTS[0]), np.uint8)
    row[:, :block] = np.concatenate((level, np.zeros(wide - n, np.uint8))).reshape(blocks, block)
    spans = {1: row}
    for w in (2, 4, 8, 16, 32):
        half = spans[w // 2]
        spans[w] = np.maximum(half[:, : -(w // 2)], half[:, w // 2 :])
    choice = np.empty((blocks, block), np.uint8)
    for s in range(len(COUNTS) - 1, -1, -1):
        w = 1 << (COUNTS[s].bit_length() - 1)
        over = COUNTS[s] - w
        most = np.maximum(spans[w][:, :block], spans[w][:, over : over + block])
        np.copyto(choice, np.uint8(s), where=most <= s)
    choice = choice.reshape(-1)
    # every block's chain of words in step
    step = np.array(COUNTS)
    at, ends, live, heads, owners = np.arange(blocks) * block, np.minimum(np.arange(1, blocks + 1) * block, n), np.arange(blocks), [], []
    while len(at):
        heads.append(at)
        owners.append(live)
        at = at + step[choice[at]]
        going = at < ends
        at, ends, live = at[going], ends[going], live[going]
    head = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else head
    order = np.argsort(head)
    head, owner = head[order], owner[order]
    words = choice[head].astype(np.uint64) << np.uint64(60)
    for s in np.unique(choice[head]):
        mine = np.flatnonzero(choice[head] == s)
        count = np.minimum(COUNTS[s], np.minimum((owner[mine] + 1) * block, n) - head[mine])
        for k in range(COUNTS[s]):
            has = mine[count > k]
            words[has] |= ids[head[has] + k] << np.uint64(k * BITS[s])
    starts = np.searchsorted(owner, np.arange(blocks)).astype("<u4")
    header = MAGIC + np.array([block], "<u4").tobytes() + np.array([n, len(escape), len(words)], "<u8").tobytes()
    return header + starts.tobytes() + words.astype("<u8").tobytes() + np.column_stack((escape.astype("<u8"), escaped.astype("<u8"))).tobytes()


def unpack(stream: bytes, first_block: int = 0, last_block: int | None = None) -> np.ndarray:
    """The ids of a stream, or of some of its blocks, as uint64."""
    if stream[:4] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    block = int(np.frombuffer(stream, "<u4", 1, 4)[0])
    n, escapes, count = (int(x) for x in np.frombuffer(stream, "<u8", 3, 8))
    blocks = -(-n // block)
    last_block = blocks if last_block is None else min(last_block, blocks)
    starts = np.append(np.frombuffer(stream, "<u4", blocks, 32), count)
    base = 32 + 4 * blocks
    low, high = int(starts[first_block]) if first_block < blocks else count, int(starts[last_block])
    words = np.frombuffer(stream, "<u8", high - low, base + 8 * low)
    first = min(first_block * block, n)
    size = min(last_block * block, n) - first
    selector = (words >> np.uint64(60)).astype(np.int64)
    held = np.array(COUNTS + (0, 0))[selector]
    # the last word of a block holds what is left of it
    own = np.searchsorted(starts[first_block + 1 : last_block + 1] - low, np.arange(len(words)), side="right")
    ahead = np.cumsum(held) - held
    lead = starts[first_block:last_block].astype(np.int64) - low
    inside = ahead - ahead[lead][own] if len(words) else ahead
    place = own * block + inside
    out = np.zeros(size + COUNTS[0], np.uint64)
    limit = np.minimum((own + 1) * block, size)
    for s in np.unique(selector):
        mine = np.flatnonzero(selector == s)
        values = words[mine, None] >> np.arange(0, COUNTS[s] * BITS[s], BITS[s], dtype=np.uint64) & np.uint64((1 << BITS[s]) - 1)
        to = place[mine, None] + np.arange(COUNTS[s])
        has = to < limit[mine, None]
        out[to[has]] = values[has]
    out = out[:size]
    if escapes:
        pairs = np.frombuffer(stream, "<u8", 2 * escapes, base + 8 * count).reshape(-1, 2)
        mine = pairs[(pairs[:, 0] >= first) & (pairs[:, 0] < first + size)]
        out[mine[:, 0].astype(np.int64) - first] = mine[:, 1]
    return out


def shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, partitions: int | None = None, special_as_text: bool = False) -> DataFrame:
    """Rows (part, seq, ahead: ids before it in its part, doc_ids, counts, n_ids, payload); ordered by (part, seq) they hold the documents in ascending doc_id order.

    partitions: spark.sql.shuffle.partitions, or more where one would get over `PARTITION_BYTES` by the planner's estimate.
    """
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, ahead = loaded(vocabulary, "byte", special_as_text), TaskContext.get().partitionId(), 0, 0
        for batch in chunks(batches, SHARD_BYTES):
            ids, counts = encoder.encode_all(batch.column("text").to_pylist(), end_id)
            yield record(SHARD, [part], [seq], [ahead], [batch.column("doc_id").to_pylist()], [counts], [len(ids)], [pack(ids)])
            seq += 1
            ahead += len(ids)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    count = partitions or max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // PARTITION_BYTES, 1_000_000))
    return rows.repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id").mapInArrow(run, SHARD_DDL)


def decoded(files: DataFrame) -> DataFrame:
    """From shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the ids as little-endian uint32)."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("part_start"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                raw = unpack(row["payload"]).astype("<u4")
                ends = np.cumsum(row["counts"])
                starts = ends - row["counts"]
                view = memoryview(raw.tobytes())
                crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield record(schema, row["doc_ids"], pa.array(starts + row["start"]), row["counts"], crc)

    # a row for each partition, as many as the writer was told to make
    joined = files.join(F.broadcast(before), "part").select((F.col("part_start") + F.col("ahead")).alias("start"), "doc_ids", "counts", "payload")
    return joined.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read_back(docs: DataFrame, vocabulary: str, special_as_text: bool = False) -> DataFrame:
    """Writes the documents' ids as Simple-8b shards to the shared folder, then returns what the files hold of each document."""
    return decoded(written(shards(docs, vocabulary, special_as_text=special_as_text), "simple8b", wide=True))
