"""Best-fit packing of tokenized documents by a configuration linear program.

Documents are cut into pieces of at most `CAPACITY` tokens (only longer documents, into full pieces and a rest), so the
whole problem is a histogram over at most CAPACITY lengths, which is all that the driver sees. A configuration says how
many pieces of each length share a sequence. The linear program "cover every length's count with as few
configurations as possible" is solved by multiplicative weights: each length's price falls as it gets covered, and a
knapsack dynamic program over the capacity finds the configuration of the highest total price. The fractional solution
is rounded down to whole numbers within the counts; what is left is packed by further configurations, each a bounded
knapsack filled best-fit, largest lengths first, and used as often as the counts allow.

Pieces get places by rank within their length: within a part as they are cut, then by the counts of the parts before,
without gathering any length in one task. The plan goes to all
tasks as sorted steps for each length. Its size depends on the histogram, not on the documents: the program gives at
most ROUNDS configurations, and a configuration of the rest uses half of what its scarcest length has left, so their
number grows with the lengths and the logarithm of the counts.

Defined results. Null text is empty: one token, the end id. Repeated rows are separate documents. A null doc_id is
kept. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, record, trimmed, written
from .tokens import loaded

CAPACITY = 2048
END_ID = 0
#: Bytes of text at a time: the more, the fewer units are looked up twice, and the more memory each worker takes.
CHUNK_BYTES = 1 << 20
#: Rounds of multiplicative weights, and their rate.
ROUNDS = 1500
RATE = 0.5

PIECES = pa.schema([("part", pa.int32()), ("rank", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64())])
PIECES_DDL = "part int, rank long, doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, special_as_text: bool = False) -> DataFrame:
    """A row for each piece of each document; rank counts the pieces of one length within a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, ranks = loaded(vocabulary, "word", special_as_text), TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in chunks(batches, CHUNK_BYTES):
            ids, counts = encoder.encode_all(batch.column("text").to_pylist(), end_id)
            raw, at, out = memoryview(ids.tobytes()), 0, []
            for doc_id, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                for k, i in enumerate(range(0, n, capacity)):
                    length = min(capacity, n - i)
                    out.append((part, ranks[length], doc_id, k, i, length, zlib.crc32(raw[4 * (at + i) : 4 * (at + i + length)])))
                    ranks[length] += 1
                at += n
            yield record(PIECES, *map(list, zip(*out, strict=True)))
        encoder.forget()
        trimmed()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES_DDL)


def knapsack(price: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The unbounded knapsack by dynamic programming: the highest total price within each room, and the length that it adds last (0: none)."""
    # backwards[capacity - w] is the best total within w, so that the best rest beside each length is one slice
    backwards = np.zeros(capacity + 1)
    last = np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        total = backwards[capacity - room + 1 :] + price[1 : room + 1]
        k = int(total.argmax())
        if price[k + 1] > 0 and total[k] > backwards[capacity - room + 1]:
            backwards[capacity - room], last[room] = total[k], k + 1
        else:
            backwards[capacity - room] = backwards[capacity - room + 1]
    return backwards[::-1], last


def traced(last: np.ndarray, room: int) -> np.ndarray:
    """The configuration that the knapsack found for a room, as counts for each length."""
    counts = np.zeros(len(last), np.int64)
    while room > 0:
        if last[room]:
            counts[last[room]] += 1
            room -= last[room]
        else:
            room -= 1
    return counts


def fractional(demand: np.ndarray, capacity: int, rounds: int = ROUNDS, rate: float = RATE) -> tuple[np.ndarray, np.ndarray]:
    """Configurations (a row each) and how often each is used, by multiplicative weights; together they cover demand at most.

    Each round prices the lengths by how little of them is covered, and uses the best configuration as far as the counts go.
    """
    need = np.flatnonzero(demand)
    covered = np.zeros(capacity + 1)
    found: dict[bytes, float] = {}
    for _ in range(rounds):
        share = covered[need] / demand[need] if len(need) else np.ones(1)
        if share.min() >= 1 - 1e-9:
            break
        price = np.zeros(capacity + 1)
        price[need] = need / capacity * np.exp(-rate * (share - share.min())) * (share < 1 - 1e-9)
        last = knapsack(price, capacity)[1]
        counts = traced(last, capacity)
        used = np.flatnonzero(counts)
        times = ((demand[used] - covered[used]) / counts[used]).min()
        key = counts.astype("<i4").tobytes()
        found[key] = found.get(key, 0.0) + times
        covered += counts * times
    rows = np.array([np.frombuffer(k, "<i4") for k in found], np.int64).reshape(-1, capacity + 1)
    return rows, np.array(list(found.values()))


def fill(demand: np.ndarray, capacity: int) -> np.ndarray:
    """One configuration within demand, filled as far as a bounded subset-sum can: the largest length first, the rest to best fit."""
    counts = np.zeros(capacity + 1, np.int64)
    first = int(np.flatnonzero(demand)[-1])
    counts[first] = 1
    room = capacity - first
    lengths = np.flatnonzero(demand[: room + 1])
    if not len(lengths):
        return counts
    # reach[r]: the length by which a total of r was first reached, larger lengths first; each length at most `demand` times
    reach = np.zeros(room + 1, np.int64)
    reach[0] = -1
    totals = np.zeros(room + 1, bool)
    totals[0] = True
    for length in lengths[::-1].tolist():
        left = int(demand[length] - counts[length])
        power = 1
        steps = []
        while left > 0:
            take = min(power, left)
            if take * length > room:
                break
            steps.append(take)
            left -= take
            power *= 2
        for take in steps:
            size = take * length
            new = np.zeros(room + 1, bool)
            new[size:] = totals[: room + 1 - size]
            new &= ~totals
            if new.any():
                reach[new] = length * (capacity + 1) + take
                totals |= new
        if totals[room]:
            break
    at = int(np.flatnonzero(totals)[-1])
    while at > 0:
        length, take = divmod(int(reach[at]), capacity + 1)
        counts[length] += take
        at -= length * take
    return counts


def solve(demand: np.ndarray, capacity: int = CAPACITY) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of sequences that hold exactly demand (index: length)."""
    left = demand.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    if left[capacity]:
        full = np.zeros(capacity + 1, np.int64)
        full[capacity] = 1
        plan.append((full, int(left[capacity])))
        left[capacity] = 0
    rows, times = fractional(left, capacity)
    # round down, the fullest configurations first; a copy must not take a length past its count
    lengths = np.arange(capacity + 1)
    for k in np.argsort(-(rows @ lengths), kind="stable") if len(rows) else []:
        used = np.flatnonzero(rows[k])
        copies = int(min(np.floor(times[k]), (left[used] // rows[k][used]).min()))
        if copies > 0 and rows[k] @ lengths >= 0.995 * capacity:
            plan.append((rows[k], copies))
            left -= rows[k] * copies
    while left.any():
        counts = fill(left, capacity)
        used = np.flatnonzero(counts)
        # half at a time: what is left keeps a mix of lengths, and single copies still end it
        copies = max(1, int((left[used] // counts[used]).min()) // 2)
        plan.append((counts, copies))
        left -= counts * copies
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (a table that reads the same rows each time, such as a written one)."""
    spark = cut.sparkSession
    counts = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "packing-counts")
    before = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    demand = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("length").agg(F.sum("n").alias("n")).toLocalIterator():
        demand[row["length"]] = row["n"]
    # a length's steps: first rank, pieces in a sequence, first sequence, place of the first piece
    steps: dict[int, list[tuple[int, int, int, int]]] = {}
    sequence, ranks = 0, np.zeros(capacity + 1, np.int64)
    for config, copies in solve(demand, capacity):
        offset = 0
        for length in np.flatnonzero(config)[::-1].tolist():
            each = int(config[length])
            steps.setdefault(length, []).append((int(ranks[length]), each, sequence, offset))
            ranks[length] += each * copies
            offset += each * length
        sequence += copies
    # ranks within a part, then within all; the counts of all parts have no bound, so they aren't broadcast
    ranked = cut.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("ahead"))
    shared = spark.sparkContext.broadcast({length: np.array(x, np.int64).T for length, x in steps.items()})
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            sequence_id, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for one in np.unique(length).tolist():
                mine = np.flatnonzero(length == one)
                low, each, first, at = shared.value[one]
                k = np.searchsorted(low, rank[mine], side="right") - 1
                inside = rank[mine] - low[k]
                sequence_id[mine] = first[k] + inside // each[k]
                offset[mine] = at[k] + inside % each[k] * one
            yield record(schema, batch.column("doc_id"), batch.column("piece"), batch.column("start"), pa.array(length), batch.column("ids_crc32"), pa.array(sequence_id), pa.array(offset))

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, special_as_text: bool = False) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack(written(pieces(docs, vocabulary, capacity, special_as_text=special_as_text), "packing-pieces"), capacity)
