"""Benchmark decontamination over a distributed positional inverted index.

`index_segments` stores the token postings of all training terms: a row of the written table is a segment, the index of about
`SEGMENT_BYTES` of text, with a directory of its documents and, for each term, the ascending list of its places. Places
count through the segment, with a gap between documents, so that no phrase runs across two. The index knows nothing of the
test items; one index serves any number of them.

`search` files each window of an item under its rarest term, by counts over all documents. A segment is asked only for
the windows whose rarest term it holds; their place lists, each shifted by the term's offset, are intersected from the
list that is shortest there; what is left are exact phrase matches. For proximity, a document must hold at least
`NEAR_SHARE` of the item's distinct terms, and of those that it holds, the `NEAR_TERMS` rarest (by counts over all documents, ties by
term) must lie within `SLOP` words of a place of the one that the document has least often. A document's matches thus
depend on its own words and on those counts, not on the segment it is in. Segments are searched where they lie; nothing
is shuffled. Items come in blocks of at most `BLOCK_WORDS` words, which bounds what is broadcast; hits of several blocks
are united by document.

Defined results. Null text has no words (n_words 0, clean). Items that are null or have no word never match. Repeated
items count once by item_id. An item without an id has its words hit and can contaminate, but it isn't among the items that are
counted and listed. Repeated documents each give a row. Empty tables: no row, or all documents clean. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record, small_batches, texts, written

WINDOW = 10
SLOP = 20
NEAR_TERMS = 4
NEAR_SHARE = 0.8
SEGMENT_BYTES = 2 << 20
BLOCK_WORDS = 500_000

#: Bytes that aren't words become spaces, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

SEGMENT = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.binary()), ("terms", pa.list_(pa.binary())), ("list_starts", pa.binary()), ("places", pa.binary())])
SEGMENT_DDL = "part int, seq int, doc_ids array<long>, doc_starts binary, terms array<binary>, list_starts binary, places binary"
COUNTS = pa.schema([("term", pa.binary()), ("n", pa.int64())])
HITS = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("row", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("near_items", pa.list_(pa.string()))])
HITS_DDL = "part int, seq int, row int, doc_id long, n_words long, runs array<long>, items array<string>, near_items array<string>"


def words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


def index_segments(docs: DataFrame) -> DataFrame:
    """The index, a row for each segment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for batch in chunks(batches, SEGMENT_BYTES):
            per_doc = [words(t) for t in texts(batch)]
            sizes = np.array([len(w) for w in per_doc], np.int64)
            # a place after each document stays empty
            starts = np.concatenate(([0], np.cumsum(sizes + 1)))
            coded = pa.array(list(itertools.chain.from_iterable(per_doc)), pa.binary()).dictionary_encode()
            term = coded.indices.to_numpy()
            # a place grows by one for each document before it
            order = np.argsort(term, kind="stable")
            place = (np.arange(len(term)) + np.repeat(np.arange(len(sizes)), sizes))[order]
            count = np.bincount(term, minlength=len(coded.dictionary))
            yield record(
                SEGMENT,
                [part],
                [seq],
                [batch.column("doc_id").to_pylist()],
                [starts.astype("<u4").tobytes()],
                pa.ListArray.from_arrays(pa.array([0, len(coded.dictionary)], pa.int32()), coded.dictionary),
                [np.concatenate(([0], np.cumsum(count))).astype("<u4").tobytes()],
                [place.astype("<u4").tobytes()],
            )
            seq += 1

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SEGMENT_DDL)


class Item:
    """A test item: its distinct windows as tuples of terms. name: None if it has no id."""

    def __init__(self, name: str | None, terms: list[bytes], size: int = WINDOW):
        self.name = name
        self.terms = terms
        self.windows = list(dict.fromkeys(tuple(terms[i : i + size]) for i in range(max(1, len(terms) - size + 1)))) if terms else []


def item_blocks(items: DataFrame, size: int = WINDOW) -> Iterator[list[Item]]:
    """The items, streamed to the driver in blocks of bounded size."""
    held, room = [], BLOCK_WORDS
    for row in items.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct().toLocalIterator():
        item = Item(row["item_id"], words(row["text"].encode()), size)
        if held and len(item.terms) > room:
            yield held
            held, room = [], BLOCK_WORDS
        held.append(item)
        room -= len(item.terms)
    if held:
        yield held


def intersected(lists: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Starts of a phrase: places of its terms minus their offsets, rarest first."""
    lists = sorted(lists, key=lambda x: len(x[0]))
    first = lists[0][0] - lists[0][1]
    for places, offset in lists[1:]:
        if not len(first):
            break
        at = np.searchsorted(places, first + offset)
        first = first[(at < len(places)) & (places[np.minimum(at, len(places) - 1)] == first + offset)]
    return first


def near(lists: list[np.ndarray], slop: int) -> np.ndarray:
    """Places of the rarest list that have a place of every other list within slop words."""
    lists = sorted(lists, key=len)
    at = lists[0]
    for places in lists[1:]:
        if not len(at):
            break
        low = np.searchsorted(places, at - slop)
        at = at[(low < len(places)) & (np.abs(places[np.minimum(low, len(places) - 1)] - at) <= slop)]
    return at


def term_counts(index: DataFrame, items: list[Item]) -> dict[bytes, int]:
    """How often each term of the items occurs in all documents; the items' block bounds the terms."""
    sent = index.sparkSession.sparkContext.broadcast({t for item in items for t in item.terms})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                names = batch.column("terms")[i].values
                mine = np.flatnonzero(pc.is_in(names, pa.array(list(sent.value), pa.binary())).to_numpy(zero_copy_only=False))
                n = np.diff(np.frombuffer(batch.column("list_starts")[i].as_py(), "<u4").astype(np.int64))
                total.update(dict(zip(names.take(pa.array(mine)).to_pylist(), n[mine].tolist(), strict=True)))
        yield record(COUNTS, list(total), list(total.values()))

    counted = index.select("terms", "list_starts").mapInArrow(run, "term binary, n long")
    with small_batches(index.sparkSession):
        return {bytes(r["term"]): r["n"] for r in counted.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator()}


def near_documents(ranked: list[bytes], lists: dict[bytes, np.ndarray], docs: dict[bytes, np.ndarray], starts: np.ndarray) -> list[int]:
    """Documents of a segment with a match by proximity; ranked: an item's distinct terms, rarest first, docs: the documents of each term."""
    need = math.ceil(NEAR_SHARE * len(ranked) - 1e-9)
    there = [t for t in ranked if t in lists]
    if not there or len(there) < need:
        return []
    held = np.zeros(len(starts) - 1, np.int32)
    for t in there:
        held[docs[t]] += 1
    out = []
    for d in np.flatnonzero(held >= need).tolist():
        rare = []
        for t in there:
            i, j = np.searchsorted(lists[t], starts[d : d + 2])
            if i < j:
                rare.append(lists[t][i:j])
                if len(rare) == NEAR_TERMS:
                    break
        if len(near(rare, SLOP)):
            out.append(d)
    return out


def search(index: DataFrame, items: list[Item], proximity: bool = True) -> DataFrame:
    """For each document its hits: runs (start, end, start, end, ...) of hit words, items with an exact match, items with a match by proximity."""
    counts = term_counts(index, items)
    by_rarity = lambda t: (counts.get(t, 0), t)
    ranked = [sorted(set(item.terms), key=by_rarity) for item in items] if proximity else []
    # each window under its rarest term; one with a term that no document holds can't match
    under: dict[bytes, dict[tuple, list[str | None]]] = {}
    for item in items:
        for window in item.windows:
            if all(t in counts for t in window):
                under.setdefault(min(window, key=by_rarity), {}).setdefault(window, []).append(item.name)
    sent = index.sparkSession.sparkContext.broadcast((sorted(counts), under, [item.name for item in items], ranked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, windows, item_names, by_rank = sent.value
        asked = pa.array(known, pa.binary())
        for batch in batches:
            for row in range(batch.num_rows):
                part, seq, doc_ids, doc_starts, terms, list_starts, places = (batch.column(c)[row] for c in SEGMENT.names)
                starts = np.frombuffer(doc_starts.as_py(), "<u4").astype(np.int64)
                cuts = np.frombuffer(list_starts.as_py(), "<u4").astype(np.int64)
                flat = np.frombuffer(places.as_py(), "<u4")
                # of all terms of the segment those that the items have
                mine = np.flatnonzero(pc.is_in(terms.values, asked).to_numpy(zero_copy_only=False))
                names = terms.values.take(pa.array(mine)).to_pylist()
                lists = {t: flat[cuts[k] : cuts[k + 1]].astype(np.int64) for t, k in zip(names, mine.tolist(), strict=True)}
                n = len(starts) - 1
                edge = np.zeros(int(starts[-1]) + 1, np.int32)
                exact: list[set[str]] = [set() for _ in range(n)]
                close: list[set[str]] = [set() for _ in range(n)]
                for rarest in names:
                    for window, owners in windows.get(rarest, {}).items():
                        if not all(t in lists for t in window):
                            continue
                        at = intersected([(lists[t], k) for k, t in enumerate(window)])
                        if len(at):
                            np.add.at(edge, at, 1)
                            np.add.at(edge, at + len(window), -1)
                            for d in np.unique(np.searchsorted(starts, at, side="right") - 1).tolist():
                                exact[d].update(x for x in owners if x is not None)
                if proximity:
                    docs = {}
                    for t, at in lists.items():
                        owner = np.searchsorted(starts, at, side="right") - 1
                        docs[t] = owner[np.diff(owner, prepend=-1) > 0]
                    for name, rank in zip(item_names, by_rank, strict=True):
                        if name is not None:
                            for d in near_documents(rank, lists, docs, starts):
                                close[d].add(name)
                hit = np.cumsum(edge) > 0
                turn = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                owner = np.searchsorted(starts, turn[::2], side="right") - 1
                runs: list[list[int]] = [[] for _ in range(n)]
                for d, i, j in zip(owner.tolist(), turn[::2].tolist(), turn[1::2].tolist(), strict=True):
                    runs[d] += [i - int(starts[d]), j - int(starts[d])]
                yield record(HITS, [part.as_py()] * n, [seq.as_py()] * n, list(range(n)), doc_ids.values, pa.array(np.diff(starts) - 1), runs, [sorted(x) for x in exact], [sorted(x) for x in close])

    return index.select(*SEGMENT.names).mapInArrow(run, HITS_DDL)


def united(parts: list[DataFrame]) -> DataFrame:
    """The hits of several blocks of items, a row for each document."""
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    of = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    grouped = both.groupBy("part", "seq", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("runs")).alias("runs"), of("items").alias("items"), of("near_items").alias("near_items"))

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                merged: list[int] = []
                for i, j in sorted(zip(row["runs"][::2], row["runs"][1::2], strict=True)):
                    if merged and i <= merged[-1]:
                        merged[-1] = max(merged[-1], j)
                    else:
                        merged += [i, j]
                out.append(row | {"runs": merged})
            yield pa.RecordBatch.from_pylist(out, HITS)

    return grouped.select(*HITS.names).mapInArrow(unite, HITS_DDL)


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, proximity: bool = True) -> DataFrame:
    """doc_id, n_words, runs, items, near_items for each document. The index is built once for all blocks of items."""
    index = written(index_segments(docs), "positions", wide=True)
    blocks = item_blocks(items, size)
    first = search(index, next(blocks, []), proximity)
    parts = [written(search(index, block, proximity), "hits") for block in blocks]
    return (united([first, *parts]) if parts else first).drop("part", "seq", "row")


def contamination(docs: DataFrame, items: DataFrame, proximity: bool = True) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items (0 without proximity)."""
    runs = F.expr("aggregate(sequence(0, cast(size(runs) / 2 as int)), 0L, (s, i) -> if(i * 2 < size(runs), s + runs[i * 2 + 1] - runs[i * 2], s))")
    return hits(docs, items, proximity=proximity).select(
        "doc_id",
        "n_words",
        runs.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
        F.size("near_items").cast("long").alias("n_near_items"),
    )


def clean(docs: DataFrame, items: DataFrame, largest_share: float = 0.0) -> DataFrame:
    """The documents of which at most largest_share of the words are hit, with their own columns. Rows of one doc_id go together; a null doc_id names no document, so such rows stay."""
    bad = contamination(docs, items, proximity=False).filter(F.col("n_hit") > F.lit(largest_share) * F.col("n_words")).select("doc_id").distinct()
    return docs.join(written(bad, "contaminated"), "doc_id", "left_anti").select(*docs.columns)


def digest(names: list[str]) -> str:
    """The digest of a set of item names, as contamination() makes it."""
    return hashlib.sha256(",".join(sorted(set(names))).encode()).hexdigest()
