"""LM scoring by Brown class-based bigrams.

A text is its words (ASCII letters lower-cased) and one end token; the token before the first is an end too. The model:
log10 P(text) = sum over tokens of log10 P(class | history before) + log10 P(word | class).

Every word of the training texts has a class, found by exchange: a word goes to the class that gives the most bigram
likelihood. The `SEEDS` most frequent words are exchanged with each other, over their bigrams in all training texts,
until nothing moves or `PASSES` are over; all other words count as one there. Then each word of the `HEAD`, the most
frequent ones, and after them each other word, however rare, is exchanged against the table of class bigrams by its own counts
of the classes before and after it, gathered over all training texts, each word in some task. These counts grow with the input;
none of them come to the driver but the classes of the head.

As a history, a word of the head, or the end, is its class; all other words are one history. So a word outside the head needs only its own
class to be scored, which a join gives it. Transitions are interpolated with the class's own frequency; emissions count
every word of the training texts exactly. A word that isn't in them gets, from each class, the share of one word of a
count of nothing.

The head, a fixed number of words, goes to all tasks, which takes the hot keys out of the join of the remaining
(document, word) counts with the table of words.

Defined results. Null text is empty: the end token alone. Repeated rows each count and each give a row. A null doc_id is
trained on and isn't held out. With no training text, N = V = 0, base is 0.5 / 0.5 for each token, and all words are
unknown. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record, written

END = b""
HEAD = 100_000
SEEDS = 1000
#: Classes of words. Two more come first: the end token's, and what stands for words without a class yet, or outside the head as a history.
CLASSES = 48
END_CLASS, REST = 0, 1
FIRST = 2
PASSES = 6
DELTA = 0.5
#: Weight of the class frequencies within the transitions.
BACK_OFF = 5.0
#: Bytes of text at a time.
CHUNK_BYTES = 4 << 20
#: Words that a task counts, each chunk's by themselves, before it sums them and passes them on.
HELD_WORDS = 400_000

COUNTS = pa.schema([("word", pa.binary()), ("n", pa.int64())])
PAIRS = pa.schema([("pair", pa.int64()), ("n", pa.int64())])
#: A word's counts of classes before it (code: the class) and after it (code: all classes + the class), as ENTRY records; or a pair of classes and its count.
ENTRY = np.dtype([("code", "u1"), ("n", "<u4")])
CONTEXTS = pa.schema([("place", pa.int32()), ("word", pa.binary()), ("entries", pa.binary()), ("pair", pa.int64()), ("n", pa.int64())])
CONTEXTS_DDL = "place int, word binary, entries binary, pair long, n long"
CLASSED = pa.schema([("place", pa.int32()), ("word", pa.binary()), ("class", pa.int32()), ("pair", pa.int64()), ("n", pa.int64())])
CLASSED_DDL = "place int, word binary, class int, pair long, n long"
PARTS = pa.schema([("word", pa.binary()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("history", pa.int32()), ("n", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])
PARTS_DDL = "word binary, row long, doc_id long, held_out boolean, history int, n long, n_tokens long, n_known long, base double, score double"


@dataclass
class Tokens:
    """The tokens of a batch's texts, one after another: each text's words and its end."""

    words: pa.Array  # without the ends
    sizes: np.ndarray  # tokens of each text
    is_word: np.ndarray  # for each token


def tokens(batch: pa.RecordBatch) -> Tokens:
    """Arrow splits at the six ASCII white-space characters, lower-cases A-Z only, and looks at bytes: other characters, and what is no UTF-8, stay as they are."""
    text = batch.column("text")
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text if pa.types.is_string(text.type) else text.cast(pa.string()), "")))
    cuts, flat = lists.offsets.to_numpy(), lists.flatten()
    # space before, after or without words leaves empty strings
    full = pc.binary_length(flat).to_numpy() > 0
    sizes = np.diff(np.concatenate(([0], np.cumsum(full)))[cuts - cuts[0]]) + 1
    is_word = np.ones(int(sizes.sum()), bool)
    is_word[np.cumsum(sizes) - 1] = False
    return Tokens(flat.filter(pa.array(full)).cast(pa.binary()), sizes, is_word)


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: exact counts of all tokens of all texts, as a written table."""

    def merged(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held:
            sums = pa.Table.from_batches(held).group_by("word", use_threads=False).aggregate([("n", "sum")])
            for batch in sums.select(["word", "n_sum"]).rename_columns(COUNTS.names).cast(COUNTS).to_batches():
                yield batch

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chunks(batches, CHUNK_BYTES):
            own = tokens(batch)
            coded = own.words.dictionary_encode()
            held.append(record(COUNTS, coded.dictionary, pa.array(np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary)))))
            held.append(record(COUNTS, [END], [len(own.sizes)]))
            if sum(x.num_rows for x in held) >= HELD_WORDS:
                yield from merged(held)
                held = []
        yield from merged(held)

    partial = docs.select("text").mapInArrow(run, "word binary, n long")
    return written(partial.groupBy("word").agg(F.sum("n").alias("n")), "word-counts")


def head_of(counts: DataFrame) -> tuple[dict[bytes, int], np.ndarray]:
    """The places of the most frequent words and, last, of the end token; and their counts."""
    top = counts.filter(F.col("word") != F.lit(END)).orderBy(F.col("n").desc(), "word").limit(HEAD).toArrow()
    ends = counts.filter(F.col("word") == F.lit(END)).first()
    words = [*(bytes(w) for w in top.column("word").to_pylist()), END]
    return {w: i for i, w in enumerate(words)}, np.array([*top.column("n").to_pylist(), ends["n"] if ends else 0], np.int64)


def listed(head: dict[bytes, int]) -> pa.Array:
    return pa.array(list(head), pa.binary())


def placed(own: Tokens, known: pa.Array) -> np.ndarray:
    """All tokens' places in the head, -1 outside it. known: the head's words by place, END the last."""
    place = np.full(len(own.is_word), len(known) - 1, np.int32)
    place[own.is_word] = pc.fill_null(pc.index_in(own.words, value_set=known), -1).to_numpy()
    return place


def summed(pairs: DataFrame, size: int) -> np.ndarray:
    """A square table of (pair, n) rows, a bounded number of distinct pairs."""
    out = np.zeros(size * size, np.int64)
    found = pairs.groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found.column("pair").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(size, size)


def unit_bigrams(docs: DataFrame, head: dict[bytes, int], unit: np.ndarray) -> np.ndarray:
    """Counts of (unit before, unit) over all texts; unit: of each place, and last, of words outside the head."""
    sent, size = docs.sparkSession.sparkContext.broadcast((head, unit)), int(unit.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = listed(sent.value[0]), sent.value[1]
        end, total = of[len(known) - 1], np.zeros(size * size, np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            units = of[placed(tokens(batch), known)].astype(np.int64)
            pair, n = np.unique(np.concatenate(([end], units[:-1])) * size + units, return_counts=True)
            total[pair] += n
        yield from pair_rows(total)

    return summed(docs.select("text").mapInArrow(run, "pair long, n long"), size)


def pair_rows(total: np.ndarray) -> Iterator[pa.RecordBatch]:
    pair = np.flatnonzero(total)
    for i in range(0, len(pair), 1 << 16):
        yield record(PAIRS, pa.array(pair[i : i + (1 << 16)]), pa.array(total[pair[i : i + (1 << 16)]]))


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, fixed: int | tuple[int, ...], classes: int = CLASSES + 1, passes: int = PASSES) -> np.ndarray:
    """A class for each unit by the exchange algorithm; the fixed units stay alone in classes 0, 1, ..., and classes counts the last of these and all others."""
    fixed = fixed if isinstance(fixed, tuple) else (fixed,)
    pairs = pairs.astype(np.float64)
    size = len(pairs)
    mass = pairs.sum(0) + pairs.sum(1)
    order = [u for u in np.argsort(-mass, kind="stable").tolist() if u not in fixed]
    low = len(fixed)
    classes = max(low + 1, min(classes + low - 1, size))
    of = np.zeros(size, np.int64)
    of[list(fixed)] = np.arange(low)
    for k, u in enumerate(order):
        of[u] = low + k % (classes - low)
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    right, left = pairs @ member, pairs.T @ member  # (unit, class after it) and (unit, class before it)
    table = member.T @ right
    for _ in range(passes):
        moved = 0
        for u in order:
            if not mass[u]:
                continue
            own, self_pairs = of[u], pairs[u, u]
            r, c = right[u].copy(), left[u].copy()
            r[own] -= self_pairs
            c[own] -= self_pairs
            # take the unit out of its class
            table[own, :] -= right[u]
            table[:, own] -= left[u]
            table[own, own] += self_pairs
            row, col = table.sum(1), table.sum(0)
            ru, cu = r.sum() + self_pairs, c.sum() + self_pairs
            gain = (xlogx(table + r[None, :]) - xlogx(table)).sum(1) + (xlogx(table + c[:, None]) - xlogx(table)).sum(0)
            d, k = np.diagonal(table), np.arange(classes)
            gain += xlogx(d + r[k] + c[k] + self_pairs) - xlogx(d + r[k]) - xlogx(d + c[k]) + xlogx(d)
            gain -= xlogx(row + ru) - xlogx(row) + xlogx(col + cu) - xlogx(col)
            gain[:low] = -np.inf
            best = int(np.argmax(gain))
            if gain[best] <= gain[own] + 1e-9:
                best = int(own)
            table[best, :] += r
            table[:, best] += c
            table[best, best] += self_pairs
            if best != own:
                moved += 1
                right[:, own] -= pairs[:, u]
                right[:, best] += pairs[:, u]
                left[:, own] -= pairs[u, :]
                left[:, best] += pairs[u, :]
                of[u] = best
        if not moved:
            break
    return of


def best_classes(word: np.ndarray, code: np.ndarray, n: np.ndarray, words: int, table: np.ndarray) -> np.ndarray:
    """For each of words the class that raises the bigram likelihood of a table of class bigrams most when the word comes to it.

    word, code, n: the words' entries, ordered by word, each word with at least one. A cell that both sides of a word change is counted as two.
    """
    size = len(table)
    table = table.astype(np.float64)
    cells = np.concatenate((table, table.T))  # by code: what a class has of it, before and after
    gain = np.empty((words, size))
    cuts = np.searchsorted(word, np.arange(words + 1))
    for i in range(0, words, 4096):
        j = min(words, i + 4096)
        mine = slice(cuts[i], cuts[j])
        at = cells[code[mine]]
        gain[i:j] = np.add.reduceat(xlogx(at + n[mine, None]) - xlogx(at), cuts[i:j] - cuts[i], axis=0)
    before = np.bincount(word, np.where(code < size, n, 0), words)[:, None]
    after = np.bincount(word, np.where(code < size, 0, n), words)[:, None]
    rows, columns = table.sum(1), table.sum(0)
    gain -= xlogx(rows + after) - xlogx(rows) + xlogx(columns + before) - xlogx(columns)
    gain[:, :FIRST] = -np.inf
    return gain.argmax(axis=1)


def packed_entries(owner: np.ndarray, code: np.ndarray, owners: int, codes: int) -> pa.Array:
    """For each owner its distinct codes and their counts, as bytes of ENTRY records."""
    pair, n = np.unique(owner.astype(np.int64) * codes + code, return_counts=True)
    return entry_array(pair // codes, pair % codes, n, owners)


def entry_array(owner: np.ndarray, code: np.ndarray, n: np.ndarray, owners: int) -> pa.Array:
    data = np.empty(len(owner), ENTRY)
    data["code"], data["n"] = code, n
    cuts = np.searchsorted(owner, np.arange(owners + 1)) * ENTRY.itemsize
    return pa.Array.from_buffers(pa.binary(), owners, [None, pa.py_buffer(cuts.astype("<i4").tobytes()), pa.py_buffer(data.tobytes())])


def head_contexts(docs: DataFrame, head: dict[bytes, int], class_of: np.ndarray, seeds: int, size: int) -> DataFrame:
    """Of the head's words behind the seeds, what classes come before and after; class_of: of each place, and last, of words outside the head."""
    sent = docs.sparkSession.sparkContext.broadcast((head, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = listed(sent.value[0]), sent.value[1]
        total = np.zeros((len(known) - 1) * 2 * size, np.uint32)
        for batch in chunks(batches, CHUNK_BYTES):
            place = placed(tokens(batch), known)
            classes = of[place].astype(np.int64)
            at = np.flatnonzero((place >= seeds) & (place < len(known) - 1))
            before = np.concatenate(([END_CLASS], classes[:-1]))
            for code in (before[at], size + classes[at + 1]):
                pair, n = np.unique(place[at].astype(np.int64) * (2 * size) + code, return_counts=True)
                total[pair] += n.astype(np.uint32)
        pair = np.flatnonzero(total)
        place, code = pair // (2 * size), pair % (2 * size)
        names, at = np.unique(place, return_inverse=True)
        if len(names):
            yield record(CONTEXTS, pa.array(names, pa.int32()), pa.nulls(len(names), pa.binary()), entry_array(at, code, total[pair], len(names)), pa.nulls(len(names), pa.int64()), pa.nulls(len(names), pa.int64()))

    return docs.select("text").mapInArrow(run, CONTEXTS_DDL)


def rare_contexts(docs: DataFrame, head: dict[bytes, int], class_of: np.ndarray, size: int) -> DataFrame:
    """Of the words outside the head, what classes come before and after, a row for each chunk of text; and the counts of all pairs of classes."""
    sent = docs.sparkSession.sparkContext.broadcast((head, class_of))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, of = listed(sent.value[0]), sent.value[1]
        total = np.zeros(size * size, np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            own = tokens(batch)
            place = placed(own, known)
            classes = of[place].astype(np.int64)
            before = np.concatenate(([END_CLASS], classes[:-1]))
            total += np.bincount(before * size + classes, minlength=size * size)
            at = np.flatnonzero(place < 0)
            if len(at):
                rare = own.words.filter(pa.array(place[own.is_word] < 0)).dictionary_encode()
                owner, k = rare.indices.to_numpy(), len(rare.dictionary)
                entries = packed_entries(np.concatenate((owner, owner)), np.concatenate((before[at], size + classes[at + 1])), k, 2 * size)
                yield record(CONTEXTS, pa.nulls(k, pa.int32()), rare.dictionary, entries, pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()))
        for pairs in pair_rows(total):
            k = pairs.num_rows
            yield record(CONTEXTS, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()), pairs.column("pair"), pairs.column("n"))

    return docs.select("text").mapInArrow(run, CONTEXTS_DDL)


def classed(contexts: DataFrame, key: str, table: np.ndarray) -> DataFrame:
    """Each word's (or place's) class and count; and for the pairs of the class before and its own, the counts."""
    sent, size = contexts.sparkSession.sparkContext.broadcast(table), len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, np.int64)

        def settled(names: list, word: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            best = best_classes(word, code, n, len(names), sent.value)
            mine = code < size
            np.add.at(total, code[mine].astype(np.int64) * size + best[word[mine]], n[mine])
            count = np.bincount(word[mine], n[mine], len(names)).astype(np.int64)
            own, none = pa.array(names, CLASSED.field(key).type), pa.nulls(len(names), CLASSED.field("word" if key == "place" else "place").type)
            return record(CLASSED, *((own, none) if key == "place" else (none, own)), pa.array(best, pa.int32()), pa.nulls(len(names), pa.int64()), pa.array(count))

        # what the last word has so far: its name, codes, counts
        held: tuple[object, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, raw = batch.column(key).to_pylist(), batch.column("entries").to_pylist()
            entries = np.frombuffer(b"".join(raw), ENTRY)
            code, n = entries["code"].astype(np.int64), entries["n"].astype(np.int64)
            new = np.concatenate(([not (held and held[0] == keys[0])], [a != b for a, b in zip(keys, keys[1:], strict=False)])).astype(bool)
            row_word = np.cumsum(new) - 1 + (1 if held else 0)
            names = ([held[0]] if held else []) + [k for k, first in zip(keys, new.tolist(), strict=True) if first]
            word = np.repeat(row_word, [len(x) // ENTRY.itemsize for x in raw])
            if held:
                word, code, n = np.concatenate((np.zeros(len(held[1]), np.int64), word)), np.concatenate((held[1], code)), np.concatenate((held[2], n))
            pair, back = np.unique(word * (2 * size) + code, return_inverse=True)
            word, code, n = pair // (2 * size), pair % (2 * size), np.bincount(back, n).astype(np.int64)
            last = word == len(names) - 1
            held = names[-1], code[last], n[last]
            if len(names) > 1:
                yield settled(names[:-1], word[~last], code[~last], n[~last])
        if held:
            yield settled([held[0]], np.zeros(len(held[1]), np.int64), held[1], held[2])
        for pairs in pair_rows(total):
            k = pairs.num_rows
            yield record(CLASSED, pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pairs.column("pair"), pairs.column("n"))

    rows = contexts.filter(F.col(key).isNotNull()).select(key, "entries")
    return rows.repartition(key).sortWithinPartitions(key).mapInArrow(run, CLASSED_DDL)


@dataclass
class Model:
    head: dict[bytes, int]
    counts: np.ndarray  # by place
    class_of: np.ndarray  # by place, and last, of words outside the head as a history
    transition: np.ndarray  # log10 P(class after | class before)
    class_total: np.ndarray  # log10 of each class's emission denominator
    unknown: np.ndarray  # log10 P(a word that training didn't have | class before)
    total: int
    distinct: int


def train(docs: DataFrame) -> tuple[Model, DataFrame]:
    """The model of the documents, and the table (word, n, class) of the words outside the head."""
    counts = word_counts(docs)
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    head, n = head_of(counts)
    seeds, end = min(SEEDS, len(head) - 1), len(head) - 1
    unit = np.full(len(head) + 1, seeds + 1, np.int32)
    unit[:seeds], unit[end] = np.arange(seeds), seeds
    pairs = unit_bigrams(docs, head, unit)
    of = exchange(pairs, (seeds, seeds + 1))
    size = max(int(of.max()) + 1, FIRST + 1)
    member = np.zeros((len(of), size))
    member[np.arange(len(of)), of] = 1
    class_of = of[unit]
    if end > seeds:
        found = classed(head_contexts(docs, head, class_of, seeds, size), "place", member.T @ pairs @ member)
        found = found.filter("place IS NOT NULL").select("place", "class").toArrow()
        class_of[found.column("place").to_numpy()] = found.column("class").to_numpy()
    contexts = written(rare_contexts(docs, head, class_of, size), "word-contexts")
    table = summed(contexts.filter("pair IS NOT NULL").select("pair", "n"), size)
    rare = written(classed(contexts, "word", table), "word-classes")
    words = rare.filter("word IS NOT NULL").select("word", "n", "class")
    # the transitions of all words: those of the head, and those into the classes of the others
    table[:, REST] = 0
    table = table + summed(rare.filter("pair IS NOT NULL").select("pair", "n"), size)
    own = class_of[:-1]
    mass, kinds = np.bincount(own, n, size), np.bincount(own, n > 0, size)
    for r in words.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).toLocalIterator():
        mass[r["class"]] += r["n"]
        kinds[r["class"]] += r["v"]
    used = np.arange(size) != REST
    share = np.where(used, table.sum(0) + 0.5, 0.0)
    share /= share.sum()
    transition = (table + BACK_OFF * share) / (table.sum(1, keepdims=True) + BACK_OFF)
    denominator = mass + DELTA * (kinds + 1)
    unknown = np.log10((transition * (DELTA / denominator)).sum(1))
    with np.errstate(divide="ignore"):
        return Model(head, n, class_of, np.log10(transition), np.log10(denominator), unknown, int(whole["n"]), int(whole["v"])), words


def score(docs: DataFrame, model: Model, words: DataFrame) -> DataFrame:
    """docs: doc_id, text, held_out. A row for each: n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    base_total = math.log10(model.total + 0.5 * (model.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        head = listed(known.head)
        # one place more, for all words outside the head
        emitted, counted = np.append(np.log10(known.counts + DELTA), 0.0), np.append(known.counts > 0, False).astype(np.int64)
        for batch in chunks(batches, CHUNK_BYTES):
            own_tokens = tokens(batch)
            sizes, at = own_tokens.sizes, placed(own_tokens, head)
            of = known.class_of[at]
            before = np.concatenate(([END_CLASS], of[:-1]))
            firsts = np.cumsum(sizes) - sizes
            own, rare = emitted[at], np.flatnonzero(at < 0)
            whole = known.transition[before, of] + own - known.class_total[of]
            whole[rare] = 0.0
            base = np.add.reduceat(own - base_total, firsts)
            total = np.add.reduceat(whole, firsts)
            n_known = np.add.reduceat(counted[at], firsts)
            rows, ids, held = batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
            zeros = [0] * len(rows)
            # the document's own sums, under a key that is no word and differs by document
            yield record(PARTS, [b" %d" % r for r in rows], rows, ids, held, zeros, zeros, pa.array(sizes), pa.array(n_known), pa.array(base), pa.array(total))
            if len(rare):
                seldom = own_tokens.words.filter(pa.array(at[own_tokens.is_word] < 0)).dictionary_encode()
                owner, histories, kinds = np.repeat(np.arange(len(sizes)), sizes)[rare], len(known.transition), len(seldom.dictionary)
                group, n = np.unique((owner * histories + before[rare]) * kinds + seldom.indices.to_numpy(), return_counts=True)
                rest, word = np.divmod(group, kinds)
                doc, history = np.divmod(rest, histories)
                none, doc = [None] * len(doc), pa.array(doc)
                yield record(PARTS, seldom.dictionary.take(pa.array(word)), *(batch.column(c).take(doc) for c in ("row", "doc_id", "held_out")), pa.array(history, pa.int32()), pa.array(n), none, none, none, none)

    # log10 of what a word outside the head gets from a history and its class, but for its own count; class -1 is that of unknown words
    size = len(model.transition)
    cells = [(h, c, float(model.transition[h, c] - model.class_total[c])) for h in range(size) for c in range(FIRST, size)]
    cells += [(h, -1, float(model.unknown[h]) - math.log10(DELTA)) for h in range(size)]
    cells = F.broadcast(spark.createDataFrame(cells, "history int, class int, cell double"))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "held_out", "text")
    parts = rows.mapInArrow(run, PARTS_DDL).join(words.select("word", F.col("n").alias("c"), "class"), "word", "left").withColumn("class", F.coalesce("class", F.lit(-1))).join(cells, ["history", "class"], "left")
    # a word that no task was sent: its count, known or not, enters both sums alike
    emission = F.log10(F.coalesce("c", F.lit(0)) + F.lit(DELTA))
    seldom = lambda x: F.coalesce(F.sum(F.when(F.col("n") > 0, F.col("n") * x).otherwise(0.0)), F.lit(0.0))
    out = parts.groupBy("row", "doc_id", "held_out").agg(
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.sum("base") + seldom(emission)).alias("base_score"),
        (F.sum("score") + seldom(emission + F.col("cell"))).alias("score"),
    )
    return out.drop("row").withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
