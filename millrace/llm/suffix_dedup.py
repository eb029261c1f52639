"""Exact removal of repeated byte strings with suffix arrays by linear grouping construction.

Every byte within a `LENGTH`-byte string that also starts elsewhere goes. To bring equal strings together without
sorting all suffixes of a corpus, each string of LENGTH bytes has an anchor, its leftmost `GRAM`-gram of the smallest
hash. Equal strings have equal anchors at equal places, so a piece, the stretch of a text whose strings share an
anchor, need only be compared with pieces of an equal anchor. Equal pieces are counted before anything is gathered: all
of a piece that occurs twice goes, and one of each takes part below.

The distinct pieces of an anchor are aligned at it. Columns outside which no two pieces begin to differ are merged to
blocks; a piece becomes a short string of (block, class) symbols that equal another's exactly where the bytes do. A
suffix array of these strings, with its longest common prefixes, tells for every block how far the longest match of
the strings that start there goes.

The array comes from linear grouping construction. Suffixes are grouped by Lyndon prefix: groups are taken in
descending order, and the previous smaller position of each of a group's suffixes moves to a new group behind its own,
those that precede more of the group's suffixes further back. Then one pass over the order places, for each suffix in
turn, the suffixes whose next smaller one it is, at the front of what is left of their group. Nothing is renamed.

An anchor with over `GROUP_LIMIT` distinct pieces is dealt anew: the strings of each piece are halved by where they
start, and each half goes with the bytes that all strings of it contain, until groups are small (at one start, all
of a string is in the key).

Passages, counted in a further column, are strings of `PASSAGE` words that another row of the table holds as well, whatever
their bytes: 51 words can be shorter than 400 bytes, and the space between them can differ. Anchors and pieces are made of word
hashes in the same way. Pieces whose anchor no other document has are left out at once, a piece that another document has counts
whole, and of the rest the strings are compared by their hashes, those of an anchor in one task, or one by one where an anchor
has over `GROUP_LIMIT` distinct pieces.

Defined results. Null text is empty: zero bytes, the digest of nothing. Repeated rows repeat each other's strings. A
null doc_id is kept. Texts below LENGTH bytes lose nothing. Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, dropped, record, texts, written

LENGTH = 400
GRAM = 32
#: Distinct pieces of an anchor that one task compares.
GROUP_LIMIT = 2048
#: Equal pieces beyond so many, and beyond this share of a partition's rows, are a hot key.
HOT_ROWS, HOT_SHARE = 256, 64

SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: The first so many bytes of eight.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
#: Words of a passage, and of the grams that are its anchors.
PASSAGE, WORD_GRAM = 51, 8
#: Strings of words that are compared at once, unless an anchor has more.
PASSAGES_AT_ONCE = 1 << 18
#: Bytes of text whose words are hashed at once, unless a text is longer.
WORDS_AT_ONCE = 1 << 19

PIECES = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("a", pa.int32()), ("rel", pa.int16()), ("size", pa.int16())])
PIECES_DDL = "key long, h long, d long, a int, rel short, size short"
CONTENT = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("a", pa.int32()), ("rel", pa.int16()), ("low", pa.int16()), ("high", pa.int16()), ("piece", pa.binary())])
CONTENT_DDL = "key long, h long, d long, a int, rel short, low short, high short, piece binary"
WORD_PIECES = pa.schema([("key", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("first", pa.int32()), ("words", pa.int16()), ("a", pa.int32()), ("size", pa.int32())])
WORD_PIECES_DDL = "key long, h long, d long, first int, words short, a int, size int"
STARTS = pa.schema([("h", pa.int64()), ("d", pa.int64()), ("low", pa.int16()), ("high", pa.int16())])
STARTS_DDL = "h long, d long, low short, high short"
STRINGS = pa.schema([("w", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("h", pa.int64()), ("d", pa.int64()), ("low", pa.int16())])
STRINGS_DDL = "w long, lo long, hi long, h long, d long, low short"
SPANS = pa.schema([("key", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])
SPANS_DDL = "key long, start int, end int"


def suffix_array(text: list[int]) -> list[int]:
    """The suffix array of a list of non-negative integers, by linear grouping construction."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place, group, size = [0] * n, [0] * n, [0] * n
    at = -1
    for i, p in enumerate(order):
        if not i or text[p] != text[order[i - 1]]:
            at = i
        place[p], group[p] = i, at
        size[at] += 1
    before = [-1] * n
    end = n
    while end:
        start = group[order[end - 1]]
        ahead: dict[int, int] = {}
        for i in sorted(order[start:end]):
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = before[j]
            before[i] = j
            if j >= 0:
                ahead[j] = ahead.get(j, 0) + 1
        by_count: dict[int, list[int]] = {}
        for j, k in ahead.items():
            by_count.setdefault(k, []).append(j)
        for k in sorted(by_count, reverse=True):
            moved: dict[int, int] = {}
            for j in by_count[k]:
                g = group[j]
                last = g + size[g] - 1
                other, here = order[last], place[j]
                order[last], order[here] = j, other
                place[j], place[other] = last, here
                size[g] -= 1
                moved[g] = moved.get(g, 0) + 1
            for g, count in moved.items():
                new = g + size[g]
                for i in range(new, new + count):
                    group[order[i]] = new
                size[new] = count
        end = start
    # second phase: next[g] is the first free place of the group that starts at g
    free, done, out = list(range(n)), [False] * n, [0] * n
    for i in range(-1, n):
        j = (n if i < 0 else out[i]) - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[free[g]] = j
            free[g] += 1
            done[j] = True
            j = before[j]
    return out


def common_prefixes(text: list[int], order: list[int]) -> tuple[list[int], list[int]]:
    """For each rank the longest common prefix with the suffix before it, and each suffix's rank."""
    n = len(text)
    rank, lcp, k = [0] * n, [0] * (n + 1), 0
    for i, p in enumerate(order):
        rank[p] = i
    for i in range(n):
        r = rank[i]
        if r:
            j = order[r - 1]
            while i + k < n and j + k < n and text[i + k] == text[j + k]:
                k += 1
            lcp[r] = k
            k -= k > 0
        else:
            k = 0
    return lcp, rank


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the gram units, bytes or words, from each place on, by doubling."""
    h = (units.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    m = 1
    while m < gram:
        step = min(m, gram - m)
        h = (h[:-step] * np.uint64((0xD6E8FEB86659FD93 * (2 * m + 1)) % (1 << 64) | 1)) ^ (h[step:] + (h[step:] >> np.uint64(29)))
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        m += step
    return h


def least_grams(units: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each string of so many units the place of its leftmost gram of the smallest hash, and the hashes of all grams."""
    window = length - gram + 1
    h = gram_hashes(units, gram)
    least, at, m = h, np.arange(len(h), dtype=np.int32), 1
    while m < window:
        step = min(m, window - m)
        right = least[step:] < least[:-step]
        at = np.where(right, at[step:], at[:-step])
        least = np.where(right, least[step:], least[:-step])
        m += step
    return at, h


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """For each anchor of a text: first and last start of its strings, the anchor's place, its hash."""
    at, h = least_grams(np.frombuffer(text, np.uint8), LENGTH, GRAM)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    return first, np.append(first[1:], len(at)) - 1, at[first], h[at[first]]


def pieces(docs: DataFrame) -> DataFrame:
    """docs: key, text. A row for each piece: the text's key, the anchor's hash, the piece's digest, where it starts, the anchor's place in it, its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out: list[list[np.ndarray]] = [[] for _ in PIECES]
            for key, text in zip(batch.column("key").to_pylist(), texts(batch), strict=True):
                if len(text) < LENGTH:
                    continue
                first, last, at, h = anchors(text)
                view = memoryview(text)
                digest = [xxhash.xxh3_64_intdigest(view[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist(), strict=True)]
                for o, x in zip(out, (np.full(len(first), key), h.view(np.int64), np.array(digest, np.uint64).view(np.int64), first.astype(np.int32), (at - first).astype(np.int16), (last - first + LENGTH).astype(np.int16)), strict=True):
                    o.append(x)
            if out[0]:
                yield record(PIECES, *(pa.array(np.concatenate(o)) for o in out))

    return docs.select("key", "text").mapInArrow(run, PIECES_DDL)


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A hash of each word, and where it starts and ends. Words are what lies between the bytes of SPACE."""
    inside = np.concatenate(([False], ~SPACE[np.frombuffer(text, np.uint8)], [False]))
    edges = np.flatnonzero(inside[1:] != inside[:-1]).astype(np.int32)
    starts, ends = edges[::2], edges[1::2]
    sizes = ends - starts
    # words of up to 16 bytes as two integers and their size; longer ones one by one
    eight = np.ndarray(len(text) + 9, "<u8", text + bytes(16), strides=(1,))
    h = eight[starts] & MASKS[np.minimum(sizes, 8)]
    more = eight[np.minimum(starts + 8, len(text))] & MASKS[np.clip(sizes - 8, 0, 8)]
    for x in (more, sizes.astype(np.uint64)):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = ((h ^ (h >> np.uint64(29))) + x) * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(31)
    for i in np.flatnonzero(sizes > 16).tolist():
        h[i] = xxhash.xxh3_64_intdigest(text[starts[i] : ends[i]])
    return h, starts, ends


def word_pieces(docs: DataFrame) -> DataFrame:
    """docs: key, text. A row for each piece of words: the text's key, the anchor's hash, the piece's digest, its first word, its words, its first byte, its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, WORDS_AT_ONCE):
            several = texts(batch)
            units, starts, ends = words(b" ".join(several))
            byte = np.cumsum([0, *(len(t) + 1 for t in several)])
            word = np.searchsorted(starts, byte)
            of = np.repeat(np.arange(len(several)), np.diff(word))
            # strings that lie in one text
            begin = np.flatnonzero(of[: 1 - PASSAGE] == of[PASSAGE - 1 :])
            if not len(begin):
                continue
            at, h = least_grams(units, PASSAGE, WORD_GRAM)
            at = at[begin]
            new = np.concatenate(([True], at[1:] != at[:-1]))
            first, stop = begin[new], begin[np.append(new[1:], True)] + PASSAGE
            view, of = memoryview(units.tobytes()), of[first]
            digest = [xxhash.xxh3_64_intdigest(view[8 * i : 8 * j]) for i, j in zip(first.tolist(), stop.tolist(), strict=True)]
            keys = batch.column("key").to_numpy()[of]
            yield record(WORD_PIECES, *map(pa.array, (keys, h[at[new]].view(np.int64), np.array(digest, np.uint64).view(np.int64), (first - word[of]).astype(np.int32), (stop - first).astype(np.int16), (starts[first] - byte[of]).astype(np.int32), ends[stop - 1] - starts[first])))

    return docs.select("key", "text").mapInArrow(run, WORD_PIECES_DDL)


def strings_of(pieces: list[bytes], sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces of so many words: the hash of each string of PASSAGE words, its piece, its start there."""
    sizes = np.array(sizes, np.int64)
    n = sizes - PASSAGE + 1
    piece = np.repeat(np.arange(len(sizes)), n)
    start = np.arange(len(piece)) - np.repeat(np.cumsum(n) - n, n)
    return gram_hashes(words(b" ".join(pieces))[0], PASSAGE)[(np.cumsum(sizes) - sizes)[piece] + start], piece, start


def shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def classes(sides: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block ends, for each (block, string) its class or -1 where no other string shares it, and for each string its number of shared blocks."""
    order = sorted(range(len(sides)), key=sides.__getitem__)
    shared = [shared_prefix(sides[i], sides[j]) for i, j in zip(order, order[1:], strict=False)]
    sizes = np.array([len(sides[i]) for i in order])
    ends = np.unique(np.array(shared + sizes.tolist()))
    ends = ends[ends > 0]
    if not len(ends):
        return ends, np.zeros((0, len(sides)), np.int64), np.zeros(len(sides), np.int64)
    of = np.concatenate((np.zeros((len(ends), 1), np.int64), np.cumsum(np.array(shared)[None, :] < ends[:, None], axis=1)), axis=1)
    there = sizes[None, :] >= ends[:, None]
    flat = of + np.arange(len(ends))[:, None] * len(sides)
    count = np.bincount(flat[there], minlength=len(ends) * len(sides))
    kept = there & (count[flat] > 1)
    out = np.empty_like(flat)
    out[:, order] = np.where(kept, flat, -1)
    number = np.empty(len(sides), np.int64)
    number[order] = kept.sum(axis=0)
    return ends, out, number


def repeated_starts(parts: list[bytes], rel: list[int]) -> list[tuple[int, int, int]]:
    """Of distinct pieces with one anchor at rel: (piece, first, last) start, from the anchor, of strings that another piece holds too."""
    left_ends, left, n_left = classes([p[:r][::-1] for p, r in zip(parts, rel, strict=True)])
    right_ends, right, n_right = classes([p[r:] for p, r in zip(parts, rel, strict=True)])
    g = len(parts)
    base = g + left.size
    text: list[int] = []
    heads = []
    for i in range(g):
        heads.append(len(text))
        text += (left[: n_left[i], i][::-1] + g).tolist()
        text += (right[: n_right[i], i] + base).tolist()
        text.append(i)
    lcp, rank = common_prefixes(text, order := suffix_array(text))
    del order
    out = []
    for i in range(g):
        low, high = -rel[i], len(parts[i]) - rel[i] - LENGTH
        for b in range(n_left[i] if n_right[i] else 0, -1, -1):
            # strings that start in left block b - 1, or at the anchor itself
            r = rank[heads[i] + int(n_left[i]) - b]
            reach = max(lcp[r], lcp[r + 1]) - b
            if reach <= 0:
                continue
            far = int(right_ends[reach - 1])
            first, last = (-int(left_ends[b - 1]), -(int(left_ends[b - 2]) if b > 1 else 0) - 1) if b else (0, 0)
            first, last = max(first, low), min(last, high, far - LENGTH)
            if first <= last:
                out.append((i, first, last))
    return out


def compared(content: DataFrame) -> DataFrame:
    """content: distinct pieces of anchors. The spans (key, start, end) of bytes that repeat between pieces of an anchor."""
    rows = content.repartition("h").sortWithinPartitions("h", "key", "a")

    def solve(rows: list[dict]) -> Iterator[tuple[int, int, int]]:
        if len(rows) > 1:
            for i, first, last in repeated_starts([r["piece"] for r in rows], [r["rel"] for r in rows]):
                at = rows[i]["a"] + rows[i]["rel"]
                yield rows[i]["key"], at + first, at + last + LENGTH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for i in range(0, batch.num_rows, 2048):
                for row in batch.slice(i, 2048).to_pylist():
                    if held and row["h"] != held[0]["h"]:
                        found += solve(held)
                        held = []
                    held.append(row)
            if found:
                yield record(SPANS, *map(list, zip(*found, strict=True)))
        if found := list(solve(held)):
            yield record(SPANS, *map(list, zip(*found, strict=True)))

    return rows.select("key", "h", "a", "rel", "piece").mapInArrow(run, SPANS_DDL)


def halved(content: DataFrame) -> DataFrame:
    """Each piece as one or two pieces of half the starts, under a key of the bytes that all strings of that half contain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 2048):
                for r in batch.slice(i, 2048).to_pylist():
                    middle = (r["low"] + r["high"]) // 2
                    for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                        first, last = max(low, -r["rel"]), min(high, len(r["piece"]) - r["rel"] - LENGTH)
                        if low > high or first > last:
                            continue
                        part = r["piece"][r["rel"] + first : r["rel"] + last + LENGTH]
                        core = r["piece"][r["rel"] + high : r["rel"] + low + LENGTH]
                        h = xxhash.xxh3_64_intdigest(core + b"%d %d %d" % (r["h"], low, high))
                        d = xxhash.xxh3_64_intdigest(part)
                        out.append((r["key"], h - (1 << 64) if h >> 63 else h, d - (1 << 64) if d >> 63 else d, r["a"] + r["rel"] + first, -first, low, high, part))
            if out:
                yield record(CONTENT, *map(list, zip(*out, strict=True)))

    return content.mapInArrow(run, CONTENT_DDL)


def of_repeated(every: DataFrame, grouped: DataFrame, by: tuple[str, ...] = ("h", "d"), wanted: str = "n > 1") -> DataFrame:
    """The rows of every whose key, (h, d), grouped counts more than once, or which is wanted otherwise.

    A key that holds a large share of the rows would take them all to one task. There are fewer than HOT_SHARE such keys for each
    partition, so these few are broadcast and their rows stay where they are.
    """
    spark, by = every.sparkSession, list(by)
    total = grouped.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_ROWS, total // (HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    grouped = grouped.filter(wanted)
    hot = F.broadcast(grouped.filter(F.col("n") > most).select(by))
    others = every.join(hot, by, "left_anti").join(grouped.filter(F.col("n") <= most).select(by), by, "left_semi")
    return every.join(hot, by, "left_semi").unionByName(others)


def counted(rows: DataFrame, by: list[str], lo: str, hi: str, *more: Column) -> DataFrame:
    """Groups of rows: their number, and their least and greatest document. Where these differ, two documents have it."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.min(lo).alias("lo"), F.max(hi).alias("hi"), *more)


def shared_words(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """docs: key, text. Word pieces whose anchor two documents have, the distinct ones of them, and spans (key, start, end) of rows that occur twice."""
    every = written(word_pieces(docs), "word-pieces")
    grouped = written(counted(every, ["h"], "key", "key").filter("lo != hi"), "shared-anchors")
    near = written(of_repeated(every, grouped, ("h",), "lo != hi"), "shared-word-pieces")
    # a row that occurs twice has one key: all its words are another's too
    rows = every.groupBy("key").agg(F.sum((F.col("first") == 0).cast("int")).alias("n"), F.max(F.col("first") + F.col("words")).alias("end"))
    twice = written(rows.filter("n > 1").select("key", F.lit(0).alias("start"), "end"), "rows-twice")
    dropped(every, grouped)
    distinct = counted(near, ["h", "d"], "key", "key", F.min(F.struct("key", "a", "size", "words")).alias("one"))
    return near, written(distinct.select("h", "d", "n", "lo", "hi", "one.*"), "distinct-word-pieces"), twice


def passages_within(content: DataFrame) -> DataFrame:
    """content: distinct word pieces. Of those in one document, first and last start (h, d, low, high) of strings that another document has."""

    def solve(rows: list[dict]) -> Iterator[tuple[int, int, int, int]]:
        w, piece, start = strings_of([r["piece"] for r in rows], [r["words"] for r in rows])
        lo, hi = np.array([r["lo"] for r in rows], np.int64), np.array([r["hi"] for r in rows], np.int64)
        order = np.argsort(w, kind="stable")
        heads = np.flatnonzero(np.concatenate(([True], w[order][1:] != w[order][:-1])))
        of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(w))))
        hit = np.empty(len(w), bool)
        hit[order] = (np.minimum.reduceat(lo[piece[order]], heads) != np.maximum.reduceat(hi[piece[order]], heads))[of]
        at = np.flatnonzero(hit & (lo == hi)[piece])
        new = np.concatenate(([True], (np.diff(at) > 1) | (np.diff(piece[at]) > 0)))[: len(at)]
        for i, j in zip(at[new].tolist(), at[np.append(new[1:], True)[: len(at)]].tolist(), strict=True):
            r = rows[piece[i]]
            yield r["h"], r["d"], int(start[i]), int(start[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        strings = 0
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                for row in batch.slice(i, 2048).to_pylist():
                    if strings > PASSAGES_AT_ONCE and row["h"] != held[-1]["h"]:
                        if found := list(solve(held)):
                            yield record(STARTS, *map(list, zip(*found, strict=True)))
                        held, strings = [], 0
                    held.append(row)
                    strings += row["words"] - PASSAGE + 1
        if held and (found := list(solve(held))):
            yield record(STARTS, *map(list, zip(*found, strict=True)))

    rows = content.select("h", "d", "lo", "hi", "words", "piece").repartition("h").sortWithinPartitions("h")
    return rows.mapInArrow(run, STARTS_DDL)


def passages_one_by_one(content: DataFrame) -> DataFrame:
    """What passages_within() tells, with a row for each string, so that no anchor's pieces meet in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                w, piece, start = strings_of(part.column("piece").to_pylist(), part.column("words").to_pylist())
                yield record(STRINGS, pa.array(w.view(np.int64)), *(part.column(c).take(pa.array(piece)) for c in ("lo", "hi", "h", "d")), pa.array(start.astype(np.int16)))

    strings = written(content.select("h", "d", "lo", "hi", "words", "piece").mapInArrow(run, STRINGS_DDL), "word-strings")
    grouped = written(counted(strings, ["w"], "lo", "hi"), "distinct-word-strings")
    out = written(of_repeated(strings.filter("lo = hi"), grouped, ("w",), "lo != hi").select("h", "d", "low", F.col("low").alias("high")), "repeated-word-strings")
    dropped(strings, grouped)
    return out


def passage_spans(near: DataFrame, grouped: DataFrame, content: DataFrame, group_limit: int) -> DataFrame:
    """near, grouped: of shared_words(). content: distinct pieces of anchors that have several. Spans (key, start, end) of words."""
    whole = of_repeated(near, grouped, wanted="lo != hi")
    large = written(content.groupBy("h").count().filter(F.col("count") > group_limit).select("h"), "large-word-anchors")
    starts = written(passages_within(content.join(large, "h", "left_anti")), "repeated-words")
    if not large.isEmpty():
        starts = starts.unionByName(passages_one_by_one(content.join(large, "h", "left_semi")))
    parts = near.join(starts, ["h", "d"])
    span = lambda rows, low, end: rows.select("key", low.alias("start"), end.alias("end"))
    first = F.col("first")
    return written(span(whole, first, first + F.col("words")).unionByName(span(parts, first + F.col("low"), first + F.col("high") + PASSAGE)), "repeated-word-pieces")


def repeated_spans(docs: DataFrame, group_limit: int = GROUP_LIMIT, *, passages: bool) -> DataFrame:
    """docs: key, text. Spans (key, in_words, start, end) that cover exactly the bytes to remove and, if passages are asked for, the words of passages; they may overlap."""
    if passages:
        near, distinct, twice = shared_words(docs)
    every = written(pieces(docs), "pieces")
    grouped = every.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a", "rel", "size")).alias("one"))
    grouped = written(grouped.select("h", "d", "n", "one.*"), "distinct-pieces")
    span = lambda rows, size: written(rows.select("key", F.col("a").alias("start"), (F.col("a") + size).alias("end")), "repeated-pieces")
    found = [span(of_repeated(every, grouped), F.col("size"))]
    dropped(every)
    several = grouped.groupBy("h").count().filter("count > 1").select("h")
    need = grouped.join(several, "h", "left_semi").select("key", "h", "d", "a", "rel", "size")
    cut = F.expr("substring(cast(text as binary), a + 1, size)")
    low, high = F.lit(GRAM - LENGTH).cast("short").alias("low"), F.lit(0).cast("short").alias("high")
    if passages:  # texts are moved once for both
        several = distinct.groupBy("h").count().filter("count > 1").select("h")
        of_words = distinct.join(several, "h", "left_semi").select("key", "h", "d", "a", "size", "words", "lo", "hi")
        need = need.unionByName(of_words, allowMissingColumns=True)
        content = written(docs.join(need, "key").select("key", "h", "d", "a", "rel", low, high, "words", "lo", "hi", cut.alias("piece")).dropDuplicates(["h", "d", "words"]), "piece-contents")
        of_passages = passage_spans(near, distinct, content.filter("words is not null"), group_limit)
        dropped(near, distinct)
        both, content = content, content.filter("words is null").select(*CONTENT.names)
        content.written_to = both.written_to
    else:
        content = written(docs.join(need, "key").select("key", "h", "d", "a", "rel", low, high, cut.alias("piece")).dropDuplicates(["h", "d"]), "piece-contents")
    dropped(grouped)
    while True:
        large = written(content.groupBy("h").count().filter(F.col("count") > group_limit).select("h"), "large-anchors")
        if large.isEmpty():
            found.append(written(compared(content), "repeated-parts"))
            dropped(content)
            break
        found.append(written(compared(content.join(large, "h", "left_anti")), "repeated-parts"))
        every = written(halved(content.join(large, "h", "left_semi").select(*CONTENT.names)), "halved-pieces")
        dropped(content)
        grouped = every.groupBy("h", "d").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("key", "a")).alias("one"))
        grouped = written(grouped.select("h", "d", "n", "one.*"), "distinct-pieces")
        found.append(span(of_repeated(every, grouped), F.length("piece")))
        several = grouped.groupBy("h").count().filter("count > 1").select("h")
        need = grouped.join(several, "h", "left_semi").select("key", "a", "h", "d")
        content = written(every.join(need, ["key", "a", "h", "d"], "left_semi").select(*CONTENT.names), "piece-contents")
        dropped(every, grouped)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    out = out.withColumn("in_words", F.lit(False))
    return out.unionByName(of_passages.unionByName(twice).withColumn("in_words", F.lit(True))) if passages else out


def covered(spans: list[tuple[int, int]]) -> int:
    """How much spans cover; they may overlap."""
    total = end = 0
    for i, j in sorted(spans):
        total += max(0, j - max(i, end))
        end = max(end, j)
    return total


def removal(text: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left."""
    removed = runs = at = 0
    kept = []
    end = -1
    for i, j in sorted(spans):
        if i > end:
            kept.append(text[at:i])
            runs += 1
            removed += j - i
            at = end = j
        elif j > end:
            removed += j - end
            at = end = j
    kept.append(text[at:])
    return removed, runs, b"".join(kept)


def deduplicated(docs: DataFrame, with_text: bool = False, passages: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256; passages: also `n_passage_words`, the words in passages that other documents have; with_text: also `kept`, the bytes that are left."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.xxhash64("doc_id", "text"))
    spans = repeated_spans(rows.select("key", "text"), passages=passages).groupBy("key").agg(F.collect_set(F.struct("in_words", "start", "end")).alias("spans"))
    joined = rows.join(spans, "key", "left").select("doc_id", "text", "spans")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_bytes", "n_removed", "n_spans")), ("kept_sha256", pa.string()), *([("n_passage_words", pa.int64())] if passages else []), *([("kept", pa.binary())] if with_text else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            out = []
            for doc_id, text, own in zip(batch.column("doc_id").to_pylist(), texts(batch), batch.column("spans").to_pylist(), strict=True):
                of = [[(s["start"], s["end"]) for s in own or () if s["in_words"] == kind] for kind in (False, True)]
                removed, runs, kept = removal(text, of[0])
                out.append((doc_id, len(text), removed, runs, hashlib.sha256(kept).hexdigest(), *([covered(of[1])] if passages else []), *([kept] if with_text else [])))
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_passage_words long" * passages + ", kept binary" * with_text)
