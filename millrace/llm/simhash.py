"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

A fingerprint sums the 64 bits of the XXH64 (seed 42) of every 3-word shingle. Equal fingerprints become one node. Two
nodes at a Hamming distance of at most `RADIUS` = 3 agree on at least one of the four blocks that any bit set is cut
into, so nodes are dealt to shards by (block, block value); a shard with over `SHARD_LIMIT` nodes is dealt anew by four
blocks of the bits that it hasn't used yet, which is exact for the same reason, and ends: six times dealt, the nodes of
a shard differ in 12 bits at most, so there are no more than 4096. Each shard gets a BK-tree (children keyed
by their integer distance to the parent); a search follows only edges within the radius. A shard returns a spanning
forest of the links that it found (at most a row for each node), and the forests are joined into components.

A tree travels with its shard to the task that searches it. Broadcasting all trees, at once or in waves, would take the
fingerprints of all documents through the driver, so shards replace that.

`near_duplicates` serves the corpus pipeline: it connects all texts whose sets of `WIDE_SHINGLE` = 5 word shingles, as hashes of 64
bits, have a Jaccard similarity of `SIMILARITY` = 0.8 or more. First, texts are dealt by `WAYS` least shingle hashes, each
shard's BK-tree over SimHash fingerprints is searched within `WIDE_RADIUS` bits, and a spanning forest of the links found is
confirmed on the whole sets. That brings nearly all groups together, at m - 1 sets compared for a group of m, but can miss links:
a shard of over `WIDE_LIMIT` texts is cut by chance, and the forest may hold links that aren't confirmed.

Then comes an exact step. Sets are written in one order of all shingles, frequent ones last (any order will do; which are frequent is
read off a sample). Of two sets that are similar, the first n - ceil(0.8 n) + 1 of each have a shingle in common. All these
prefixes are gathered by shingle. Where texts of different components share one, all such pairs are compared, block by block if there are
many: by their sizes and by parity bitmaps, whose differing bits are never more than the shingles in which the sets differ, so that
no similar pair is passed over, and then on the whole sets. Of the shingles that a pair shares, the smallest reports it: the others see
it among the `LISTED` least of both texts, or report the pair again. Only the pairs that pass the bitmaps move sets.

Defined results. Null text is empty text: no words, fingerprint zero, linked like any other. Repeated rows each give a
row. A null doc_id gets a fingerprint and the component of its fingerprint; the component's name is the smallest
doc_id that isn't null (null if there is none). Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, dropped, record, small_batches, texts, trimmed, written

RADIUS = 3
SEED = 42
SHINGLE = 3
SHARD_LIMIT = 4096

WIDE_SHINGLE, SIMILARITY, WIDE_RADIUS = 5, 0.8, 16
WAYS = 4
WIDE_LIMIT = 512
#: About so many texts tell which shingles are frequent: those of OFTEN of them, FREQUENT at most.
SAMPLE, OFTEN, FREQUENT = 10_000, 6, 200_000
#: The most bits of a parity bitmap.
PARITY_BITS = 1 << 14
#: Shingles of prefixes that a task gathers at a time.
BUCKET = 250_000
#: The least shared shingles of a text that tell in which shard its pairs are compared.
LISTED = 8
#: Up to so many rows whose sets are asked for are broadcast.
FEW_ROWS = 2_000_000
#: Bytes of text that are sketched at a time.
SKETCH_BYTES = 1 << 20

FINGERPRINTS = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])
EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes) -> int:
    """The fingerprint of one text (ASCII letters lower-cased) as an unsigned integer."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(line, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        view, digest = memoryview(line), xxhash.xxh64_intdigest
        hashes = [digest(view[i:j], SEED) for i, j in zip(starts[: 1 - SHINGLE].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    """Bit by bit: 1 if set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and its fingerprint as a signed 64-bit integer, a row for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values = np.array([fingerprint(t) for t in texts(batch)], np.uint64).astype(np.int64)
            yield record(FINGERPRINTS, batch.column("doc_id"), pa.array(values))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def tree_links(values: np.ndarray, shard: np.ndarray, radius: int = RADIUS, block: int = 1 << 13) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of all links within each shard (shard: sorted, values: distinct within a shard), each pair once.

    One BK-tree for each shard, all built together level by level: the first value that reaches a place becomes its
    node, the others go on below it, parted by their distance to it. Searches run together too: a frontier of
    (query, node) pairs, from which only edges within the radius of the query's distance are followed.
    """
    n = len(values)
    values = values.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1]))) if n else np.zeros(0, np.int64)
    owner = np.repeat(first, np.diff(np.append(first, n)))
    parents, edges, children = [], [], []
    left = np.setdiff1d(np.arange(n), first, assume_unique=True)
    at = owner[left]
    while len(left):
        far = np.bitwise_count(values[left] ^ values[at]).astype(np.int64)
        key = at * 65 + far
        order = np.argsort(key, kind="stable")
        left, key = left[order], key[order]
        new = np.concatenate(([True], key[1:] != key[:-1]))
        heads = left[new]
        parents.append(key[new] // 65)
        edges.append(key[new] % 65)
        children.append(heads)
        at = np.repeat(heads, np.diff(np.append(np.flatnonzero(new), len(left))))[~new]
        left = left[~new]
    if not children:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(parents) * 65 + np.concatenate(edges)
    order = np.argsort(key, kind="stable")
    key, child = key[order], np.concatenate(children)[order]
    a, b = [], []
    for low in range(0, n, block):
        query = np.arange(low, min(n, low + block))
        node = owner[query]
        while len(query):
            far = np.bitwise_count(values[query] ^ values[node]).astype(np.int64)
            hit = (far <= radius) & (query < node)
            a.append(query[hit])
            b.append(node[hit])
            start = np.searchsorted(key, node * 65 + np.maximum(far - radius, 0))
            count = np.searchsorted(key, node * 65 + np.minimum(far + radius, 64), side="right") - start
            query = np.repeat(query, count)
            node = child[np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())]
    return np.concatenate(a), np.concatenate(b)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node of its component, by repeated hooking and pointer jumping."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        other = ra != rb
        a, b, ra, rb = a[other], b[other], ra[other], rb[other]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def blocks_of(used: list[int]) -> list[list[int]]:
    """The bits not used yet, cut into four blocks of nearly equal size."""
    free = [i for i in range(64) if i not in used]
    cut = [len(free) * k // (RADIUS + 1) for k in range(RADIUS + 2)]
    return [free[cut[k] : cut[k + 1]] for k in range(RADIUS + 1)]


def blocks_left(level: int) -> list[int]:
    """The bits that a shard hasn't used after so many times dealt, as many as any other shard's or one more."""
    used: list[int] = []
    for _ in range(level):
        used += min(blocks_of(used), key=len)
    return [i for i in range(64) if i not in used]


def paths(level: int) -> list[list[int]]:
    """The bits that each of the 4 ** level ways of dealing a node compares."""
    out: list[list[int]] = [[]]
    for _ in range(level):
        out = [p + block for p in out for block in blocks_of(p)]
    return out


def masks(level: int) -> list[int]:
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    return [signed(sum(1 << i for i in p)) for p in paths(level)]


def shard_forests(keyed: DataFrame) -> DataFrame:
    """keyed: way int, part long, node long. A row (a, b) with a > b linked for each node that isn't the first of its component in a shard."""
    rows = keyed.repartition("way", "part").sortWithinPartitions("way", "part", "node")

    def solve(way: np.ndarray, part: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        new = np.concatenate(([True], (way[1:] != way[:-1]) | (part[1:] != part[:-1])))
        shard = np.cumsum(new) - 1
        alone = np.bincount(shard)[shard] == 1
        node, shard = node[~alone], shard[~alone]
        root = forest(len(node), *tree_links(node.view(np.uint64), shard))
        linked = root != np.arange(len(node))
        return record(EDGES, pa.array(node[linked]), pa.array(node[root[linked]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate((h, c.to_numpy(zero_copy_only=False).astype(np.int64))) for h, c in zip(held, batch.columns, strict=True)]
            if not len(now[0]):
                continue
            last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
            cut = last[-1] + 1 if len(last) else 0
            if cut:
                yield solve(*(x[:cut] for x in now))
            held = [x[cut:] for x in now]
        if len(held[0]):
            yield solve(*held)

    return rows.select("way", "part", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, shard_limit: int = SHARD_LIMIT) -> DataFrame:
    """nodes: distinct node long. Rows (a, b) whose components are those of all links within the radius."""
    found, shard_limit = [], max(shard_limit, 1)
    ways = [F.struct(F.lit(i).alias("way"), F.col("node").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks(1))]
    keyed = nodes.select("node", F.explode(F.array(*ways)).alias("k")).select("k.way", "k.part", "node")
    for level in itertools.count(1):
        large = written(keyed.groupBy("way", "part").count().filter(F.col("count") > shard_limit).select("way", "part"), "simhash-large")
        if large.isEmpty() or len(blocks_left(level)) <= 12:
            found.append(shard_forests(keyed))
            break
        found.append(shard_forests(keyed.join(large, ["way", "part"], "left_anti")))
        below, kids = masks(level + 1), RADIUS + 1
        finer = F.transform(F.sequence(F.lit(0), F.lit(kids - 1)), lambda i: F.struct((F.col("way") * kids + i).alias("way"), F.col("node").bitwiseAND(F.element_at(F.array(*map(F.lit, below)), (F.col("way") * kids + i + 1).cast("int"))).alias("part")))
        keyed = keyed.join(large, ["way", "part"], "left_semi").select("node", F.explode(finer).alias("k")).select(F.col("k.way").cast("int").alias("way"), "k.part", "node")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b long. Rows (node, root) for the nodes of edges; root is the component's smallest node.

    Alternates the large-star and small-star steps, whose edge count never grows; each round is a written table.
    """
    edges = written(edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).filter(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).filter(F.col("a") != F.col("b")).distinct()
        edges = written(small, "components")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("long")), F.countDistinct("a")).first()
        if now == before:
            break
        before = now
    return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))


def simhash_groups(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id (smallest doc_id reachable over links within the radius)."""
    prints = written(fingerprints(docs), "simhash")
    nodes = prints.groupBy(F.col("fingerprint").alias("node")).agg(F.min("doc_id").alias("least"))
    roots = components(links(nodes.select("node")))
    named = nodes.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = named.select("node", "root").join(names, "root").select(F.col("node").alias("fingerprint"), "component_id")
    return prints.join(known, "fingerprint").select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


SKETCHES = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("same", pa.binary()), ("print", pa.int64()), ("n", pa.int32()), ("least", pa.list_(pa.int64())), ("parity", pa.binary()), ("shingles", pa.binary())])
SKETCHES_DDL = "row long, doc_id long, same binary, print long, n int, least array<long>, parity binary, shingles binary"
BUCKETS = pa.schema([("bucket", pa.int64()), ("base", pa.int64()), ("shingles", pa.binary()), ("rows", pa.binary())])
SHARED = pa.schema([("shingle", pa.int64()), ("row", pa.int64())])
#: Odd multipliers of the least hashes, a fixed series.
MULTIPLIERS = (np.random.default_rng(SEED).integers(0, 1 << 63, WAYS, np.uint64) << np.uint64(1)) | np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def shingle_hashes(words: np.ndarray, size: int = WIDE_SHINGLE) -> np.ndarray:
    """The distinct hashes of a text's shingles, from its words' hashes; fewer words than a shingle are one."""
    if not len(words):
        return words
    width = min(size, len(words))
    h = np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        h = mixed(h * np.uint64(0xBF58476D1CE4E5B9) + words[k : len(words) - width + 1 + k])
    return np.unique(h)


def least_hashes(hashes: np.ndarray) -> list[int]:
    """For each multiplier the least of the hashes after it."""
    least = np.full(len(MULTIPLIERS), np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 14):
        least = np.minimum(least, mixed(hashes[i : i + (1 << 14), None] * MULTIPLIERS).min(axis=0))
    return least.view(np.int64).tolist()


def shingle_sets(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """Each text's words and distinct shingle hashes, ascending."""
    per_doc = [t.lower().split() for t in texts(batch)]
    coded = pa.array(list(itertools.chain.from_iterable(per_doc)), pa.binary()).dictionary_encode()
    own = np.array([xxhash.xxh3_64_intdigest(w, SEED) for w in coded.dictionary.to_pylist()], np.uint64)
    words, at = own[coded.indices.to_numpy()], 0
    for w in per_doc:
        yield w, shingle_hashes(words[at : at + len(w)])
        at += len(w)


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles that many texts of a sample hold, ascending. They only decide the order of shingles, so a sample loses nothing."""
    every = max(1, docs.count() // SAMPLE)
    sample = docs.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(every)) == 0)
    schema = pa.schema([("shingle", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, SKETCH_BYTES):
            yield record(schema, pa.array(np.concatenate([h for _, h in shingle_sets(batch)]).view(np.int64)))

    counts = sample.select("text").mapInArrow(run, "shingle long").groupBy("shingle").count().filter(F.col("count") >= OFTEN)
    with small_batches(docs.sparkSession):
        return np.sort(np.array([r["shingle"] for r in counts.orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()], np.int64).view(np.uint64))


def parity(hashes: np.ndarray) -> bytes:
    """Bit by bit, of the shingles that fall on it the parity: as many bits as shingles, to the next power of two."""
    bits = min(max(64, 1 << (max(len(hashes), 1) - 1).bit_length()), PARITY_BITS)
    return np.packbits((np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def sketches(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """row, doc_id, a digest of the words, the fingerprint, number, least hashes and parity bitmap of the distinct shingles, and all of them, the frequent ones last; a row for each row."""

    def ordered(h: np.ndarray) -> np.ndarray:
        if not len(frequent):
            return h
        often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
        return np.concatenate((h[~often], h[often]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, SKETCH_BYTES):
            out = []
            for row, doc_id, (w, h) in zip(batch.column("row").to_pylist(), batch.column("doc_id").to_pylist(), shingle_sets(batch), strict=True):
                value = majority(h)
                out.append((row, doc_id, xxhash.xxh3_128_digest(b" ".join(w), SEED), value - (1 << 64) if value >> 63 else value, len(h), least_hashes(h), parity(h), ordered(h).astype("<u8").tobytes()))
            if out:
                yield record(SKETCHES, *map(list, zip(*out, strict=True)))

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), "text").mapInArrow(run, SKETCHES_DDL)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sets; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def by_shard(rows: DataFrame, columns: list[str], solve, ddl: str, schema: pa.Schema) -> DataFrame:
    """solve(list of columns as Python lists) of each shard of rows, whose column `shard` deals them; a shard is held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for i in range(0, batch.num_rows, 512):
                for r in batch.slice(i, 512).to_pylist():
                    if held and r["shard"] != held[0]["shard"]:
                        out += solve(held)
                        held = []
                    held.append(r)
            if out:
                yield record(schema, *map(list, zip(*out, strict=True)))
        if held and (out := solve(held)):
            yield record(schema, *map(list, zip(*out, strict=True)))
        trimmed()

    return rows.select("shard", *columns).repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(run, ddl)


def wide_links(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a shard's texts that lie within the wide radius, and whose numbers of shingles allow the similarity, the closest first."""
    values, sizes = np.array([r["print"] for r in rows]).view(np.uint64), np.array([r["n"] for r in rows])
    distinct, back = np.unique(values, return_inverse=True)
    a, b = tree_links(distinct, np.zeros(len(distinct), np.int64), WIDE_RADIUS)
    members = np.argsort(back, kind="stable")
    first = np.searchsorted(back[members], np.arange(len(distinct) + 1))
    alone = np.diff(first) == 1
    plain = alone[a] & alone[b]
    pairs = [(members[first[a[plain]]], members[first[b[plain]]])]
    # texts of one fingerprint: all pairs with each other, and with all those of a fingerprint that is near
    for x in np.flatnonzero(~alone).tolist():
        own = members[first[x] : first[x + 1]]
        i, j = np.triu_indices(len(own), 1)
        pairs.append((own[i], own[j]))
    for x, y in zip(a[~plain].tolist(), b[~plain].tolist(), strict=True):
        left, right = members[first[x] : first[x + 1]], members[first[y] : first[y + 1]]
        pairs.append((np.repeat(left, len(right)), np.tile(right, len(left))))
    left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
    fits = sized(sizes, left, right)
    left, right = left[fits], right[fits]
    near = np.argsort(np.bitwise_count(values[left] ^ values[right]), kind="stable")
    return left[near], right[near]


def sized(n: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the numbers of shingles of pairs allow the similarity."""
    return 5 * np.minimum(n[a], n[b]).astype(np.int64) >= 4 * np.maximum(n[a], n[b]).astype(np.int64)


def folded(bitmap: bytes, size: int) -> np.ndarray:
    """A parity bitmap as one of fewer bytes."""
    out = np.frombuffer(bitmap, "<u8")
    while len(out) * 8 > size:
        out = out[: len(out) // 2] ^ out[len(out) // 2 :]
    return out


def possible(n: np.ndarray, bitmaps: list[bytes], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether pairs may have the similarity: their sets then differ in a ninth of their sizes' sum at most, and their bitmaps in no more bits."""
    out, size = np.zeros(len(a), bool), np.array([len(m) for m in bitmaps], np.int64)
    least = np.minimum(size[a], size[b])
    for s in np.unique(least).tolist():
        of = np.flatnonzero(least == s)
        members = np.unique(np.concatenate((a[of], b[of])))
        own = np.stack([folded(bitmaps[i], s) for i in members.tolist()])
        step = max(1, (1 << 20) // (s // 8))
        for i in range(0, len(of), step):
            x, y = a[of[i : i + step]], b[of[i : i + step]]
            far = np.bitwise_count(own[np.searchsorted(members, x)] ^ own[np.searchsorted(members, y)]).sum(axis=1, dtype=np.int64)
            out[of[i : i + step]] = 9 * far <= n[x].astype(np.int64) + n[y]
    return out


def likely(rows: list[dict]) -> list[tuple[int, int]]:
    """A spanning forest of a shard's links within the wide radius that the bitmaps allow."""
    if len(rows) < 2:
        return []
    a, b = wide_links(rows)
    good = possible(np.array([r["n"] for r in rows]), [r["parity"] for r in rows], a, b)
    of, out = np.arange(len(rows)), []
    for x, y in zip(a[good].tolist(), b[good].tolist(), strict=True):
        if of[x] != of[y]:
            low, high = sorted((of[x], of[y]))
            of[of == high] = low
            out.append((max(rows[x]["row"], rows[y]["row"]), min(rows[x]["row"], rows[y]["row"])))
    return out


def sharing(sets: DataFrame, total: int) -> DataFrame:
    """sets: row, same, n and shingles, total: the length of all prefixes. (shingle, row) of the shingles that the prefixes of two or more hold; of texts of the same words at least the one of the smallest row."""
    buckets = total // BUCKET + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column("n").to_numpy().astype(np.int64)
            row, sets = batch.column("row").to_numpy(), batch.column("shingles")
            first: dict[bytes, int] = {}
            for r, d in zip(row.tolist(), batch.column("same").to_pylist(), strict=True):
                first[d] = min(r, first.get(d, r))
            once = np.isin(row, np.fromiter(first.values(), np.int64, len(first)))
            size = np.where((n > 0) & once, n // 5 + 1, 0)  # n - ceil(4 n / 5) + 1
            for part in np.unique(row >> 33).tolist():
                of = np.flatnonzero((row >> 33 == part) & (size > 0))
                if not len(of):
                    continue
                h = np.concatenate([np.frombuffer(sets[i].as_buffer(), "<u8", k) for i, k in zip(of.tolist(), size[of].tolist(), strict=True)])
                base, at = part << 33, np.repeat(row[of] - (part << 33), size[of]).astype("<u4")
                to = (mixed(h) % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                cut = np.searchsorted(to[order], np.arange(buckets + 1))
                h, at = h[order], at[order]
                full = np.flatnonzero(np.diff(cut)).tolist()
                yield record(BUCKETS, full, [base] * len(full), [h[cut[k] : cut[k + 1]].tobytes() for k in full], [at[cut[k] : cut[k + 1]].tobytes() for k in full])
        trimmed()

    def shared(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        h = np.concatenate([np.frombuffer(x, "<u8") for _, x, _ in rows])
        row = np.concatenate([np.frombuffer(y, "<u4").astype(np.int64) + base for base, _, y in rows])
        order = np.argsort(h, kind="stable")
        h, row = h[order], row[order]
        again = h[1:] == h[:-1]
        several = np.concatenate((again, [False])) | np.concatenate(([False], again))
        return record(SHARED, pa.array(h[several].view(np.int64)), pa.array(row[several]))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for i, bucket in enumerate(batch.column("bucket").to_pylist()):
                if held and bucket != now:
                    yield shared(held)
                    held = []
                now = bucket
                held.append(tuple(batch.column(c)[i].as_py() for c in ("base", "shingles", "rows")))
        if held:
            yield shared(held)
        trimmed()

    # a prefix only goes to Python
    prefix = F.expr("substring(shingles, 1, 8 * (n div 5 + 1))").alias("shingles")
    dealt = sets.select("row", "same", "n", prefix).mapInArrow(deal, "bucket long, base long, shingles binary, rows binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(gather, "shingle long, row long")


def pairs_apart(rows: DataFrame) -> DataFrame:
    """rows: shard, row, root, n, parity, shingle, own, inner, least. (a, b) of a shard's texts of different roots that the bitmaps allow; a shard is held whole.

    Texts of one block (own) are paired where inner says so. A pair that shares one of its least shingles is left to the smallest one's shard.
    """

    def solve(shard: np.ndarray, row: np.ndarray, root: np.ndarray, n: np.ndarray, shingle: np.ndarray, own: np.ndarray, inner: np.ndarray, least: np.ndarray, bitmaps: list[bytes]) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate(([True], shard[1:] != shard[:-1])))
        count = np.diff(np.append(first, len(shard)))
        for size in np.unique(count[count > 1]).tolist():
            i, j = np.triu_indices(size, 1)
            starts, step = first[count == size], max(1, (1 << 18) // len(i))
            for k in range(0, len(starts), step):
                a, b = ((starts[k : k + step, None] + x).ravel() for x in (i, j))
                fits = (root[a] != root[b]) & ((own[a] != own[b]) | (inner[a] > 0)) & sized(n, a, b)
                a, b = a[fits], b[fits]
                if len(a):
                    good = possible(n, bitmaps, a, b)
                    a, b = a[good], b[good]
                    here = ~shared_before(least, shingle, a, b)
                    a, b = row[a[here]], row[b[here]]
                    yield record(EDGES, pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ("shard", "row", "root", "n", "shingle", "own", "inner")
        held, bitmaps = [np.zeros(0, np.int64)] * len(columns) + [np.zeros((0, LISTED), np.int64)], []
        for batch in batches:
            if not batch.num_rows:
                continue
            listed = batch.column("least")
            least = np.full((batch.num_rows, LISTED), np.iinfo(np.int64).max)
            least[np.arange(LISTED) < pc.list_value_length(listed).to_numpy()[:, None]] = listed.flatten().to_numpy()
            held = [np.concatenate((h, x)) for h, x in zip(held, [*(batch.column(c).to_numpy().astype(np.int64) for c in columns), least], strict=True)]
            bitmaps += batch.column("parity").to_pylist()
            cut = int(np.searchsorted(held[0], held[0][-1]))
            if cut:
                yield from solve(*(x[:cut] for x in held), bitmaps[:cut])
                held, bitmaps = [x[cut:] for x in held], bitmaps[cut:]
        if len(bitmaps):
            yield from solve(*held, bitmaps)
        trimmed()

    return rows.select("shard", "row", "root", "n", "shingle", "own", "inner", "parity", "least").repartition("shard").sortWithinPartitions("shard", "row").mapInArrow(run, "a long, b long")


def shared_before(least: np.ndarray, shingle: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the least shingles of pairs have one in common that is smaller than that of the pairs' shard."""
    out = np.zeros(len(a), bool)
    for k in range(LISTED):
        own = least[a, k]
        smaller = own < shingle[a]
        for m in range(LISTED):
            out |= smaller & (own == least[b, m])
    return out


def wide_edges(reps: DataFrame, sets: DataFrame, limit: int = WIDE_LIMIT) -> DataFrame:
    """reps: (row, print, n, least, parity) of distinct texts, sets: (row, same, n, shingles) of these or more, both written tables. Links (a, b) between rows with the similarity, which connect all that it connects."""
    nodes = reps.select("row", "print", "n", "parity")

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs that have the similarity."""
        pairs = written(pairs.distinct(), "near-pairs")
        need = written(pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row"))).distinct(), "near-asked")
        few = need.count() <= FEW_ROWS
        own = written(sets.select("row", "shingles").join(F.broadcast(need) if few else need, "row", "left_semi"), "near-sets", wide=True)

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                same = [jaccard(*(np.frombuffer(v.as_buffer(), "<u8") for v in pair)) >= SIMILARITY for pair in zip(batch.column("left"), batch.column("right"), strict=True)]
                yield batch.select(["a", "b"]).filter(pa.array(same, pa.bool_()))
            trimmed()

        both = pairs.join(own.select(F.col("row").alias("a"), F.col("shingles").alias("left")), "a").join(own.select(F.col("row").alias("b"), F.col("shingles").alias("right")), "b")
        out = written(both.select("a", "b", "left", "right").mapInArrow(compare, "a long, b long"), "near-links")
        dropped(pairs, need, own)
        return out

    # nearly all links: shards of a least hash, large ones cut by chance, another way for each hash
    keyed = reps.select("row", F.posexplode("least").alias("way", "key")).select(F.xxhash64("way", "key").alias("shard"), "row")
    large = F.ceil(F.col("count") * 2 / limit).cast("long")
    cut = F.when(F.col("count") > limit, F.pmod(F.xxhash64("row", "shard"), large)).otherwise(0)
    keyed = keyed.join(keyed.groupBy("shard").count().filter("count > 1"), "shard").select(F.xxhash64("shard", cut).alias("shard"), "row")
    first = confirmed(by_shard(keyed.join(nodes, "row"), ["row", "print", "n", "parity"], likely, "a long, b long", EDGES))
    # all that are left: texts of different components whose prefixes share a shingle
    total = reps.agg(F.coalesce(F.sum(F.floor(F.col("n") / 5) + 1), F.lit(0))).first()[0]
    shared = written(sharing(sets, total), "near-shared")
    roots = nodes.select("row").join(components(first).withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("root", "row").alias("root"))
    placed = written(shared.join(roots, "row").select("shingle", "row", "root"), "near-placed")
    dropped(shared)
    apart = placed.groupBy("shingle").agg(F.count(F.lit(1)).alias("count"), F.min("root").alias("least"), F.max("root").alias("most")).filter("least < most").select("shingle", "count")
    apart = written(placed.join(apart, "shingle"), "near-apart")
    dropped(placed)
    few = apart.filter(F.col("count") <= limit).select(F.xxhash64("shingle").alias("shard"), "row", "root", "shingle", F.lit(0).cast("long").alias("own"), F.lit(1).alias("inner"))
    # blocks of half the limit, each pair of them a shard; those of one block meet where the other is the next
    own = F.pmod(F.xxhash64("row"), F.col("blocks"))
    many = apart.filter(F.col("count") > limit).withColumn("blocks", large).select("shingle", "row", "root", "blocks", own.alias("own"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
    inner = (F.col("other") == (F.col("own") + 1) % F.col("blocks")).cast("int").alias("inner")
    many = many.filter("own != other").select(F.xxhash64("shingle", F.least("own", "other"), F.greatest("own", "other")).alias("shard"), "row", "root", "shingle", "own", inner)
    least = apart.groupBy("row").agg(F.slice(F.sort_array(F.collect_list("shingle")), 1, LISTED).alias("least"))
    second = confirmed(pairs_apart(few.unionByName(many).join(nodes.drop("print").join(least, "row"), "row")))
    dropped(apart)
    return first.unionByName(second)


def near_duplicates(docs: DataFrame, limit: int = WIDE_LIMIT) -> DataFrame:
    """doc_id and the smallest doc_id that isn't null of its group, a row for each row: documents connected by similarity, texts of the same words among them."""
    prints = written(sketches(docs, frequent_shingles(docs)), "near-sketches", wide=True)
    same = written(prints.groupBy("same").agg(F.min("row").alias("row"), F.min("doc_id").alias("least_id")), "near-texts")
    reps = written(prints.select("row", "print", "n", "least", "parity").join(same.select("row"), "row", "left_semi"), "near-nodes")
    roots = components(wide_edges(reps, prints.select("row", "same", "n", "shingles"), limit))
    named = same.join(roots.withColumnRenamed("node", "row"), "row", "left").select("same", "least_id", F.coalesce("root", "row").alias("root"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    out = written(prints.select("doc_id", "same").join(named.select("same", "root").join(names, "root"), "same").select("doc_id", "component_id"), "near-groups")
    dropped(prints, same, reps)
    return out


def representatives(docs: DataFrame) -> DataFrame:
    """The document of the smallest doc_id of each group of near_duplicates, with its own columns; of repeated rows of that doc_id one. A null doc_id names no group's document: such rows stay."""
    kept = near_duplicates(docs.filter("doc_id IS NOT NULL")).filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    rows = docs.select("doc_id", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own")).join(kept, "doc_id", "left_semi")
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("own")))
    return rows.withColumn("turn", first).filter("turn = 1").select("own.*").unionByName(docs.filter("doc_id IS NULL"))
