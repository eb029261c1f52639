"""Quality rules with compression bands.

Next to counting rules, a text's zstandard ratio (bytes over compressed bytes, level `LEVEL`) must lie within a band for
its length, as a whole and in each chunk of `CHUNK` bytes, the last and shorter one too: far too compressible is repetitive, hardly compressible is
noise. Short texts compress less, so a band holds for a range of lengths; texts below the first range have no band.

Defined results. Null text has no words and fails (base_failed: fewer than 50 words). Repeated rows each give a row.
Empty table: empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, record

LEVEL = 3
CHUNK = 4096
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED = 50
#: (bytes from, least ratio, largest ratio), for whole texts and for chunks.
BANDS = ((200, 1.1, 4.0), (1_000, 1.4, 5.0), (4_000, 1.45, 6.0), (16_000, 1.5, 8.0))
#: Share of chunks that may lie outside.
CHUNKS_OUTSIDE = 0.25

OUT = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("ratio", pa.float64()), ("chunks_outside", pa.int64()), ("reason", pa.string())])
OUT_DDL = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, chunks_outside long, reason string"


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words in windows of size words that occur at least twice in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[k:] for k in range(size)), strict=False))
    if len(set(windows)) == n:
        return 0
    seen, twice = set(), set()
    for w in windows:
        (twice if w in seen else seen).add(w)
    count, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + size - max(i, end)
            end = i + size
    return count


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = raw.split(b"\n")
    if len(set(lines)) == len(lines):
        return 0
    lines = [x for x in lines if x.split()]
    return len(lines) - len(set(lines))


def band_of(size: int) -> tuple[int, float, float] | None:
    return next((b for b in reversed(BANDS) if size >= b[0]), None)


def ratios(raw: bytes, compressor: zstandard.ZstdCompressor) -> tuple[float, int, int]:
    """The whole text's ratio, and how many of how many judged chunks lie outside their band."""
    whole = len(raw) / max(1, len(compressor.compress(raw))) if raw else 0.0
    outside = judged = 0
    if len(raw) > CHUNK:
        for i in range(0, len(raw), CHUNK):
            part = raw[i : i + CHUNK]
            if band := band_of(len(part)):
                judged += 1
                outside += not band[1] <= len(part) / len(compressor.compress(part)) <= band[2]
    return whole, outside, judged


def verdict(size: int, whole: float, outside: int, judged: int) -> str | None:
    """Why the method rejects a text of size bytes; None if it doesn't."""
    band = band_of(size)
    if band and whole > band[2]:
        return "repetitive"
    if band and whole < band[1]:
        return "incompressible"
    return "chunks" if judged and outside > CHUNKS_OUTSIDE * judged else None


def assess(docs: DataFrame) -> DataFrame:
    """A row of counts, ratio and verdict for each document."""
    drop = bytes(set(range(256)) - set(SYMBOLS.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = zstandard.ZstdCompressor(level=LEVEL)
        for batch in chunks(batches):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw = (text or "").encode()
                words = raw.split()
                repeat = repeated_words(words)
                failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEATED * len(words)
                whole, outside, judged = ratios(raw, compressor)
                why = "words" if len(words) < MIN_WORDS else "repeats" if failed else verdict(len(raw), whole, outside, judged)
                spaces = sum(map(raw.count, (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")))
                rows.append((doc_id, len(words), len(text or "") - spaces, len(raw.translate(None, drop)), duplicate_lines(raw), repeat, failed, why is None, whole, outside, why))
            if rows:
                yield record(OUT, *map(list, zip(*rows, strict=True)))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, OUT_DDL)
