"""Secret scans with SQL functions only.

Three kinds of spans come from patterns: `assign` (a name for a secret, a separator, a value), `access` (access key
ids) and `hex` (long hexadecimal runs). A fourth, `entropy`, comes from candidate strings, the runs of `CANDIDATE` in what the
patterns' spans leave of the text: a window slides over a candidate, and as one character enters and one leaves, two of
its character counts change, and with them the sum of n * log2(n), so each step's Shannon entropy is log2(W) - sum / W.
The counts are bit fields of a few integers, so a step costs the same whatever the candidate's length. A candidate of a
character class (hex, one case with digits, mixed) is a span if its best window reaches the class's threshold, unless
the allow-list knows its form.

Positions are code points, ends exclusive. Spans are found from a pattern's matches and the gaps between them, so that
everything stays one projection: no join, no shuffle. Work grows with the text and the number of matches; sums over
matches run in blocks, since an array that grows by one element is copied each time.

Defined results. Null text is empty: no spans. Repeated rows each give a row. A null doc_id is kept. Empty table: empty
result. Other columns are ignored; redacted() keeps them.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The patterns of the three kinds, in the order in which spans of one start are listed, and the least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: What a text with a candidate that has a digit matches; tried only where a run of its characters begins, so that long runs cost once.
LIKELY = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
WINDOW = 20
#: Least entropy of a candidate's best window, by its character class; the most possible is log2(20) = 4.32.
THRESHOLDS = {"hex": 3.0, "single": 3.5, "mixed": 3.8}
#: Forms that aren't secrets: UUIDs, words joined by signs, paths, sample values, runs of the alphabet or the digits, dates and times.
ALLOWED = (
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"^[A-Z]?[a-z]*+(?:[-_/+=]++[A-Z]?[a-z]*+)*+[0-9]{0,4}$",
    r"^(?:/?[A-Za-z]++[0-9]{0,3})(?:/[A-Za-z_-]++[0-9]{0,3})++/?$",
    r"(?i)example|sample|placeholder|changeme|dummy|xxxx",
    r"(?i)abcdefgh|0123456789|1234567890|qwertyuiop",
    r"^[0-9][0-9_/+=-]*+$",
    r"(.)\1{7}",
)
MASK = "[SECRET]"

SPANS = "array<struct<start:int,rank:int,end:int>>"
#: Matches whose sums are made in one go.
BLOCK = 256
#: Characters of a candidate are counted in fields of FIELD bits, FIELDS of them in a long integer, for the codes from FIRST_CODE on.
FIELD, FIELDS, FIRST_CODE, LAST_CODE = 5, 12, ord("+"), ord("z")
#: n * log2(n) of each count that a window can hold, as whole numbers of 2 ** -UNIT_BITS, so that sums are exact however long they run.
UNIT_BITS = 40
N_LOG_N = tuple(round(n * math.log2(n) * 2**UNIT_BITS) if n else 0 for n in range(WINDOW + 1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column], start: Column) -> Column:
    """For an array the results of joining start with no value, with the first, with the first two, and so on (one more than there are values)."""

    def grown(part: Column) -> Column:
        return F.aggregate(part, F.array(start), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x))))

    def of(all_values: Column) -> Column:
        starts = F.when(F.size(all_values) > 0, F.sequence(F.lit(1), F.size(all_values), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: grown(F.slice(all_values, i, F.lit(BLOCK))))

        def put_together(inner: Column) -> Column:
            return let(
                grown(F.transform(inner, lambda p: F.element_at(p, -1))),
                lambda ahead: F.concat(F.flatten(F.zip_with(inner, F.slice(ahead, 1, F.size(inner)), lambda p, a: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: join(a, x)))), F.array(F.element_at(ahead, -1))),
            )

        return let(parts, put_together)

    return let(values, of)


def plus(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: str) -> Column:
    """Of a pattern's matches: (start, end, value)."""

    def of(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        steps = F.zip_with(gaps, matches, lambda g, m: F.length(g) + F.length(m))
        return F.zip_with(matches, F.slice(running(steps, plus, F.lit(0)), 2, F.size(matches)), lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"), m.alias("value")))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), of)


def found(text: Column, pattern: str, rank: int, least: int = 0) -> Column:
    """Spans (start, rank, end) of a pattern's matches, of those whose second group has the least length if one is given."""
    matches = places(text, pattern)
    if least:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        matches = F.filter(F.zip_with(matches, values, lambda m, v: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.length(v).alias("held"))), lambda m: m["held"] >= least)
    spans = F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end")))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(SPANS))


def replaced(text: Column, spans: Column, by: Callable[[Column, Column], Column]) -> Column:
    """The text with by(span, at) in place of each of its spans, which are in order; at: where the spans before it end.

    The text is cut as four-byte characters, whose places need no search.
    """

    def of(wide: Column) -> Column:
        cut = lambda start, size: F.decode(F.substring(wide, start * 4 + 1, F.greatest(size, F.lit(0)) * 4), "UTF-32")

        def with_ends(ends: Column) -> Column:
            parts = F.zip_with(spans, F.slice(ends, 1, F.size(spans)), lambda s, at: F.concat(cut(at, s["start"] - at), by(s, at)))
            return F.concat(F.array_join(parts, ""), F.decode(F.substring(wide, F.element_at(ends, -1) * 4 + 1, F.length(wide)), "UTF-32"))

        return let(running(F.transform(spans, lambda s: s["end"]), F.greatest, F.lit(0)), with_ends)

    return let(F.encode(text, "UTF-32"), of)


def blanks(span: Column, at: Column) -> Column:
    """As many spaces as the span covers characters that those before it don't."""
    return F.repeat(F.lit(" "), F.greatest(span["end"] - F.greatest(span["start"], at), F.lit(0)))


def best_entropy(candidate: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits, of a window sliding over a string of the characters of CANDIDATE (0 if it is shorter than a window).

    `longs` hold the window's character counts; entering and leaving touch one field each.
    """
    longs = -(-(LAST_CODE - FIRST_CODE + 1) // FIELDS)
    table = F.array(*(F.lit(x).cast("long") for x in N_LOG_N))

    def moved(state: Column, code: Column, sign: int) -> Column:
        """The state with one more (or one less) of a character."""

        def of(at: Column) -> Column:
            shift = (at["code"] % FIELDS) * FIELD

            def changed(n: Column) -> Column:
                count = n["count"]
                fields = [F.when(at["word"] == k, state[f"c{k}"] + F.lit(sign).cast("long") * n["one"]).otherwise(state[f"c{k}"]).alias(f"c{k}") for k in range(longs)]
                total = state["sum"] + F.get(table, count + sign) - F.get(table, count)
                return F.struct(*fields, total.alias("sum"), state["least"].alias("least"))

            held = F.element_at(F.array(*(state[f"c{k}"] for k in range(longs))), at["word"] + 1)
            count = F.call_function("shiftrightunsigned", held, shift).bitwiseAND(F.lit((1 << FIELD) - 1).cast("long")).cast("int")
            return let(F.struct(count.alias("count"), F.call_function("shiftleft", F.lit(1).cast("long"), shift).alias("one")), changed)

        return let(F.struct(code.alias("code"), F.floor(code / FIELDS).cast("int").alias("word")), of)

    def of(raw: Column) -> Column:
        # bytes are found by their place, where the characters of a string would be counted from its start
        code = lambda i: F.ascii(F.substring(raw, i, 1).cast("string")) - FIRST_CODE

        def step(state: Column, i: Column) -> Column:
            left = F.when(i > window, let(state, lambda s: moved(s, code(i - window), -1))).otherwise(state)
            entered = let(left, lambda s: moved(s, code(i), 1))
            least = lambda s: F.when((i >= window) & (s["sum"] < s["least"]), s["sum"]).otherwise(s["least"])
            return let(entered, lambda s: F.struct(*(s[f"c{k}"].alias(f"c{k}") for k in range(longs)), s["sum"].alias("sum"), least(s).alias("least")))

        zero, none = F.lit(0).cast("long"), F.lit(N_LOG_N[window]).cast("long")
        start = F.struct(*(zero.alias(f"c{k}") for k in range(longs)), zero.alias("sum"), none.alias("least"))
        steps = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda state: F.lit(math.log2(window)) - state["least"] / F.lit(float(window * 2**UNIT_BITS)))

    return let(candidate.cast("binary"), of)


def suspicious(candidate: Column) -> Column:
    """Whether a candidate string reaches its class's threshold and isn't of an allowed form."""
    allowed = F.lit(False)
    for form in ALLOWED:
        allowed = allowed | candidate.rlike(form)
    threshold = (
        F.when(candidate.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$"), THRESHOLDS["hex"])
        .when(candidate.rlike("[a-z]") & candidate.rlike("[A-Z]"), THRESHOLDS["mixed"])
        .otherwise(THRESHOLDS["single"])
    )
    return candidate.rlike("[0-9]") & candidate.rlike("[A-Za-z]") & ~allowed & (best_entropy(candidate) >= threshold)


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of candidates with a window of high entropy, in what the base spans leave of the text."""
    left = F.when(F.size(base) > 0, replaced(text, base, blanks)).otherwise(text)
    kept = let(left, lambda rest: F.transform(F.filter(places(rest, CANDIDATE), lambda m: suspicious(m["value"])), lambda m: F.struct(m["start"].alias("start"), F.lit(KINDS.index("entropy")).alias("rank"), m["end"].alias("end"))))
    return F.when(text.rlike(LIKELY), kept).otherwise(F.array().cast(SPANS))


def scanned(docs: DataFrame) -> DataFrame:
    """docs with the columns `base_spans` and `spans` added: arrays of (start, rank, end) in order."""
    text = F.coalesce("text", F.lit(""))
    base = F.concat(found(text, ASSIGN, 0, ASSIGN_LEAST), found(text, ACCESS, 1), found(text, HEX, 2))
    held = docs.withColumn("base_spans", F.array_sort(base))
    return held.withColumn("spans", F.array_sort(F.concat("base_spans", entropy_spans(text, F.col("base_spans")))))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_entropy."""
    rows = scanned(docs.select(F.col("doc_id").cast("long"), "text"))
    number = lambda rank: F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    return rows.select("doc_id", number(0).alias("n_assign"), number(1).alias("n_access"), number(2).alias("n_hex"), F.sha2(listed(F.col("base_spans")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), number(3).alias("n_entropy"))


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """docs with every span of its text replaced by a mask (one for spans that overlap); a text without spans stays as it is."""
    rows = scanned(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), "text"))
    text = F.when(F.size("spans") > 0, replaced(F.col("text"), F.col("spans"), lambda s, at: F.when(s["start"] >= at, mask).otherwise(""))).otherwise(F.col("text"))
    return rows.select("own", text.alias("text")).select(*((F.col("text") if c == "text" else F.col("own").getField(c)).alias(c) for c in docs.columns))
