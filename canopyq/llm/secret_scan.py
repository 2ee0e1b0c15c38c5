"""Secret scans: known formats, and runs of characters with high entropy.

Three fixed formats are found by their patterns.  Beside them, candidate
strings (long runs of key characters with a digit and a letter) get a
character class; within its alphabet the Shannon entropy of every window of
WINDOW characters is kept by incremental counts (the entering and the leaving
character change two counts, which stand in the window, and so the sum of
n*log2(n)), and a candidate with a window that reaches its class's threshold is
reported, unless an allow-list pattern suppresses it.  Everything is built-in
column functions.

The cost is linear in a text's length, in the number of matches, and in a
candidate's length: matches and windows go in runs of bounded length, so that no
array grows by copies of itself, and the first window that is high enough ends a
candidate.  No pattern repeats a group in a way that needs the stack.

Positions are code points, end exclusive.  Defined results: a null or empty
text has no spans; very long texts and candidates are scanned whole; repeated
rows are scanned each for itself; extra columns are kept unless they clash with
the result's names.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

#: The formats, and each one's least length (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

#: Candidate strings of the entropy scan.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Character classes in the order tried, with the entropy (bits) that a window must reach.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Z0-9]+$", 3.4), ("^[a-z0-9]+$", 3.4), ("^[A-Za-z0-9]+$", 3.6), ("^[A-Za-z0-9+/_=-]+$", 3.8))
#: Allow-list: identifiers and placeholders that look random but are no secrets.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"(?i)example|sample|dummy|placeholder|changeme|your[_-]?(?:key|token|secret)|x{6,}",
    r"^[0-9+/_=-]+$",
    r"^(?:0123456789|abcdefghijklmnop)",
    r"^(?:[A-Za-z0-9]{1,12}+[/_=-])++[A-Za-z0-9]{1,12}$",
)


#: Matches, and windows, that are folded in one go.
RUN = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), where value is worked out once, however often body names it inside its own functions."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans(text: Column, pattern: str, kind: str, keep: Callable[[Column], Column] | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind_no, end, kind); keep: a test of the matched string."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<start:int,kind_no:int,end:int,kind:string>>")
    no = KINDS.index(kind)
    # the last part of the split follows the last match and has none
    pairs = F.filter(F.arrays_zip(between.alias("between"), found.alias("found")), lambda x: x["found"].isNotNull())
    sizes = lambda x: F.struct(F.length(x["between"]).alias("gap"), F.length(x["found"]).alias("size"), (F.lit(True) if keep is None else keep(x["found"])).alias("kept"))

    def place(a: Column, x: Column) -> Column:
        start = a["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), F.lit(no).alias("kind_no"), end.alias("end"), F.lit(kind).alias("kind"))
        return F.struct(end.alias("at"), F.when(x["kept"], F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    def placed(matches: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), (F.size(matches) - 1).cast("int"), F.lit(RUN)), lambda i: F.slice(matches, i + 1, F.lit(RUN)))
        return bound(runs, in_order)

    def in_order(runs: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + x["size"])
        first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(runs, first, lambda a, run: F.struct((a["at"] + total(run)).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
        fold = lambda run, at: F.aggregate(run, F.struct(at.alias("at"), empty.alias("out")), place, lambda a: a["out"])
        return F.flatten(F.zip_with(runs, starts, fold))

    return F.when(text.rlike(pattern), bound(F.transform(pairs, sizes), placed)).otherwise(empty)


def reaches(s: Column, least: Column, window: int = WINDOW) -> Column:
    """Whether any window of an ASCII string has a Shannon entropy (bits) of least or more."""
    f = [n * math.log2(n) if n else 0.0 for n in range(window + 1)]
    gain = lambda n: F.get(F.array(*[F.lit(b - a) for a, b in zip(f, f[1:])]), n)  # noqa: E731  what one more of n adds
    # the sum of n * log2(n) that a window of that entropy has; a hair more, for rounding
    most = window * (math.log2(window) - least) + 1e-9

    def falls(codes: Column) -> Column:
        """The window sums, character by character: whether one gets down to most."""
        count = lambda first, n, c: F.size(F.filter(F.slice(codes, first, n), lambda x: x == c))

        def step(a: Column, i: Column) -> Column:
            enters, leaves = F.get(codes, i - 1), F.get(codes, i - window - 1)
            # the window before: characters i - window .. i - 1 (numbered from 1); the leaving one goes first
            low = F.greatest(i - window, F.lit(1))
            without = F.when(i > window, a["sum"] - gain(count(low + 1, i - 1 - low, leaves))).otherwise(a["sum"])
            rest = F.when(i > window, low + 1).otherwise(F.lit(1))
            total = without + gain(count(rest, i - rest, enters))
            return bound(total, lambda t: F.struct(t.alias("sum"), (a["low"] | ((i >= window) & (t <= most))).alias("low")))

        return F.aggregate(F.sequence(F.lit(1), F.size(codes)), F.struct(F.lit(0.0).alias("sum"), F.lit(False).alias("low")), step, lambda a: a["low"])

    # runs of windows; exists() ends with the first that is high enough
    runs = lambda codes: F.exists(F.sequence(F.lit(1), F.greatest(F.size(codes) - window + 1, F.lit(1)), F.lit(RUN)), lambda i: bound(F.slice(codes, i, F.lit(RUN + window - 1)), falls))
    return bound(F.transform(F.regexp_extract_all(s, F.lit("."), F.lit(0)), F.ascii), runs)


def looks_secret(s: Column) -> Column:
    """Whether a candidate's entropy reaches its class's threshold and no allow-list pattern fits."""
    threshold = F.lit(math.inf)
    for pattern, least in reversed(CLASSES):
        threshold = F.when(s.rlike(pattern), F.lit(least)).otherwise(threshold)
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | s.rlike(pattern)
    mixed = s.rlike("[0-9]") & s.rlike("[A-Za-z]")
    return F.when(mixed & ~allowed, bound(threshold, lambda least: reaches(s, least))).otherwise(F.lit(False))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs with assign, access, hex and entropy: arrays of (start, kind_no, end, kind)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in KINDS])
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "assign": spans(text, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 6),
            "access": spans(text, ACCESS, "access"),
            "hex": spans(text, HEX, "hex"),
            "entropy": spans(text, CANDIDATE, "entropy", looks_secret),
        }
    )


def joined(*arrays: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    ordered = F.array_sort(F.concat(*arrays))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
