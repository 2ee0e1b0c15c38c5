from __future__ import annotations

import pytest

BLANKS = " \t\n\x0b\x0c\r"
CLASHES = "bucket int, payload binary, h long, x array<double>, kept string, score double, set_id long, key string"
DOCS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHES}"


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, None, len(text or ""), 1, b"x", 2, [1.0], "k", 0.5, 3, "z")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names the operators use inside."""
    return lambda pairs: spark.createDataFrame([row(*p) for p in pairs], DOCS)


@pytest.fixture(scope="session")
def odd_pairs():
    """Nulls, empty and very long texts, ties, repeated rows."""
    passage = " ".join(f"w{i}" for i in range(70))
    line = "This line is long enough to count as a frequent line, surely."
    long_text = " ".join(f"t{i % 9973}" for i in range(60_000))
    return [
        (None, passage), (1, None), (2, ""), (3, " \t\n "), (4, passage), (5, f"start {passage} end"), (5, f"start {passage} end"), (6, long_text), (7, f"{long_text} tail"),
        (8, "one"), (9, "One"), (10, "a b c d"), (11, "é ü ñ " * 30), (12, "x" * 100_000),
        *[(20 + i, f"own text {i} here\n{line}\n  {line.upper()}\t\nlast {i}") for i in range(7)], (26, f"own text 6 here\n{line}"), (None, line),
    ]
