"""Language identification by bit-sliced Bloom filters over character n-grams.

One array of cells serves all languages: bit j of a cell belongs to language
j's Bloom filter (a cell has as many 64-bit words as the languages need).  An n-gram addresses a few cells, and the AND of their masks
names all languages that contain it.  A text's n-grams are counted by language
bit; each count is corrected for that language's false-positive rate (the
share of set bits to the power of the probes), and the largest corrected count
decides.

Learning takes the distinct n-grams of all training texts by language; a
language's filter takes all of them, and the number of cells follows from the
language with the most, up to MOST_CELLS: beyond it the filters only get fuller,
nothing is left out, and the correction goes by their real fill.  Executors set
the bits, a block of cells each; only the finished blocks go to the driver.

A word has a blank at each end, and so many more at its end that every word has
an n-gram.  Defined results: ``und`` with score 0 for a null text, one without any letter,
or a model without languages.  Ties go to the language that sorts first.  Rows
that repeat a doc_id are judged each for itself; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..sources.shared import shared_checkpoint
from .dealing import small_batches
from .quality import held_out
from .vectext import chunks, mix

SIZE = 4
BLOCK = 1 << 14
#: Bound on the model: 64 MB for up to eight languages.
MOST_CELLS = 1 << 26
OUT = "doc_id long, lang_pred string, score double"


@cache
def letter_table() -> np.ndarray:
    """Which code points are letters."""
    return np.array([chr(c).isalpha() for c in range(0x110000)], dtype=bool)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each n-gram of letters; a word has a blank at each end."""
    lowered = [(t or "").lower() for t in texts]
    code = np.frombuffer("\0".join(["", *lowered, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts) + 1), [1, *[len(t) + 1 for t in lowered]]) - 1
    letter = letter_table()[code]
    # a blank after a blank starts nothing: keep letters, the first blank after each, and the first of all
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[0] = True
    code, row, letter = np.where(letter, code, 0)[keep].astype(np.uint64), row[keep], letter[keep]
    n = len(code)
    whole = np.flatnonzero(letter[1 : max(n - 2, 1)] & letter[2 : max(n - 1, 2)])  # no blank but at the ends
    single = np.flatnonzero(~letter[: max(n - 2, 0)] & letter[1 : max(n - 1, 1)] & ~letter[2:])
    h = np.zeros(len(whole) + len(single), np.uint64)
    for i in range(SIZE):
        h = h * np.uint64(0x100000001B3) + np.append(code[whole + i], code[single + i] if i < 2 else np.zeros(len(single), np.uint64))
    return row[np.append(whole, single) + 1], mix(h)


def has_letter(texts: list[str | None]) -> np.ndarray:
    return np.array([bool(t) and any(map(str.isalpha, t)) for t in texts], dtype=bool)


@dataclass
class LanguageModel:
    """languages[j] owns bit j % 64 of word j // 64 of each cell; fill[j]: the share of cells with that bit.

    cells: a row of words for each cell.
    """

    languages: list[str]
    cells: np.ndarray
    probes: int
    fill: np.ndarray

    def masks(self, h: np.ndarray) -> np.ndarray:
        """The language bits of each n-gram, a row of words."""
        bits = np.uint64(len(self.cells) - 1)
        step = mix(h) | np.uint64(1)
        out = self.cells[(h & bits).astype(np.int64)].copy()
        for i in range(1, self.probes):
            out &= self.cells[((h + np.uint64(i) * step) & bits).astype(np.int64)]
        return out

    def judge(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        rows, n = len(texts), len(self.languages)
        row, h = grams(texts)
        mask = self.masks(h) if n else np.zeros((0, 1), np.uint64)
        total = np.bincount(row, minlength=rows).astype(float)
        got = np.zeros((rows, max(n, 1)))
        kind = self.cells.dtype.type
        for j in range(n):
            hits = np.bincount(row, weights=(mask[:, j // 64] >> kind(j % 64)) & kind(1), minlength=rows)
            false = self.fill[j] ** self.probes
            got[:, j] = np.maximum(hits - total * false, 0) / max(1 - false, 1e-9)
        best = got.argmax(axis=1)
        top = got[np.arange(rows), best]
        second = np.sort(got, axis=1)[:, -2] if n > 1 else np.zeros(rows)
        score = np.where(top > 0, (top - second) / np.maximum(top, 1e-9), 0.0)
        score = np.clip(0.5 * score + 0.5 * np.minimum(1, top / np.maximum(total, 1)), 0, 1)
        known = has_letter(texts) & (n > 0)
        return [self.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist())], np.where(known, score, 0.0)


#: Distinct n-grams that a task holds.
HELD = 1 << 21


def _distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, n-gram) of a partition, each once as far as HELD goes."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, h in sorted(held.items()):
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(h), pa.string()), pa.array(h.view(np.int64))], names=["lang", "h"])
        held.clear()

    for batch in batches:
        for part in chunks(batch):
            langs, of = np.unique(np.array(part.column(0).to_pylist(), dtype=object), return_inverse=True)
            row, h = grams(part.column(1).to_pylist())
            for i, lang in enumerate(langs.tolist()):
                mine = np.unique(h[of[row] == i])
                held[lang] = np.union1d(held[lang], mine) if lang in held else mine
            if sum(map(len, held.values())) > HELD:
                yield from out()
    yield from out()


def _probes(size: int, probes: int):
    """(block, place in it, language number) of each bit to set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(1).to_numpy().view(np.uint64)
            step = mix(h) | np.uint64(1)
            for i in range(probes):
                cell = ((h + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cell // BLOCK), pa.array((cell % BLOCK).astype(np.int32)), batch.column(0)], names=["block", "at", "j"])

    return run


def _block(kind: type, words: int):
    """The cells of a block, by OR over the languages' bits."""

    def run(bits: pa.Table) -> pa.Table:
        cells = np.zeros((BLOCK, words), kind)
        j = bits.column("j").to_numpy().astype(np.uint64)
        np.bitwise_or.at(cells, (bits.column("at").to_numpy(), (j // np.uint64(64)).astype(np.int64)), (np.uint64(1) << j % np.uint64(64)).astype(kind))
        return pa.table({"block": bits.column("block")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    return run


def train_language(docs: DataFrame, probes: int = 3, bits_per_gram: int = 16, most_cells: int = MOST_CELLS) -> LanguageModel:
    """A model from all rows of text and non-null lang that are not held out."""
    small_batches(docs)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    learned = shared_checkpoint(rows.mapInArrow(_distinct, "lang string, h long").distinct())
    sizes = {r["lang"]: r["count"] for r in learned.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    size = 1 << max(10, int(np.ceil(np.log2(max(1, bits_per_gram * max(sizes.values(), default=0))))))
    size = min(size, most_cells)
    kind = next((k for k in (np.uint8, np.uint16, np.uint32) if len(languages) <= 8 * np.dtype(k).itemsize), np.uint64)
    words = max(1, -(-len(languages) // 64))
    cells = np.zeros((max(size, BLOCK), words), kind)
    if languages:
        number = F.array_position(F.array(*map(F.lit, languages)), F.col("lang")) - 1
        # one row a cell and language, whatever the number of n-grams that meet there
        bits = learned.select(number.cast("int").alias("j"), "h").mapInArrow(_probes(size, probes), "block long, at int, j int").distinct()
        for r in bits.groupBy("block").applyInArrow(_block(kind, words), "block long, cells binary").collect():
            cells[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["cells"], kind).reshape(-1, words)
    cells = cells[:size]
    return LanguageModel(languages, cells, probes, np.array([((cells[:, j // 64] >> kind(j % 64)) & kind(1)).mean() for j in range(len(languages))]))


def _judged(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                lang, score = model.judge(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return run


def identify_language(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_judged(model), OUT)
