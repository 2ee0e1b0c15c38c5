"""Quality classifier: regularised quadratic discriminant over document statistics.

A text becomes a short vector of transformed statistics (log counts, logits of
shares).  Each class has a Gaussian: its mean, and its covariance shrunk
towards the pooled one and that one's diagonal.  The score is the posterior of
class 1 from the difference of Mahalanobis log densities; the Cholesky factors
are computed once and cached in the model.

Learning sees only sums (count, sum of x, sum of x xT per class) over the
labelled rows: all of them up to MOST_LABELS labels, beyond that those of a fixed
share of the ids, by hash.  So the labels fit a broadcast, and only labelled
texts are looked at.  Statistics are taken to whole multiples of 1 / UNIT before
they are summed, which makes the sums exact: a model, and so a score, does not
hang on the order or the partitions of the rows.

Defined results: a null or empty text has the statistics of no words and gets
a score like any other.  Rows without a label (or with a null id or label)
teach nothing.  Rows that repeat a doc_id are scored, and teach, each for itself;
a label that is repeated counts once.  With no row of a class the prior decides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .dealing import groups, small_batches
from .vectext import Words, chunks

#: Byte classes, by which a text's bytes are counted.
LOWERCASE, UPPERCASE, DIGIT, HIGH, SPACE, LINE, STOP, MARK = range(8)
NAMES = (
    "log_words", "log_word_length", "upper", "digits", "high", "marks", "shouts", "stops", "log_line_length",
    "distinct_words", "distinct_pairs", "bare_words", "marked_words", "capital_words",
)
OUT = "doc_id long, score double"


def byte_classes() -> np.ndarray:
    c = np.full(256, MARK, np.uint8)
    c[97:123], c[65:91], c[48:58], c[128:] = LOWERCASE, UPPERCASE, DIGIT, HIGH
    c[[32, 9, 11, 12, 13]], c[10], c[[44, 46, 59, 58, 39, 45, 63]] = SPACE, LINE, STOP
    return c


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text."""
    w = Words(texts)
    rows, n = w.rows, w.counts.astype(float)
    kind = byte_classes()[w.buf]
    sums = lambda flags: np.diff(np.append(0, np.cumsum(flags))[w.offsets]).astype(float)
    count = {k: sums(kind == k) for k in range(8)}
    shouts = sums(w.buf == 33)
    size = np.diff(w.offsets).astype(float)
    row = w.row_of_word()
    per_row = lambda flags: np.bincount(row, weights=flags, minlength=rows)
    letter = np.append(0, np.cumsum(kind <= HIGH))
    mark = np.append(0, np.cumsum(kind == MARK))
    bare = letter[w.ends] == letter[w.starts] if len(row) else np.zeros(0)
    marked = mark[w.ends] > mark[w.starts] if len(row) else np.zeros(0)
    capital = kind[w.starts] == UPPERCASE if len(row) else np.zeros(0)
    h = w.hashes()

    def distinct(values: np.ndarray, of: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of))
        at, _ = groups(of[order], values[order])
        return np.bincount(of[order][at], minlength=rows).astype(float)

    pair = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else np.zeros(0, np.uint64)
    inside = row[:-1] == row[1:] if len(h) > 1 else np.zeros(0, bool)
    share = lambda a, b, weight=1.0: np.log((a + 0.5 * weight) / (b - a + 0.5 * weight))
    letters = count[LOWERCASE] + count[UPPERCASE] + count[HIGH]
    x = [
        np.log1p(n),
        np.log((letters + 1) / (n + 1)),
        share(count[UPPERCASE], np.maximum(letters, count[UPPERCASE])),
        share(count[DIGIT], size),
        share(count[HIGH], size),
        share(count[MARK], size),
        share(shouts, size),
        share(count[STOP], size),
        np.log1p(size / (count[LINE] + 1)),
        share(distinct(h, row), n),
        share(distinct(pair[inside], row[:-1][inside]) if len(h) > 1 else np.zeros(rows), np.maximum(n - 1, 0)),
        share(per_row(bare), n),
        share(per_row(marked), n),
        share(per_row(capital), n),
    ]
    return np.stack(x, axis=1)


@dataclass
class Gaussian:
    """A class's log prior, mean, and Cholesky factor of its covariance; the factor's inverse is cached."""

    log_prior: float
    mean: np.ndarray
    factor: np.ndarray
    whiten: np.ndarray = field(init=False)
    constant: float = field(init=False)

    def __post_init__(self):
        self.whiten = np.linalg.inv(self.factor).T
        self.constant = self.log_prior - float(np.log(np.diag(self.factor)).sum())

    def log_density(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) @ self.whiten
        return self.constant - 0.5 * (z * z).sum(axis=1)


@dataclass
class QualityModel:
    """Two class Gaussians over standardised statistics."""

    center: np.ndarray
    scale: np.ndarray
    classes: dict[int, Gaussian] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Posterior of class 1."""
        if set(self.classes) != {0, 1}:
            return np.full(len(x), 1.0 if 1 in self.classes else 0.0 if 0 in self.classes else 0.5)
        z = np.clip((x - self.center) / self.scale, -12, 12)
        d = self.classes[1].log_density(z) - self.classes[0].log_density(z)
        return 1 / (1 + np.exp(-np.clip(d, -700, 700)))


#: Labels up to which all are learned from.
MOST_LABELS = 100_000
#: Learning takes statistics to multiples of 1 / UNIT, and to SPAN at most: whole numbers under 2**17, so sums of products stay exact up to 2**29 rows.
UNIT, SPAN = 4096, 31


def _class_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class, place, value): the parts of count, sum and sum of products of a partition's (y, text), in units."""
    total = {c: np.zeros((len(NAMES) + 1) ** 2, np.int64) for c in (0, 1)}
    for batch in batches:
        for part in chunks(batch):
            y = part.column(0).to_numpy(zero_copy_only=False)
            x = np.rint(np.clip(statistics(part.column(1)), -SPAN, SPAN) * UNIT)
            for c in (0, 1):
                own = x[y == c]
                for lo in range(0, len(own), 1 << 12):
                    z = np.hstack([np.ones((len(own[lo : lo + (1 << 12)]), 1)), own[lo : lo + (1 << 12)]])
                    total[c] += (z.T @ z).ravel().astype(np.int64)  # whole numbers under 2**46: exact in any order
    for c, v in total.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), c), pa.int32()), pa.array(np.arange(len(v)), pa.int32()), pa.array(v)], names=["y", "place", "value"])


def fit_quality(labelled: DataFrame, shrink: float = 0.15, ridge: float = 0.05) -> QualityModel:
    """Learn from rows of y (0 or 1) and text."""
    k = len(NAMES)
    rows = labelled.select("y", "text").mapInArrow(_class_sums, "y int, place int, value long").groupBy("y", "place").agg(F.sum("value").alias("value")).collect()
    unit = np.full((k + 1, k + 1), 1 / UNIT**2)
    unit[0, 1:] = unit[1:, 0] = 1 / UNIT
    unit[0, 0] = 1
    moment = {c: np.zeros((k + 1) ** 2) for c in (0, 1)}
    for r in rows:  # (k + 1)**2 sums for each class
        moment[r["y"]][r["place"]] = r["value"] * unit.ravel()[r["place"]]
    both = (moment[0] + moment[1]).reshape(k + 1, k + 1)
    n = both[0, 0]
    if not n:
        return QualityModel(np.zeros(k), np.ones(k))
    center = both[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(both)[1:] / n - center**2, 1e-6))
    model = QualityModel(center, scale)
    mean, cov = {}, {}
    for c in (0, 1):
        m = moment[c].reshape(k + 1, k + 1)
        if m[0, 0]:
            mu = m[0, 1:] / m[0, 0]
            mean[c] = (mu - center) / scale
            cov[c] = (m[1:, 1:] / m[0, 0] - np.outer(mu, mu)) / np.outer(scale, scale)
    weight = {c: moment[c][0] / n for c in mean}
    pooled = sum(weight[c] * cov[c] for c in mean)
    target = 0.5 * (pooled + np.diag(np.diag(pooled)))
    for c in mean:
        s = (1 - shrink) * cov[c] + shrink * target + ridge * np.eye(k)
        model.classes[c] = Gaussian(float(np.log(weight[c])), mean[c], np.linalg.cholesky(s))
    return model


def _scores(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(statistics(part.column(1))))], names=["doc_id", "score"])

    return run


def held_out(column: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def text_rows(docs: DataFrame) -> DataFrame:
    small_batches(docs)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def train_quality(docs: DataFrame, labels: DataFrame, target: str = "quality", most_labels: int = MOST_LABELS) -> QualityModel:
    """A model from the labelled documents that are not held out; texts stay where they are read."""
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(target).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    share = -(-marks.count() // most_labels)
    if share > 1:
        marks = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
    return fit_quality(text_rows(docs).where(~held_out()).join(F.broadcast(marks.distinct()), "doc_id"))


def score_quality(docs: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score of every row."""
    return text_rows(docs).mapInArrow(_scores(model), OUT)


def keep_quality(docs: DataFrame, model: QualityModel, threshold: float) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with their columns."""

    names, schema = docs.columns, docs.schema
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                yield part.filter(pa.array(model.score(statistics(part.column(at))) >= threshold))

    return docs.mapInArrow(run, schema)
