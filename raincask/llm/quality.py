"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Each text gives a fixed vector of statistics (shares of character classes, words, lines, repeats),
transformed to be nearer to normal. The class means and covariances come from sums that Spark adds up
over the labelled rows. A covariance is shrunk towards that of both classes together and towards its
own diagonal; its Cholesky factor is computed once and travels with the scoring tasks. The score is
the logistic of the difference of the Mahalanobis log-densities, with the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, raw_bytes, rows_per_batch, slices, text_key, text_or_empty
from .substring_dedup import words_of

SLICE_BYTES, BATCH_ROWS = 2 << 20, 1000
#: Classes of bytes that are counted: name, members.
BYTE_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "stop": b".?",
    "comma": b",;:",
    "shout": b"!",
    "table": b"|\t",
    "symbol": b"#$%&*~^_=+<>{}[]\\/@`",
    "quote": b"\"'()-",
    "line": b"\n",
}
#: Shares of these classes, and of bytes over 127, in ordinary prose. A text is described as if SMOOTH such
#: bytes in SMOOTH / 5 words came with it, so that the few characters of a short one don't decide alone.
PROSE = [0.03, 0.76, 0.0, 0.015, 0.01, 0.0, 0.0, 0.0, 0.0, 0.005, 0.03]
SMOOTH = 40.0
FEATURES = [*BYTE_CLASSES, "high", "words", "word_length", "distinct_words", "distinct_lines", "line_words", "short_words", "sentence_words", "longest_word"]


def statistics(text: pa.Array) -> np.ndarray:
    """One row of transformed statistics for each text; an empty text gives a finite row too."""
    offsets, data = raw_bytes(text)
    n, size = len(text), np.diff(offsets).astype(float)
    kind = np.zeros(256, np.uint8)
    for i, members in enumerate(BYTE_CLASSES.values(), 1):
        kind[list(members)] = i
    kind[128:] = len(BYTE_CLASSES) + 1
    kinds = len(BYTE_CLASSES) + 2
    owner = np.repeat(np.arange(n), np.diff(offsets))
    counts = np.bincount(owner * kinds + kind[data], minlength=n * kinds).reshape(n, kinds)[:, 1:].astype(float)
    words, per = words_of(text)
    length = pc.binary_length(words).to_numpy().astype(float) if len(words) else np.zeros(0)
    of = np.repeat(np.arange(n), per)

    def distinct(items: pa.Array, owner: np.ndarray) -> np.ndarray:
        if not len(items):
            return np.zeros(n)
        code = items.dictionary_encode().indices.to_numpy().astype(np.int64)
        return np.bincount(np.unique(owner * (code.max() + 1) + code) // (code.max() + 1), minlength=n).astype(float)

    lines = pc.split_pattern(text, "\n")
    per_line = np.diff(lines.offsets.to_numpy())
    longest = np.zeros(n)
    np.maximum.at(longest, of, length)
    share = np.sqrt((counts + SMOOTH * np.array(PROSE)) / (size + SMOOTH)[:, None])
    extra = SMOOTH / 5
    more = [
        np.log1p(per),
        np.log1p((np.bincount(of, weights=length, minlength=n) + 4 * extra) / (per + extra)),
        (distinct(words, of) + extra) / (per + extra),
        distinct(lines.flatten(), np.repeat(np.arange(n), per_line)) / np.maximum(per_line, 1),
        np.log1p(per / np.maximum(per_line, 1)),
        (np.bincount(of, weights=length <= 3, minlength=n) + extra / 2) / (per + extra),
        np.log1p((per + extra) / (counts[:, 3] + 1)),
        np.log1p(longest),
    ]
    return np.column_stack([share, *more])


@dataclass
class Discriminant:
    """Per class: log prior, mean, Cholesky factor of the covariance, and that factor's inverse, made once."""

    prior: list[float]
    mean: list[np.ndarray]
    factor: list[np.ndarray]

    def __post_init__(self):
        self.whiten = [np.linalg.inv(c) for c in self.factor]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        density = []
        for p, m, c, w in zip(self.prior, self.mean, self.factor, self.whiten):
            z = w @ (x - m).T
            density.append(np.log(p) - np.log(np.diag(c)).sum() - 0.5 * (z * z).sum(axis=0))
        return density[1] - density[0]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.log_odds(x), -700, 700)))


def fit_from_sums(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], width: int, towards_pooled: float, towards_diagonal: float) -> Discriminant:
    """Discriminant from (n, sum, sum of outer products) of classes 0 and 1; a class without rows takes the pooled moments."""
    zero = (0.0, np.zeros(width), np.zeros((width, width)))
    parts = [sums.get(k, zero) for k in (0, 1)]
    total = max(1.0, sum(p[0] for p in parts))
    centre = sum(p[1] for p in parts) / total
    scatter = []
    for n, s, o in parts:
        mean = s / n if n else centre
        scatter.append((mean, o / n - np.outer(mean, mean) if n else np.zeros((width, width))))
    pooled = sum(p[0] * c for p, (_, c) in zip(parts, scatter)) / total
    floor = np.diag(np.full(width, 1e-4))
    prior, means, factors = [], [], []
    for (n, _, _), (mean, cov) in zip(parts, scatter):
        weight = 1 - (1 - towards_pooled) * n / (n + width)  # few rows lean more on the pooled one
        mixed = (1 - weight) * cov + weight * pooled
        mixed = (1 - towards_diagonal) * mixed + towards_diagonal * np.diag(np.diag(mixed)) + floor
        prior.append((n + 1) / (total + 2))
        means.append(mean)
        factors.append(np.linalg.cholesky(mixed))
    return Discriminant(prior, means, factors)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            x = statistics(part.column(1))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), flat], ["doc_id", "key", "x"])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, key, x): the statistics of every whole text, and its `text_key`; null counts as empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"), text_key(id_col, text_col).alias("key")).mapInArrow(_describe, "doc_id long, key long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        x = np.stack(batch.column(0).to_numpy(zero_copy_only=False))
        y = batch.column(1).to_numpy()
        one = np.column_stack([np.ones(len(x)), x])
        for k in np.unique(y).tolist():
            mine = one[y == k]
            sums[k] = sums.get(k, 0) + mine.T @ mine
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([m.ravel() for m in sums.values()], pa.list_(pa.float64()))], ["y", "m"])


def fit(described: DataFrame, labels: DataFrame, label: Column, towards_pooled: float = 0.3, towards_diagonal: float = 0.1) -> Discriminant:
    """Fit on all rows of `described` that `labels` (doc_id) marks 0 or 1; other labels and nulls are no label."""
    marked = labels.select("doc_id", label.cast("int").alias("y")).where("y IN (0, 1)")
    rows = described.join(marked, "doc_id").select("x", "y")
    sums = rows.mapInArrow(_moments, "y int, m array<double>").select("y", F.posexplode("m").alias("at", "value")).groupBy("y", "at").agg(F.sum("value").alias("value")).collect()
    width, by = len(FEATURES), {}
    for k in {r.y for r in sums}:
        m = np.zeros((width + 1) ** 2)
        for r in sums:
            if r.y == k:
                m[r.at] = r.value
        m = m.reshape(width + 1, width + 1)
        by[k] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return fit_from_sums(by, width, towards_pooled, towards_diagonal)


def held_out(id_column: str = "doc_id") -> Column:
    """Rows that no label may be learnt from: crc32 of the id as text, mod 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_column).cast("string")), F.lit(3)) == 1, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, key (`text_key`), held_out, score (0 to 1, higher: quality likelier), predicted (score >= 0.5).

    `labels` has doc_id and quality. Scores depend on the text alone, so repeated rows and equal texts
    score alike. Null and empty texts get the score of an empty text, null ids are never labelled, an
    empty table gives no rows; without labels every score is that of one pooled class, a half. Other
    columns are ignored.
    """
    with rows_per_batch(docs.sparkSession, BATCH_ROWS):
        described = materialise(describe(docs, id_col, text_col), "statistics")
    model = fit(described, labels.where(~held_out()), F.col("quality"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(2).flatten().to_numpy().reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x))], ["doc_id", "key", "score"])

    scored = described.mapInArrow(score, "doc_id long, key long, score double")
    return scored.select("doc_id", "key", held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
