"""Quality by regularised quadratic discriminant analysis over document statistics.

A text becomes ``FEATURES`` numbers, transformed towards normal shape.  Class means and covariances
come from sums over all labelled texts, built up in the tasks.  Covariances are shrunk towards
the pooled one and its diagonal, their Cholesky factors are computed once, and the score is the
logistic function of the difference of the two log densities (Mahalanobis distances, volumes and
class shares).

Defined results: NULL and empty texts have the statistics of an empty text.  NULL labels are not
learnt from.  With one class or none among the labels the score is the share of label 1 (0.5
without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar

FEATURES = (
    "log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "repeats_previous", "symbols", "bars",
    "digits", "capitals", "stops", "log_line_words", "symbol_words", "single_byte_words",
)
THRESHOLD = 0.3
POOL = 0.1
DIAGONAL = 0.1
FLOOR = 1e-3
SYMBOL = ar.byte_set(b"#$%&*+<=>@[\\]^_`{|}~/")
STOP = ar.byte_set(b".,;:!?")
DIGIT = ar.byte_set(b"0123456789")
CAPITAL = ar.byte_set(bytes(range(65, 91)))


def _per_text(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the values between consecutive bounds."""
    return np.diff(np.concatenate([[0], np.cumsum(values, dtype=np.float64)])[bounds])


def _statistics(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One row of FEATURES per text."""
    starts, ends, first = ar.word_spans(data, bounds, ar.NO_BLANK)
    n_bytes, n_words = np.diff(bounds).astype(float), np.diff(first).astype(float)
    some_bytes, some_words = np.maximum(n_bytes, 1), np.maximum(n_words, 1)
    length = (ends - starts).astype(float)
    text = np.repeat(np.arange(len(n_words)), np.diff(first))
    hashes = ar.word_hashes(data, starts, ends)
    distinct = np.unique(ar.mix(hashes + text.astype(ar.U64) * ar.U64(ar.BASE)), return_index=True)[1]
    again = np.zeros(len(starts), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
    mean = _per_text(length, first) / some_words
    spread = np.sqrt(np.maximum(_per_text(length * length, first) / some_words - mean * mean, 0))
    share = lambda table: np.sqrt(_per_text(table[data], bounds) / some_bytes)
    lines = _per_text(data == 10, bounds) + 1
    last = SYMBOL[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    return np.stack([
        np.log1p(n_bytes), np.log1p(n_words), np.log1p(mean), np.log1p(spread),
        (np.bincount(text[distinct], minlength=len(n_words)) / some_words) ** 0.5,
        np.sqrt(_per_text(again, first) / some_words), share(SYMBOL), share(ar.byte_set(b"|")), share(DIGIT), share(CAPITAL),
        share(STOP), np.log1p(n_words / lines), np.sqrt(_per_text(last, first) / some_words),
        np.sqrt(_per_text(length == 1, first) / some_words),
    ], axis=1)


def _statistics_column(column: pa.Array) -> pa.Array:
    rows = [_statistics(data, bounds) for _, _, data, bounds in ar.stretches(column)]
    flat = np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))
    return ar.list_array(flat.ravel(), np.full(len(flat), len(FEATURES)), pa.float64())


def statistics(text: Column) -> Column:
    """The statistics of a text, as an array in the order of FEATURES."""
    return F.arrow_udf(_statistics_column, "array<double>")(text)


@dataclass
class Model:
    prior: float
    classes: list[tuple[np.ndarray, np.ndarray]]  # mean and inverse of the Cholesky factor, label 0 first

    def score(self, stats: Column) -> Column:
        prior, classes = self.prior, self.classes

        @F.arrow_udf("double")
        def of(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            log_density = [
                np.log(np.diag(inverse)).sum() - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse in classes
            ]
            logit = prior + (log_density[1] - log_density[0] if classes else np.zeros(len(x)))
            return pa.array(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

        return of(stats)


def _sums(tables):
    """Per class: count, sums and products of the statistics of the rows of one task."""
    d = len(FEATURES) + 1
    total = {}
    for t in tables:
        x = t["x"].combine_chunks() if isinstance(t["x"], pa.ChunkedArray) else t["x"]
        x = np.concatenate([np.ones((t.num_rows, 1)), x.flatten().to_numpy().reshape(t.num_rows, -1)], axis=1)
        label = t["label"].to_numpy()
        for c in set(label.tolist()):
            total[c] = total.get(c, 0) + x[label == c].T @ x[label == c]
    at = np.arange(d * d, dtype=np.int32)
    for c, products in total.items():
        yield pa.RecordBatch.from_pydict({"label": np.full(d * d, c, np.int32), "at": at, "value": products.ravel()})


def fit(rows: DataFrame) -> Model:
    """Learns from all (x, label) rows: statistics and label 0 or 1."""
    rows = rows.where("label IN (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    parts = rows.mapInArrow(_sums, "label int, at int, value double")
    d = len(FEATURES) + 1
    found = {}
    for label, at, value in parts.groupBy("label", "at").agg(F.sum("value")).collect():
        found.setdefault(label, np.zeros(d * d))[at] = value
    n = {c: m[0] for c, m in found.items()}
    if len(n) < 2:
        share = n.get(1, 0) / sum(n.values()) if n else 0.5
        return Model(float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), [])
    mean, cov = {}, {}
    for c, m in found.items():
        m = m.reshape(d, d) / n[c]
        mean[c] = m[0, 1:]
        cov[c] = m[1:, 1:] - np.outer(mean[c], mean[c])
    pooled = sum(n[c] * cov[c] for c in cov) / sum(n.values())
    scale = np.diag(np.diag(pooled) + FLOOR * max(np.trace(pooled) / (d - 1), 1e-12))
    classes = []
    for c in (0, 1):
        shrunk = (1 - POOL - DIAGONAL) * cov[c] + POOL * pooled + DIAGONAL * scale
        classes.append((mean[c], np.linalg.inv(np.linalg.cholesky(shrunk))))
    return Model(float(np.log(n[1] / n[0])), classes)
