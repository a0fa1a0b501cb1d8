"""Substring dedup over words by difference-cover anchors.

Grams are hashed only at word positions that are in a difference cover modulo ``PERIOD``: for any two
positions some shift below the period brings both into the cover.  Two equal windows therefore
share an equal gram at an aligned position inside both.  Anchors whose hash occurs once are dropped;
around the others the windows themselves are compared, and each but the first of its words is
removed.

Places travel as packed hashes (see ``repeats``); texts travel only to meet their own anchors.

Defined results: NULL and empty texts have no words; texts shorter than a window lose nothing.
Rows that agree in doc_id and text are one document.  Rows that share a doc_id only are ordered by a
hash of their text; a row without doc_id comes last.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar
from perigee.llm.repeats import BUCKET_BYTES, buckets_of, repeats
from perigee.session import materialize

WINDOW = 20
PERIOD = 13
COVER = (0, 1, 3, 9)
GRAM = WINDOW - PERIOD + 1
LAST = (1 << 63) - 1
# Two words take three bytes at least.
WORD_BUCKET_BYTES = 2 * BUCKET_BYTES


def _stretches(batch: pa.RecordBatch):
    """(first row, bytes, starts, ends, first word of each text, hashes) of a batch."""
    for at, _, data, bounds in ar.stretches(batch.column("text")):
        starts, ends, first = ar.word_spans(data, bounds, ar.NO_BLANK)
        yield at, data, starts, ends, first, ar.SpanHash(ar.word_hashes(data, starts, ends))


def _own(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and position in it of each word."""
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    return text, np.arange(int(first[-1])) - first[text]


def _anchors(batch: pa.RecordBatch):
    covered = np.isin(np.arange(PERIOD), COVER)
    for at, _, _, _, first, hashes in _stretches(batch):
        text, pos = _own(first)
        long_enough = np.diff(first)[text] >= WINDOW
        good = np.zeros(len(pos), bool)
        fits = ar.fits(first, GRAM)
        good[: len(fits)] = fits
        chosen = np.flatnonzero(good & long_enough & covered[pos % PERIOD])
        yield hashes(chosen, chosen + GRAM), text[chosen] + at, pos[chosen]


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column and the row of each."""
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(column)), counts)


def _windows(batch: pa.RecordBatch):
    values, rows = _lists(batch.column("anchors"))
    for at, _, _, _, first, hashes in _stretches(batch):
        n = len(first) - 1
        mine = (rows >= at) & (rows < at + n)
        anchor = first[rows[mine] - at] + values[mine]
        # A window is worth comparing if an anchor starts at one of its first PERIOD words.
        marks = np.zeros(int(first[-1]) + 1, np.int32)
        np.add.at(marks, anchor + 1, -1)
        np.add.at(marks, np.maximum(anchor - PERIOD + 1, 0), 1)
        near = np.cumsum(marks)[:-1] > 0
        fits = ar.fits(first, WINDOW)
        chosen = np.flatnonzero(near[: len(fits)] & fits)
        text, pos = _own(first)
        yield hashes(chosen, chosen + WINDOW), text[chosen] + at, pos[chosen]


def _whole(column: pa.Array) -> pa.Array:
    words, digests = [], []
    for t in column:
        parts = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
        words.append(len(parts))
        digests.append(hashlib.sha256(b" ".join(parts)).hexdigest())
    return pa.StructArray.from_arrays([pa.array(words, pa.int64()), pa.array(digests, pa.string())], ["n_words", "sha256"])


def _cut(column: pa.Array, windows: pa.Array) -> pa.Array:
    """Number of removed words and digest of the others."""
    removed, digests, spans = [], [], []
    for t, found in zip(column, windows):
        parts = (t.as_py() or "").encode("utf-8", "surrogatepass").split()
        begin = np.unique(np.array(found.as_py(), np.int64))
        a, b = ar.union_of_spans(begin, begin + WINDOW)
        gone = np.zeros(len(parts) + 1, np.int32)
        gone[a] += 1
        np.add.at(gone, b, -1)
        gone = np.cumsum(gone)[:-1] > 0
        removed.append(int(gone.sum()))
        digests.append(hashlib.sha256(b" ".join(parts[i] for i in np.flatnonzero(~gone).tolist())).hexdigest())
        spans.append(np.stack([a, b], 1).ravel().tolist())
    return pa.StructArray.from_arrays(
        [pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(spans, pa.list_(pa.int64()))],
        ["n_removed", "sha256", "spans"],
    )


def removed_words(docs: DataFrame, bucket_bytes: int = WORD_BUCKET_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_sha256) for each row of (doc_id, text); spans are start and end words in turn.

    ``bucket_bytes`` is the text behind a bucket of hashes.
    """
    base = docs.select(
        "doc_id", "text", F.xxhash64("doc_id", "text").alias("row"), F.coalesce("doc_id", F.lit(LAST)).alias("ord")
    )
    anchors = repeats(base.select("row", "text"), _anchors, buckets_of(docs, bucket_bytes)).select("row", F.col("pos").alias("anchors"))
    held = materialize(base.join(anchors, "row").select("row", "ord", "text", "anchors"), "cover-held")
    windows = repeats(held, _windows, buckets_of(held, bucket_bytes), later=True).select("row", F.col("pos").alias("windows"))
    cut = held.select("row", "text").join(windows, "row").select("row", F.arrow_udf(
        _cut, "n_removed BIGINT, sha256 STRING, spans ARRAY<BIGINT>")("text", "windows").alias("c"))
    cut = cut.dropDuplicates(["row"])
    whole = base.select("doc_id", "row", F.arrow_udf(_whole, "n_words BIGINT, sha256 STRING")("text").alias("w"))
    return whole.join(cut, "row", "left").select(
        "doc_id", "w.n_words", F.coalesce("c.n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("c.spans", F.array().cast("array<bigint>")).alias("spans"),
        F.coalesce("c.sha256", "w.sha256").alias("kept_sha256"),
    )
