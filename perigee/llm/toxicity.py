"""Toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text is the set of its byte n-grams (lower-cased, hashed).  The log ratio of a gram's share among
toxic and among clean texts scales it; a logistic regression over the scaled grams is fitted on
at most ``max_per_class`` labelled texts of each class, those first in a seeded order, and its
intercept is moved to the label shares of all labelled rows with a text.  Only the ``KEPT_FEATURES`` grams with the best
supported ratios have a weight.  The sample's gram sets are written once
and counted by Spark; the driver gets counts of at most ``1 << TABLE_BITS`` grams and, of each text, the grams kept.  The fitted weights are one table of
``1 << TABLE_BITS`` numbers, which goes to the tasks; texts are scored where they are read.

Defined results: NULL and empty texts get the score of no grams.  Labels without a text, texts without
a label and NULL labels are not learnt from.  With one class or none among the labels the score
is the share of toxic labels (0.5 without labels).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar
from perigee.session import materialize

GRAMS = (4, 5, 6, 7, 8)
TABLE_BITS = 20
MAX_PER_CLASS = 2000
THRESHOLD = 0.3
KEPT_FEATURES = 1 << 13
COUNT_PIECE = 1 << 14
SMOOTHING = 1.0
PENALTY = 1e-6
STEPS = 600


def _gram_ids(data: np.ndarray) -> np.ndarray:
    """Hashed ids of all grams of one text, with repeats; a blank stands before and after the text."""
    wide = np.empty(len(data) + 2, np.uint64)
    wide[0] = wide[-1] = 32
    wide[1:-1] = data
    out, value = [], wide
    for n in range(2, max(GRAMS) + 1):
        if len(wide) < n:
            break
        value = value[:-1] | (wide[n - 1 :] << np.uint64(8 * (n - 1)))
        if n in GRAMS:
            out.append(((value * np.uint64(ar.BASE + 2 * n)) >> np.uint64(64 - TABLE_BITS)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


def _distinct(ids: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Each id once; ``mark`` is scratch space of the size of the table."""
    at = np.arange(len(ids), dtype=np.int32)
    mark[ids] = at
    return ids[mark[ids] == at]


def _texts(column: pa.Array):
    data, bounds = ar.utf8(column)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield ar.LOWER[data[a:b]]


def _gram_sets(column: pa.Array) -> pa.Array:
    mark = np.zeros(1 << TABLE_BITS, np.int32)
    sets = [np.sort(_distinct(_gram_ids(t), mark)) for t in _texts(column)]
    return ar.list_array(np.concatenate(sets) if sets else np.zeros(0, np.int32), np.array([len(s) for s in sets], np.int64), pa.int32())


@dataclass
class Model:
    """Weight and squared scale of each gram, and the intercept.

    A text is the sum of the weights of its grams over the length of its scaled set (1 added, so that
    next to no evidence stays next to none).
    """

    weights: np.ndarray
    squares: np.ndarray
    intercept: float

    def score(self, spark, text: Column) -> Column:
        sent = spark.sparkContext.broadcast((self.weights, self.squares, self.intercept))

        @F.arrow_udf("double")
        def of(column: pa.Array) -> pa.Array:
            weights, squares, intercept = sent.value
            mark = np.zeros(len(weights), np.int32)
            logits = np.empty(len(column))
            for i, text_ in enumerate(_texts(column)):
                ids = _distinct(_gram_ids(text_), mark)
                logits[i] = weights[ids].sum(dtype=np.float64) / np.sqrt(1 + squares[ids].sum(dtype=np.float64))
            return pa.array(1 / (1 + np.exp(-np.clip(logits + intercept, -30, 30))))

        return of(text)


def _strongest(counts: pa.Table, n: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The grams whose log-count ratio is best supported, and their ratios; the rest is noise."""
    gram, toxic, clean = (counts[name].to_numpy() for name in ("gram", "toxic", "clean"))
    ratio = np.log((toxic + SMOOTHING) / (n[1] + 2 * SMOOTHING)) - np.log((clean + SMOOTHING) / (n[0] + 2 * SMOOTHING))
    strength = np.abs(ratio) * np.sqrt(toxic + clean)
    order = np.lexsort((gram, -strength))[:KEPT_FEATURES]
    return gram[order], ratio[order]


def _counts(batches):
    """Of the grams of one task: in how many toxic and clean texts each occurs, in pieces of COUNT_PIECE grams."""
    seen = np.zeros((2, 1 << TABLE_BITS), np.int32)
    for batch in batches:
        grams = batch.column("grams")
        toxic = np.repeat(batch.column("toxic").to_numpy(), grams.value_lengths().to_numpy(zero_copy_only=False)) == 1
        flat = grams.flatten().to_numpy(zero_copy_only=False)
        for c in (0, 1):
            # A text holds a gram once, but a batch holds many texts.
            np.add.at(seen[c], flat[toxic == c], 1)
    pieces = seen.reshape(2, -1, COUNT_PIECE)
    for k in np.flatnonzero(pieces.any(axis=(0, 2))).tolist():
        yield pa.RecordBatch.from_pydict({
            "piece": pa.array([k], pa.int32()), "clean": pa.array([pieces[0, k].tobytes()], pa.binary()),
            "toxic": pa.array([pieces[1, k].tobytes()], pa.binary()),
        })


def _summed(table: pa.Table) -> pa.Table:
    """The grams of one piece that occur, with their counts over all tasks."""
    clean, toxic = (
        np.sum([np.frombuffer(b, np.int32) for b in table[name].to_pylist()], axis=0, dtype=np.int64) for name in ("clean", "toxic")
    )
    at = np.flatnonzero(clean + toxic)
    return pa.table({"gram": at + table["piece"][0].as_py() * COUNT_PIECE, "toxic": toxic[at], "clean": clean[at]})


def _only(kept: np.ndarray):
    """UDF: the places in ``kept`` of the grams of a text that are there."""
    place = np.full(1 << TABLE_BITS, -1, np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)

    def of(column: pa.Array) -> pa.Array:
        found = place[column.flatten().to_numpy(zero_copy_only=False)]
        row = np.repeat(np.arange(len(column)), column.value_lengths().to_numpy(zero_copy_only=False))
        return ar.list_array(found[found >= 0], np.bincount(row[found >= 0], minlength=len(column)), pa.int32())

    return F.arrow_udf(of, "array<int>")


def _regress(col: np.ndarray, counts: np.ndarray, toxic: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression in which both classes weigh the same, by accelerated gradient steps."""
    n, width = len(toxic), len(scale)
    row = np.repeat(np.arange(n), counts)
    value = scale[col]
    value /= np.sqrt(1 + np.bincount(row, value * value, minlength=n))[row]
    weight = np.where(toxic == 1, 0.5 / toxic.sum(), 0.5 / (n - toxic.sum()))
    # Rows are shorter than 1, so half bounds the curvature, intercept included.
    bound = 0.5 + PENALTY
    w, b = np.zeros(width), 0.0
    vw, vb, t = w, b, 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, value * vw[col], minlength=n) + vb, -30, 30)))
        g = weight * (p - toxic)
        nw = vw - (np.bincount(col, value * g[row], minlength=width) + PENALTY * vw) / bound
        nb = vb - g.sum() / bound
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w * scale, b


def fit(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS, seed: str = "toxicity-1") -> Model:
    """Learns from (doc_id, text) and (doc_id, toxic); ``labels`` holds only rows that may be learnt from."""
    labels = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    # Labels without a text would use up places of the sample.
    labels = materialize(labels.join(docs.where("text IS NOT NULL").select("doc_id"), "doc_id", "left_semi"), "toxicity-labels")
    counts = dict(labels.groupBy("toxic").count().collect())
    n = sum(counts.values())
    if len(counts) < 2:
        share = counts.get(1, 0) / n if n else 0.5
        return Model(*np.zeros((2, 1 << TABLE_BITS), np.float32), float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30)))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    chosen = labels.where("toxic = 0").orderBy(order, "doc_id").limit(max_per_class).unionAll(
        labels.where("toxic = 1").orderBy(order, "doc_id").limit(max_per_class)
    ).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # At most 2 * max_per_class rows of two numbers: the bound that allows the broadcast.
    sample = materialize(
        docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
        .select("doc_id", "toxic", F.arrow_udf(_gram_sets, "array<int>")("text").alias("grams")), "toxicity-sample",
    )
    size = dict(sample.groupBy("toxic").count().collect())
    if len(size) < 2:
        return Model(*np.zeros((2, 1 << TABLE_BITS), np.float32), float(np.log(counts[1] / counts[0])))
    # One row per gram that occurs, never more than the table has places.
    parts = sample.select("toxic", "grams").mapInArrow(_counts, "piece int, clean binary, toxic binary")
    found = parts.groupBy("piece").applyInArrow(_summed, "gram long, toxic long, clean long").toArrow()
    kept, ratio = _strongest(found, (size[0], size[1]))
    rows = sample.select("doc_id", "toxic", _only(kept)("grams").alias("places")).toArrow().sort_by([("doc_id", "ascending")])
    places = rows["places"].combine_chunks()
    fitted, intercept = _regress(
        places.flatten().to_numpy(), places.value_lengths().to_numpy(), rows["toxic"].to_numpy().astype(float), ratio
    )
    weights, squares = np.zeros((2, 1 << TABLE_BITS), np.float32)
    weights[kept], squares[kept] = fitted, ratio * ratio
    return Model(weights, squares, float(intercept + np.log(counts[1] / counts[0])))
