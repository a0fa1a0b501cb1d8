"""Non-linear reconstruction: a small network that squeezes scaled rows through a narrow layer and rebuilds them.

Training goes in rounds.  In each, every task sums loss and gradient over its rows and hands on one row of sums;
the driver adds as many such rows as there are pieces and moves the weights (Adam).  Rows are dealt by value into a fixed number of
pieces, so the model follows the cluster only in the rounding of scaler and axes.  The network starts as the linear reconstruction and the best round is
kept: on the training rows it is never worse than the principal axes it began with.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.operators.features import scaled_columns
from perigee.operators.models import TRAIN_PARTITIONS, AnomalyModel, train_anomaly
from perigee.session import fixed_partitions, materialize

HIDDEN = 16
ROUNDS = 60
STEP = 0.01
Weights = list[tuple[np.ndarray, np.ndarray]]


def forward(weights: Weights, rows: np.ndarray) -> list[np.ndarray]:
    """Rows as they leave each layer; all but the last layer cut below zero."""
    out = [rows]
    for at, (matrix, shift) in enumerate(weights):
        value = out[-1] @ matrix + shift
        out.append(np.maximum(value, 0.0) if at < len(weights) - 1 else value)
    return out


def row_errors(weights: Weights, rows: np.ndarray) -> np.ndarray:
    return ((forward(weights, rows)[-1] - rows) ** 2).mean(axis=1)


def sums(weights: Weights, rows: np.ndarray) -> np.ndarray:
    """Number of rows, sum of their errors, and the sum of the gradients of all weights, in one vector."""
    layers = forward(weights, rows)
    gap = layers[-1] - rows
    back = 2.0 * gap / rows.shape[1]
    parts: list[np.ndarray] = []
    for at in range(len(weights) - 1, -1, -1):
        parts[:0] = [(layers[at].T @ back).ravel(), back.sum(axis=0)]
        if at:
            back = (back @ weights[at][0].T) * (layers[at] > 0)
    return np.concatenate([[float(len(rows)), float((gap**2).mean(axis=1).sum())], *parts])


def flat(weights: Weights) -> np.ndarray:
    return np.concatenate([part.ravel() for layer in weights for part in layer])


def shaped(values: np.ndarray, like: Weights) -> Weights:
    out, at = [], 0
    for matrix, shift in like:
        out.append((values[at : at + matrix.size].reshape(matrix.shape), values[at + matrix.size : at + matrix.size + shift.size]))
        at += matrix.size + shift.size
    return out


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return np.stack([column.to_numpy(zero_copy_only=False) for column in batch.columns], axis=1)


def gradient_sums(rows: DataFrame, weights: Weights) -> np.ndarray:
    """``sums`` over a whole table of double columns without gaps; one row of sums per partition reaches the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, piece = None, np.inf
        for batch in batches:
            if batch.num_rows:
                values = _matrix(batch)
                # Partitions are told apart by their first row, so that they add up in one order.
                piece = values[0].sum() if total is None else piece
                part = sums(weights, values)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([total.tolist()])], ["piece", "sums"])

    parts = rows.mapInArrow(add, "piece double, sums array<double>").toArrow().sort_by("piece")
    return np.array(parts["sums"].to_pylist()).sum(axis=0) if len(parts) else np.zeros(2 + flat(weights).size)


def linear_start(axes: np.ndarray, low: np.ndarray, spread: np.ndarray, mean: np.ndarray, hidden: int, seed: int) -> Weights:
    """Weights that rebuild rows as the axes do, as long as their projections are not below ``low``; spare units start idle.

    Projections are shifted and scaled to be positive, so cutting below zero changes nothing.
    """
    k, width = axes.shape
    draw = np.random.default_rng(seed)
    spare = max(hidden, k) - k
    code = (mean - low) / spread
    into = draw.standard_normal((k, spare)) / np.sqrt(max(1, k))
    return [
        (np.hstack([axes.T / spread, draw.standard_normal((width, spare)) / np.sqrt(width)]), np.concatenate([-low / spread, np.zeros(spare)])),
        (np.vstack([np.eye(k), np.zeros((spare, k))]), np.zeros(k)),
        (np.hstack([np.eye(k), into]), np.concatenate([np.zeros(k), draw.standard_normal(spare) / 2 - code @ into])),
        (np.vstack([axes * spread[:, None], np.zeros((spare, width))]), low @ axes),
    ]


class Autoencoder:
    """Scaler, centre and weights; ``losses`` holds the mean error of the training rows before each round."""

    def __init__(self, linear: AnomalyModel, weights: Weights, losses: list[float]) -> None:
        self.linear = linear
        self.features = linear.features
        self.weights = weights
        self.losses = losses

    def error(self, df: DataFrame, out: str = "error") -> DataFrame:
        """Adds the mean squared reconstruction error: NULL where a feature is missing."""
        weights = self.weights

        @F.arrow_udf("double")
        def measured(rows: pa.Array) -> pa.Array:
            known = rows.drop_null()
            found = np.full(len(rows), np.nan)
            kept = ~rows.is_null().to_numpy(zero_copy_only=False)
            if len(known):
                found[kept] = row_errors(weights, known.flatten().to_numpy(zero_copy_only=False).reshape(len(known), -1))
            return pa.array(found, mask=~kept)

        columns = _centred(self.linear)
        whole = F.array(*columns)
        known = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x))
        return df.withColumn(out, measured(F.when(known, whole)))


def _centred(linear: AnomalyModel) -> list:
    scaled = scaled_columns(linear.scaler, linear.features)
    return [(column - F.lit(linear.centre[name])).alias(name) for name, column in zip(linear.features, scaled)]


def train_autoencoder(
    raw: DataFrame, features: Sequence[str], label: str = "Label", components: int = 8, normal: int = fv.NORMAL_LABEL,
    scaler: Mapping[str, tuple[float, float]] | None = None, hidden: int = HIDDEN, rounds: int = ROUNDS, step: float = STEP,
    seed: int = fv.SEED, partitions: int = TRAIN_PARTITIONS,
) -> Autoencoder:
    """Layers features - ``hidden`` - ``components`` - ``hidden`` - features, fitted on all Normal rows.

    A missing feature counts as its mean.  The driver holds the weights and ``partitions`` rows of sums.
    Without Normal rows the network stays the start.
    """
    linear = train_anomaly(raw, features, label, components, normal, scaler)
    columns = [F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)).alias(name) for name, c in zip(features, _centred(linear))]
    rows = materialize(raw.where(F.col(label) == normal).select(*columns), "autoencoder-rows")
    axes = np.array(linear.components)
    projected = [sum(F.col(name) * F.lit(float(w)) for name, w in zip(features, axis)) for axis in axes]
    measured = rows.agg(*[F.array(F.min(p), F.stddev_pop(p), F.avg(p)).alias(f"p{i}") for i, p in enumerate(projected)]).first()
    low, spread, mean = np.array([[np.nan if x is None else x for x in part] for part in measured]).T
    low, mean = np.nan_to_num(low), np.nan_to_num(mean)
    spread = np.where(np.nan_to_num(spread) > 0, spread, 1.0)
    weights = linear_start(axes, low, spread, mean, hidden, seed)
    dealt = fixed_partitions(rows, partitions, *features).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        best, losses = _descend(dealt, weights, rounds, step)
    finally:
        dealt.unpersist()
    return Autoencoder(linear, best, losses)


def _descend(rows: DataFrame, weights: Weights, rounds: int, step: float) -> tuple[Weights, list[float]]:
    """Adam over whole sums; the weights of the least loss, and the loss before each round."""
    now = flat(weights)
    best, least, losses = now, np.inf, []
    drift, size = np.zeros_like(now), np.zeros_like(now)
    for turn in range(1, rounds + 2):
        total = gradient_sums(rows, shaped(now, weights))
        if not total[0]:
            break
        losses.append(float(total[1] / total[0]))
        if losses[-1] < least:
            best, least = now, losses[-1]
        if turn > rounds:
            break
        slope = total[2:] / total[0]
        drift, size = 0.9 * drift + 0.1 * slope, 0.999 * size + 0.001 * slope**2
        now = now - step * (drift / (1 - 0.9**turn)) / (np.sqrt(size / (1 - 0.999**turn)) + 1e-8)
    return shaped(best, weights), losses
