"""The offline plan: train on raw, score noised, calibrate, override, compare."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.operators.evaluate import (
    adaptive_threshold, compare_models, override_normal, percentile_threshold,
)
from perigee.operators.features import fit_scaler, scale
from perigee.operators.models import (
    AnomalyModel, score, score_sequences, train_anomaly, train_classifier, train_sequence_classifier,
)
from perigee.operators.sequences import labelled_sequences, require_dense
from perigee.session import materialize
from perigee.sources.artifacts import stats_map


@dataclass
class Evaluation:
    classifier: PipelineModel
    anomaly: AnomalyModel
    percentile: float
    adaptive: float
    predictions: DataFrame
    comparison: DataFrame


def fitted_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """The scaler of ``df``, worked out once: one row per feature, held as a local table."""
    return df.sparkSession.createDataFrame(fit_scaler(df, features).toArrow())


def scaled_sequences(
    scaler: DataFrame, df: DataFrame, features: Sequence[str], idx: str = "seq", label: str = "Label",
    length: int = fv.SEQUENCE_LENGTH,
) -> DataFrame:
    """Labelled sequences of ``df`` scaled by ``scaler``; ``idx`` must be dense."""
    require_dense(df, idx)
    scaled = scale(df, scaler, features, keep=[idx, label])
    return labelled_sequences(scaled, features, idx, label, length)


def evaluate(
    raw: DataFrame,
    noised: DataFrame,
    features: Sequence[str],
    idx: str = "seq",
    label: str = "Label",
    trees: int = fv.TREES,
    components: int = 8,
    calibration: DataFrame | None = None,
    sequence_model: bool = True,
) -> Evaluation:
    """Everything the offline comparison needs, with scored rows written once and reused.

    ``calibration`` gives the thresholds; left out, they come from the noised rows
    themselves, which leaks their labels and reproduces the usual figures.
    """
    classifier = train_classifier(raw, features, label, trees)
    scaler = fitted_scaler(raw, features)
    anomaly = train_anomaly(raw, features, label, components, scaler=stats_map(scaler, features))
    scored = materialize(
        anomaly.error(score(noised, classifier)).select(idx, label, "predicted_label", "confidence", "error"),
        "scored",
    )
    # Written before the thresholds go over them several times.
    held_out = scored if calibration is None else materialize(anomaly.error(calibration).select(label, "error"), "held-out")
    percentile = percentile_threshold(held_out, "error", label)
    adaptive = float(adaptive_threshold(held_out, "error", label).first()["threshold"])
    predictions = scored.select(
        idx, label, "error", "confidence",
        F.col("predicted_label").alias("model"),
        override_normal("predicted_label", "error", percentile).alias("ensemble"),
        override_normal("predicted_label", "error", adaptive).alias("tuned_ensemble"),
    )
    models = ["model", "ensemble", "tuned_ensemble"]
    if sequence_model:
        classes = raw.select(F.max(label)).first()[0] + 1
        network = train_sequence_classifier(
            scaled_sequences(scaler, raw, features, idx, label), fv.SEQUENCE_LENGTH, len(features), classes, label, idx=idx
        )
        by_sequence = score_sequences(scaled_sequences(scaler, noised, features, idx, label), network)
        predictions = predictions.join(by_sequence.select(idx, "sequence_pred"), idx, "left")
        models.append("sequence_pred")
    return Evaluation(
        classifier, anomaly, percentile, adaptive, predictions, compare_models(predictions, models, label)
    )
