"""Evaluation of predictions: confusion, accuracy, macro F1, thresholds, overrides."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.numeric import abs_z, as_column
from perigee.operators.gate import Stats
from perigee.operators.order import exact_percentiles

# Accuracy of a KLL sketch: 16 kB or so, whatever the number of rows.
SKETCH_K = 2000


def confusion(df: DataFrame, label: str = "Label", pred: str = "pred") -> DataFrame:
    """Row counts by (true, predicted): the only pass over data any metric here needs."""
    return (
        df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
        .groupBy(F.col(label).cast("int").alias("truth"), F.col(pred).cast("int").alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def confusion_matrix(counts: DataFrame, classes: Sequence[int]) -> DataFrame:
    return counts.groupBy("truth").pivot("predicted", list(classes)).agg(F.sum("n")).na.fill(0)


def class_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of every class that is true or predicted somewhere.

    An empty denominator gives 0, as the unweighted mean over classes expects.
    """
    hit = F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(*by, F.inline(F.array(
        F.struct(F.col("truth").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("claimed"),
                 hit.cast("long").alias("hits")),
        F.struct(F.col("predicted").alias("class"), F.lit(0).cast("long").alias("support"),
                 F.col("n").alias("claimed"), F.lit(0).cast("long").alias("hits")),
    )))
    totals = sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hits").alias("hits")
    )

    def ratio(top: Column, bottom: Column) -> Column:
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    return totals.select(
        *by,
        "class",
        "support",
        ratio(F.col("hits"), F.col("claimed")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("support") + F.col("claimed")).alias("f1"),
    )


def overall_metrics(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows, accuracy and macro F1, from the class metrics alone."""
    return class_metrics(counts, by).groupBy(*by).agg(
        F.sum("support").alias("rows"),
        (F.sum(F.col("recall") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
    )


def accuracy(df: DataFrame, label: str = "Label", pred: str = "pred") -> DataFrame:
    both = df.where(F.col(label).isNotNull() & F.col(pred).isNotNull())
    return both.agg(F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def compare_models(df: DataFrame, models: Sequence[str], label: str = "Label") -> DataFrame:
    """Accuracy and macro F1 of each prediction column.

    Counts distinct (label, predictions...) combinations first and only then turns them
    long, so the data is never multiplied by the number of models.
    """
    combos = (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("int").alias("truth"), *[F.col(m).cast("int").alias(m) for m in models])
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = (
        combos.unpivot(["truth", "n"], list(models), "model", "predicted")
        .where(F.col("predicted").isNotNull())
        .groupBy("model", "truth", "predicted").agg(F.sum("n").alias("n"))
    )
    return overall_metrics(counts, ["model"])


def percentile_threshold(
    calibration: DataFrame, error: str = "error", label: str = "Label",
    share: float = fv.CALIBRATION_PERCENTILE, normal: int = fv.NORMAL_LABEL,
) -> float:
    """Interpolated percentile of the errors of Normal rows; exact at any size."""
    rows = calibration.where(F.col(label) == normal)
    found = exact_percentiles(rows, error, [share], label)
    return found[normal][0] if normal in found else math.nan


def threshold_sketches(
    calibration: DataFrame, batch: str, error: str = "error", label: str = "Label", k: int = SKETCH_K, normal: int = fv.NORMAL_LABEL,
) -> DataFrame:
    """(batch, sketch): a KLL sketch of the errors of the Normal rows of each batch, to be stored and merged later.

    NULL and NaN errors are left out.  A batch without Normal rows has no row.
    """
    value = F.col(error).cast("double")
    kept = calibration.where((F.col(label) == normal) & value.isNotNull() & ~F.isnan(value))
    return kept.groupBy(batch).agg(F.kll_sketch_agg_double(value, F.lit(k)).alias("sketch"))


def merged_threshold(sketches: DataFrame, share: float = fv.CALIBRATION_PERCENTILE, k: int = SKETCH_K) -> DataFrame:
    """One row (n, threshold) from stored sketches: an error whose rank is near ``share``, without reading a row again.

    The rank is off by about 3 / k of all rows at most (99 %); ``percentile_threshold`` gives the exact value.  No sketches: NULL.
    """
    merged = sketches.agg(F.kll_merge_agg_double("sketch", F.lit(k)).alias("s"), F.count(F.lit(1)).alias("batches"))
    some = F.col("batches") > 0
    return merged.select(
        F.when(some, F.kll_sketch_get_n_double("s")).alias("n"),
        F.when(some, F.kll_sketch_get_quantile_double("s", F.lit(float(share)))).alias("threshold"),
    )


def adaptive_threshold(
    calibration: DataFrame, error: str = "error", label: str = "Label",
    sigmas: float = fv.CALIBRATION_SIGMAS, normal: int = fv.NORMAL_LABEL,
) -> DataFrame:
    """Mean plus ``sigmas`` population deviations of the errors of Normal rows, as one row."""
    return calibration.where(F.col(label) == normal).agg(
        (F.avg(error) + F.lit(sigmas) * F.stddev_pop(error)).alias("threshold")
    )


def override_normal(
    pred: Column | str, error: Column | str, threshold: Column | float, normal: int = fv.NORMAL_LABEL
) -> Column:
    """Class Normal where the error lies strictly below the threshold; NaN is below nothing."""
    error = as_column(error)
    threshold = F.lit(threshold) if isinstance(threshold, float) else threshold
    below = (error < threshold) & ~F.isnan(error) & ~F.isnan(threshold)
    return F.when(below, F.lit(normal)).otherwise(as_column(pred))


def misclassified_drivers(
    df: DataFrame, stats: Stats, features: Sequence[str], truth: int, predicted: int,
    label: str = "Label", pred: str = "pred", top: int = 15,
) -> DataFrame:
    """Features ranked by mean |z| among rows of class ``truth`` predicted as ``predicted``."""
    wrong = df.where((F.col(label) == truth) & (F.col(pred) == predicted))
    wide = wrong.agg(*[
        F.struct(F.lit(name).alias("feature"), F.avg(abs_z(name, *stats[name])).alias("mean_abs_z")).alias(f"f{i}")
        for i, name in enumerate(features)
    ])
    long = wide.select(F.inline(F.array(*[F.col(f"f{i}") for i in range(len(features))])))
    return long.where(F.col("mean_abs_z").isNotNull()).orderBy(F.col("mean_abs_z").desc(), "feature").limit(top)
