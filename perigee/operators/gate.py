"""Nominal statistics and the escalation gate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.numeric import abs_z, present, sum_balanced

Stats = Mapping[str, tuple[float, float]]


def normal_rows(df: DataFrame, label: str = "Label", normal: int = fv.NORMAL_LABEL) -> DataFrame:
    return df.where(F.col(label) == normal)


def column_stats(df: DataFrame, features: Sequence[str], ddof: int = 1) -> DataFrame:
    """``(feature, mean, std)`` over all rows, missing values skipped.

    One aggregate row with a map-side part, then turned long: no unpivot of the data.
    """
    spread = F.stddev_samp if ddof else F.stddev_pop
    wide = df.agg(*[
        F.struct(
            F.lit(name).alias("feature"),
            F.avg(present(F.col(name).cast("double"))).alias("mean"),
            spread(present(F.col(name).cast("double"))).alias("std"),
        ).alias(f"s{i}")
        for i, name in enumerate(features)
    ])
    return wide.select(F.inline(F.array(*[F.col(f"s{i}") for i in range(len(features))])))


def baseline_stats(
    df: DataFrame, features: Sequence[str], label: str = "Label", normal: int = fv.NORMAL_LABEL
) -> DataFrame:
    """Mean and sample deviation of each feature over the Normal rows."""
    return column_stats(normal_rows(df, label, normal), features)


def tripped_count(stats: Stats, features: Sequence[str], z_threshold: float = fv.Z_THRESHOLD) -> Column:
    """How many features deviate by more than ``z_threshold``; a missing value never does."""
    return sum_balanced([
        F.when(F.coalesce(abs_z(name, *stats[name]) > z_threshold, F.lit(False)), 1).otherwise(0)
        for name in features
    ])


def escalates(
    stats: Stats,
    features: Sequence[str],
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
) -> Column:
    return tripped_count(stats, features, z_threshold) >= min_features


def gate(
    df: DataFrame,
    stats: Stats,
    features: Sequence[str],
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
) -> DataFrame:
    """Adds ``tripped`` and ``escalate``; the same plan on a batch and on a stream."""
    counted = df.withColumn("tripped", tripped_count(stats, features, z_threshold))
    return counted.withColumn("escalate", F.col("tripped") >= min_features)


def escalated_rows(
    df: DataFrame,
    stats: Stats,
    features: Sequence[str],
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
    observation: Observation | None = None,
) -> DataFrame:
    """Only the rows worth scoring.

    With an ``observation`` the counts of rows seen and escalated come out of the same
    pass, as a by-product of whatever action runs later.
    """
    gated = gate(df, stats, features, z_threshold, min_features)
    if observation is not None:
        gated = gated.observe(
            observation,
            F.count(F.lit(1)).alias("seen"),
            F.coalesce(F.sum(F.col("escalate").cast("long")), F.lit(0)).alias("escalated"),
        )
    return gated.where("escalate").drop("tripped", "escalate")


def escalation_rate(gated: DataFrame, label: str = "Label") -> DataFrame:
    """Escalated, total and ratio per label."""
    return gated.groupBy(label).agg(
        F.sum(F.col("escalate").cast("long")).alias("escalated"),
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("escalate").cast("double")).alias("rate"),
    )


def feature_z(df: DataFrame, stats: DataFrame, features: Sequence[str], ids: Sequence[str]) -> DataFrame:
    """Long form ``(*ids, feature, value, z)``: one row per value, joined to its statistics.

    A narrow plan: the unpivot is row-local and the statistics side is one row per
    feature, so nothing is shuffled.
    """
    long = df.select(*ids, *[F.col(name).cast("double").alias(name) for name in features]).unpivot(
        list(ids), list(features), "feature", "value"
    )
    z = F.when(F.col("std") != 0, F.abs(present("value") - F.col("mean")) / F.nullif(F.col("std"), F.lit(0.0)))
    return long.join(stats, "feature", "left").select(*ids, "feature", "value", z.alias("z"))
