"""Calibration artefacts kept as small tables: baseline statistics, feature manifest, models."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee.sources.dims import local_table


def save_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def load_stats(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema("feature string, mean double, std double").format(fmt).load(path)


def load_nested_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics kept as one JSON object ``{feature: {mean, std}}``, as a long table."""
    whole = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, struct<mean: double, std: double>>")
    return whole.select(F.explode(parsed).alias("feature", "s")).select("feature", "s.mean", "s.std")


def load_json_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A feature order kept as one JSON array, as ``(pos, feature)``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.from_json("value", "array<string>")).alias("pos", "feature"))


def stats_map(stats: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """The statistics of ``features`` on the driver: one row per feature, used as literals."""
    rows = stats.where(F.col("feature").isin(list(features))).select("feature", "mean", "std").collect()
    found = {row["feature"]: (row["mean"], row["std"]) for row in rows}
    missing = [name for name in features if name not in found]
    if missing:
        raise ValueError(f"no baseline statistics for {missing}")
    return found


def manifest(spark: SparkSession, features: Sequence[str]) -> DataFrame:
    return local_table(spark, {"pos": pa.int32(), "feature": pa.string()}, list(enumerate(features)))


def load_manifest(spark: SparkSession, path: str, fmt: str = "parquet") -> list[str]:
    rows = spark.read.schema("pos int, feature string").format(fmt).load(path)
    return [row["feature"] for row in rows.orderBy("pos").collect()]


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
