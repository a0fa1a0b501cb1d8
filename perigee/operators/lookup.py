"""Joins of telemetry to small dimension tables: classes, taxonomy, policy."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.incident import autonomous

MAPPING_COLUMNS = ["tactic_id", "tactic_name", "technique_id", "technique_name"]


def with_class_name(df: DataFrame, classes: DataFrame, label: str) -> DataFrame:
    """Adds ``class_name`` for the label; NULL for a label without a class."""
    names = classes.select(F.col("label").alias("_label"), F.col("class_name"))
    return df.join(names, df[label] == names["_label"], "left").drop("_label")


def class_mappings(knowledge: DataFrame) -> DataFrame:
    """One taxonomy row per class: the document with the least id."""
    fields = [name for name in ["id", *MAPPING_COLUMNS, "text"] if name in knowledge.columns]
    return (
        knowledge.where(F.col("type") == "class_mapping")
        .groupBy("class_name")
        .agg(F.min_by(F.struct(*fields), F.col("id")).alias("m"))
        .select("class_name", *[F.col(f"m.{name}") for name in fields if name != "id"])
    )


def with_class_mapping(df: DataFrame, mappings: DataFrame, carry: Sequence[str] = tuple(MAPPING_COLUMNS)) -> DataFrame:
    """Exact match on the class name; ``mapping_error`` where no mapping exists."""
    known = mappings.select(F.col("class_name").alias("_class"), F.lit(True).alias("_known"), *carry)
    joined = df.join(known, df["class_name"] == known["_class"], "left")
    error = F.when(
        F.col("_known").isNull(), F.format_string("No class mapping found for '%s'", F.col("class_name"))
    )
    return joined.withColumn("mapping_error", error).drop("_class", "_known")


def with_mitigation(df: DataFrame, bands: DataFrame, confidence: str = "confidence") -> DataFrame:
    """The policy band of ``(class_name, confidence)``: action, tool, note, autonomy, error.

    Bands are half-open and cover every value of a known class exactly once, a missing
    confidence included, so each row comes out once.  The equality on the class lets
    Spark hash the bands and test only the few of one class.
    """
    value = F.when(~F.isnan(confidence), F.col(confidence))
    left = df.withColumn("_value", value)
    right = bands.withColumnRenamed("class_name", "_class")
    reached = F.col("lo").isNotNull() & (F.col("_value") >= F.col("lo")) & (
        F.col("hi").isNull() | (F.col("_value") < F.col("hi"))
    )
    below = F.col("lo").isNull() & (F.col("_value").isNull() | (F.col("_value") < F.col("hi")))
    joined = left.join(right, (F.col("class_name") == F.col("_class")) & (reached | below), "left")
    error = (
        F.when(F.col("_class").isNull(), F.format_string("No policy defined for class '%s'", F.col("class_name")))
        .when(F.col("action").isNull(), F.lit(fv.UNREACHABLE))
    )
    return joined.select(
        *df.columns,
        "action",
        "tool_function",
        "guardrail_note",
        autonomous("action").alias("autonomous"),
        error.alias("policy_error"),
    )


def cached_results(requested: DataFrame, results: DataFrame | None) -> DataFrame:
    """Stored result of each requested class, with a message where there is none to show."""
    if results is None:
        return requested.select(
            "class_name",
            F.lit(None).cast("string").alias("status"),
            F.lit(None).cast("string").alias("detected"),
            F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("int").alias("true_label"),
            F.lit("No results stored yet").alias("message"),
        )
    stored = results.select(
        F.col("class_name").alias("_class"), "status", "detected", "confidence", "true_label"
    )
    joined = requested.join(stored, requested["class_name"] == stored["_class"], "left")
    message = (
        F.when(F.col("_class").isNull(), F.format_string("'%s' not stored yet", F.col("class_name")))
        .when(F.col("detected").isNull(), F.lit("classification missing"))
        .otherwise(F.lit("ok"))
    )
    return joined.select(
        "class_name",
        "status",
        F.when(F.col("_class").isNotNull(), F.coalesce(F.col("detected"), F.lit(fv.STATUS_ERROR))).alias("detected"),
        "confidence",
        "true_label",
        message.alias("message"),
    )
