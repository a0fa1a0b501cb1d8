"""Column selection, input contract, time encoding and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.functions.numeric import cyclic, usable_std
from perigee.operators.gate import column_stats
from perigee.sources.artifacts import stats_map


def shared_features(raw: DataFrame, noised: DataFrame, drop: Sequence[str] = ("Label",)) -> list[str]:
    """Columns of both frames in the order of the noised one."""
    return [name for name in noised.columns if name in raw.columns and name not in drop]


def noised_features(noised: DataFrame, drop: Sequence[str] = ("Label",)) -> list[str]:
    """All noised columns; selecting them from a raw frame without one fails."""
    return [name for name in noised.columns if name not in drop]


def project(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Ordered features as doubles; ``strict=False`` takes the ones that exist."""
    names = list(features) if strict else [name for name in features if name in df.columns]
    return df.select(*keep, *[F.col(name).cast("double").alias(name) for name in names])


def as_label(df: DataFrame, label: str = "Label", text: bool = False) -> DataFrame:
    return df.withColumn(label, F.col(label).cast("string" if text else "int"))


def stack_splits(raw: DataFrame, noised: DataFrame) -> DataFrame:
    """Both splits under one schema, named by ``split``; columns one lacks are NULL there."""
    return raw.withColumn("split", F.lit("raw")).unionByName(
        noised.withColumn("split", F.lit("noised")), allowMissingColumns=True
    )


def cyclic_time(df: DataFrame, radians: str = "TimeRadians") -> DataFrame:
    sine, cosine = cyclic(radians)
    return df.withColumns({"Time_Sin": sine, "Time_Cos": cosine}).drop(radians)


def fit_scaler(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature, in the long form of baseline statistics."""
    return column_stats(df, features, ddof=0)


def scaled_columns(stats: dict[str, tuple[float, float]], features: Sequence[str]) -> list[Column]:
    """(x - mean) / std as literals; a constant feature is only centred."""
    return [
        ((F.col(name).cast("double") - F.lit(stats[name][0]))
         / F.lit(stats[name][1] if usable_std(stats[name][1]) else 1.0)).alias(name)
        for name in features
    ]


def scale(df: DataFrame, scaler: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Applies a scaler fitted on any frame; its one row per feature becomes literals."""
    return df.select(*keep, *scaled_columns(stats_map(scaler, features), features))


def contract_errors(df: DataFrame, features: Sequence[str]) -> Column:
    """Names of the features of a row that are absent or not numeric, joined by commas."""
    broken = [
        F.when(F.col(name).try_cast("double").isNull(), F.lit(name)) if name in df.columns else F.lit(name)
        for name in features
    ]
    return F.concat_ws(",", *broken)


def contract_split(
    df: DataFrame, features: Sequence[str], classes: DataFrame | None = None, class_column: str = "class_name"
) -> DataFrame:
    """Adds ``contract_error``: NULL for a row that may enter, else the reason.

    Filter on it for the valid and the quarantined rows; neither loses any.
    """
    errors = contract_errors(df, features)
    reason = F.when(errors != "", F.concat(F.lit("not numeric: "), errors))
    if classes is None:
        return df.withColumn("contract_error", reason)
    allowed = classes.select(F.col("class_name").alias("_class")).distinct()
    joined = df.join(allowed, df[class_column] == allowed["_class"], "left")
    reason = F.coalesce(
        reason,
        F.when(
            F.col("_class").isNull(),
            F.concat(F.lit("unknown class: "), F.coalesce(F.col(class_column), F.lit("null"))),
        ),
    )
    return joined.withColumn("contract_error", reason).drop("_class")


# The fields an incident record is assembled from, and their types.
INCIDENT_FIELDS = {
    "class_name": "string", "confidence": "double", "tactic_id": "string", "technique_id": "string", "action": "string",
    "tool_function": "string", "guardrail_note": "string", "autonomous": "boolean",
}


def incident_errors(df: DataFrame, fields: dict[str, str] | None = None) -> Column:
    """Names of the fields of an incident input that are absent, NULL or not of their type, joined by commas."""
    broken = []
    for name, kind in (INCIDENT_FIELDS if fields is None else fields).items():
        if name not in df.columns:
            broken.append(F.lit(name))
            continue
        value = F.col(name)
        typed = value.try_cast(kind)
        if kind == "double":
            typed = F.when(~F.isnan(typed), typed)
        broken.append(F.when(typed.isNull(), F.lit(name)))
    return F.concat_ws(",", *broken)


def incident_contract(df: DataFrame, classes: DataFrame) -> DataFrame:
    """Adds ``contract_error`` to incident inputs: NULL for one that may be assembled, else the reason.

    Every field has to be there with its type, the confidence between 0 and 1, and the class one of the table ``classes``.
    The first broken rule is the reason.
    """
    errors = incident_errors(df)
    confidence = F.col("confidence").try_cast("double") if "confidence" in df.columns else F.lit(None).cast("double")
    known = F.col("class_name") if "class_name" in df.columns else F.lit(None).cast("string")
    allowed = classes.select(F.col("class_name").alias("_class")).distinct()
    joined = df.withColumn("_known", known.cast("string")).join(allowed, F.col("_known") == F.col("_class"), "left")
    reason = (
        F.when(errors != "", F.concat(F.lit("missing or of another type: "), errors))
        .when(~confidence.between(0, 1), F.lit("confidence outside 0 to 1"))
        .when(F.col("_class").isNull(), F.concat(F.lit("unknown class: "), F.col("_known")))
    )
    return joined.withColumn("contract_error", reason).drop("_class", "_known")


def valid_incidents(checked: DataFrame) -> DataFrame:
    """Incident inputs without an error, each field in its type."""
    rows = checked.where(F.col("contract_error").isNull()).drop("contract_error")
    return rows.withColumns({name: F.col(name).cast(kind) for name, kind in INCIDENT_FIELDS.items()})


def valid_rows(checked: DataFrame, features: Sequence[str]) -> DataFrame:
    rows = checked.where(F.col("contract_error").isNull()).drop("contract_error")
    return rows.withColumns({name: F.col(name).cast("double") for name in features})


def quarantined_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.col("contract_error").isNotNull())
