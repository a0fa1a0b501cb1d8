"""The triage plan: gate, classify, add context, decide, assemble, check."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.incident import incident_record, report_text, top_drivers, triage_status, utc_text
from perigee.operators.features import contract_errors
from perigee.operators.gate import Stats, escalated_rows, gate
from perigee.operators.lookup import class_mappings, with_class_mapping, with_class_name, with_mitigation
from perigee.operators.models import score
from perigee.operators.similarity import similar_incidents
from perigee.sources import dims


# How records are written as JSON: moments as UTC text, absent values as nulls.
JSON_OPTIONS = {"timestampFormat": fv.UTC_FORMAT, "timeZone": "UTC", "ignoreNullFields": "false"}


def triage(
    df: DataFrame,
    stats: Stats,
    features: Sequence[str],
    model: PipelineModel | None = None,
    key: str = "seq",
    moment: str = "ts",
    knowledge: DataFrame | None = None,
    bands: DataFrame | None = None,
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
    satellite_id: str = fv.SATELLITE_ID,
    observation: Observation | None = None,
) -> DataFrame:
    """``(key, record, report, status)`` of every row the gate lets through.

    One narrow plan, for a batch and for a stream: the gate runs before the model, the
    joins are against tables of a few rows, nothing is shuffled.  Without a ``model``
    the rows must carry ``predicted_label`` and ``confidence``.
    """
    spark = df.sparkSession
    knowledge = dims.knowledge(spark) if knowledge is None else knowledge
    bands = dims.policy_bands(spark) if bands is None else bands
    rows = escalated_rows(df, stats, features, z_threshold, min_features, observation)
    if model is not None:
        rows = score(rows, model)
    rows = with_class_name(rows, dims.classes(spark), "predicted_label")
    return assemble(rows, stats, features, key, moment, knowledge, bands, satellite_id)


def assemble(
    rows: DataFrame,
    stats: Stats,
    features: Sequence[str],
    key: str,
    moment: str,
    knowledge: DataFrame,
    bands: DataFrame,
    satellite_id: str = fv.SATELLITE_ID,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Record, report and status of classified rows (``class_name``, ``confidence``), with the carried columns."""
    mappings = class_mappings(knowledge).withColumnRenamed("text", "context_text")
    carried = ["tactic_id", "tactic_name", "technique_id", "technique_name", "context_text"]
    placed = with_mitigation(with_class_mapping(rows, mappings, carried), bands)
    built = placed.select(
        key,
        *carry,
        "class_name",
        "confidence",
        incident_record(key, moment, top_drivers(stats, features), satellite_id).alias("record"),
        F.coalesce(F.concat(F.lit("error: "), F.col("mapping_error")), F.col("context_text")).alias("context"),
        F.coalesce(F.concat(F.lit("error: "), F.col("policy_error")), F.col("action")).alias("mitigation"),
    ).withColumn("report", report_text("record"))
    status = triage_status("class_name", "confidence", "context", "mitigation", "report")
    return built.select(key, "record", "report", status.alias("status"), *carry)


def flatten_incidents(incidents: DataFrame, key: str = "seq") -> DataFrame:
    """The scalar fields of the records as columns."""
    return incidents.select(
        key,
        F.col("record.incident_id"),
        utc_text("record.timestamp_utc").alias("timestamp_utc"),
        F.col("record.satellite_id"),
        F.col("record.classification.predicted_label"),
        F.col("record.classification.class_name"),
        F.col("record.classification.confidence"),
        F.col("record.classification.severity"),
        F.col("record.sparta_context.tactic_id"),
        F.col("record.sparta_context.technique_id"),
        F.col("record.mitigation.recommended_action"),
        F.col("record.mitigation.executed_tool_call"),
        F.col("record.mitigation.autonomous_execution"),
        F.col("record.mitigation.guardrail_note"),
        F.col("record.mitigation.guardrail_fired"),
        F.col("record.false_positive_risk.fp_risk_score"),
        F.col("record.false_positive_risk.risk_note"),
        F.col("record.human_review.status").alias("review_status"),
        F.element_at("record.shap_drivers", 1)["feature_name"].alias("top_feature"),
        F.col("status"),
    )


def incidents_as_json(incidents: DataFrame, key: str = "seq") -> DataFrame:
    """One JSON text per record; absent values are written as nulls."""
    return incidents.select(key, F.to_json("record", JSON_OPTIONS).alias("json"), "status")


def parse_incidents(rows: DataFrame, like: DataFrame, column: str = "json") -> DataFrame:
    """Records back from their JSON text, with the schema of ``like.record``."""
    schema = like.schema["record"].dataType
    return rows.withColumn("record", F.from_json(column, schema, {"timestampFormat": fv.UTC_FORMAT, "timeZone": "UTC"}))


def write_incidents(incidents: DataFrame, path: str, run: str = "first") -> None:
    """JSON-lines files of the records with report and status beside them, in a folder of the run.

    Writing a run again replaces its own records, other runs stay.
    """
    incidents.write.mode("overwrite").options(**JSON_OPTIONS).json(f"{path}/run={run}")


def triage_or_quarantine(
    df: DataFrame,
    stats: Stats,
    features: Sequence[str],
    model: PipelineModel | None = None,
    key: str = "seq",
    moment: str = "ts",
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
    observation: Observation | None = None,
) -> DataFrame:
    """``(key, record, report, status, reason)``: incidents, and rows that break the input contract.

    A row with an absent or non-numeric feature comes out with status ERROR, the reason and no record.
    Nothing else is lost: seen rows are escalated, skipped or quarantined (``observation`` counts them).
    The same narrow plan on a batch and on a stream.
    """
    spark = df.sparkSession
    reason = F.concat(F.lit("not numeric: "), contract_errors(df, features))
    checked = df.withColumn("_reason", F.when(contract_errors(df, features) != "", reason))
    present = [name for name in features if name in df.columns]
    typed = checked.withColumns({name: F.col(name).try_cast("double") for name in present})
    typed = typed.withColumns({name: F.lit(None).cast("double") for name in features if name not in present})
    gated = gate(typed, stats, features, z_threshold, min_features)
    broken = F.col("_reason").isNotNull()
    gated = gated.withColumn("escalate", F.col("escalate") & ~broken)
    if observation is not None:
        gated = gated.observe(
            observation, F.count(F.lit(1)).alias("seen"), F.count_if("escalate").alias("escalated"),
            F.count_if(~broken & ~F.col("escalate")).alias("skipped"), F.count_if(broken).alias("quarantined"),
        )
    rows = gated.where(F.col("escalate") | broken).drop("tripped", "escalate")
    if model is not None:
        rows = score(rows, model)
    rows = with_class_name(rows, dims.classes(spark), "predicted_label")
    built = assemble(rows, stats, features, key, moment, dims.knowledge(spark), dims.policy_bands(spark), carry=("_reason",))
    broken = F.col("_reason").isNotNull()
    return built.select(
        key, F.when(~broken, F.col("record")).alias("record"), F.when(~broken, F.col("report")).alias("report"),
        F.when(broken, F.lit(fv.STATUS_ERROR)).otherwise(F.col("status")).alias("status"), F.col("_reason").alias("reason"),
    )


def with_precedent(
    incidents: DataFrame, vectors: DataFrame, knowledge: DataFrame, key: str = "seq", vector: str = "embedding", **search
) -> DataFrame:
    """Adds ``precedent`` to each incident: the nearest stored incident by vector, or NULL.

    ``vectors`` holds (key, vector); an incident without a vector, or an empty knowledge base, has none.
    """
    asked = incidents.select(key).join(vectors.select(key, vector), key, "left")
    nearest = similar_incidents(asked, knowledge, query_id=key, query_vector=vector, k=1, keep_unmatched=False, **search)
    best = nearest.select(key, F.struct(F.col("match_id").alias("id"), "distance").alias("precedent"))
    return incidents.join(best, key, "left")
