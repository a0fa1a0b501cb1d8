"""Classifier, incident search and incident record as SQL functions, beside the row rules of ``sql``.

With both registered, one statement goes from the gate to the record::

    SELECT seq, assemble_record(seq, ts, c.predicted_label, c.class_name, c.confidence, f1, f2) AS record
    FROM (SELECT *, classify(f1, f2) AS c FROM windows WHERE check_escalation(f1, f2))
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.numeric import usable_std
from perigee.functions.sql import _text
from perigee.operators.gate import Stats
from perigee.session import scratch_path
from perigee.sources.artifacts import save_model

CLASSIFIED = "STRUCT<predicted_label: INT, class_name: STRING, confidence: DOUBLE>"

# Stated, as types made up from the body may hold parts that cannot be NULL, which inner functions do not promise.
RECORD = (
    "STRUCT<incident_id: STRING, timestamp_utc: TIMESTAMP, satellite_id: STRING, "
    "classification: STRUCT<predicted_label: INT, class_name: STRING, confidence: DOUBLE, severity: STRING>, "
    "shap_drivers: ARRAY<STRUCT<feature_name: STRING, measured_value: DOUBLE, z_score: DOUBLE>>, "
    "sparta_context: STRUCT<tactic_id: STRING, tactic_name: STRING, technique_id: STRING, technique_name: STRING>, "
    "mitigation: STRUCT<recommended_action: STRING, executed_tool_call: STRING, autonomous_execution: BOOLEAN, "
    "guardrail_note: STRING, guardrail_fired: BOOLEAN>, false_positive_risk: STRUCT<fp_risk_score: STRING, risk_note: STRING>, "
    "human_review: STRUCT<status: STRING, reviewer_id: STRING, review_timestamp: TIMESTAMP>>"
)


def forest_arrays(spark: SparkSession, model: PipelineModel) -> list[tuple]:
    """(feature, threshold, children, class shares, depth) of each tree, as the saved forest states them.

    ``children`` has the right and the left child of each node in turn; a leaf is its own child, so after ``depth`` steps
    every row stands at its leaf.  Bounded by the model: trees times nodes.
    """
    path = scratch_path(spark, "forest")
    save_model(model, path)
    nodes = spark.read.parquet(f"{path}/stages/{len(model.stages) - 1}_*/data").select("treeID", "nodeData.*").orderBy("treeID", "id")
    trees: dict[int, list] = {}
    for row in nodes.collect():
        trees.setdefault(row["treeID"], []).append(row)
    out = []
    for rows in (trees[number] for number in sorted(trees)):
        leaf = [row["leftChild"] < 0 for row in rows]
        counts = np.array([row["impurityStats"] for row in rows])
        total = counts.sum(axis=1, keepdims=True)
        children = [[at, at] if end else [row["rightChild"], row["leftChild"]] for at, (row, end) in enumerate(zip(rows, leaf))]
        depth, level = 0, [0]
        while level := [child for at in level if not leaf[at] for child in children[at]]:
            depth += 1
        out.append((
            np.array([0 if end else row["split"]["featureIndex"] for row, end in zip(rows, leaf)]),
            np.array([0.0 if end else row["split"]["leftCategoriesOrThreshold"][0] for row, end in zip(rows, leaf)]),
            np.array(children).ravel(), np.divide(counts, total, out=np.zeros_like(counts), where=total > 0), depth,
        ))
    return out


def forest_shares(trees: list[tuple], rows: np.ndarray) -> np.ndarray:
    """Class probabilities of rows: the mean of the shares of the leaves they reach; values that are not numbers go right."""
    votes = np.zeros((len(rows), trees[0][3].shape[1]))
    values, start = np.ascontiguousarray(rows).ravel(), np.arange(len(rows)) * rows.shape[1]
    for feature, threshold, children, shares, depth in trees:
        at = np.zeros(len(rows), np.int64)
        for _ in range(depth):
            goes_left = values.take(start + feature.take(at)) <= threshold.take(at)
            at = children.take(2 * at + goes_left)
        votes += shares.take(at, axis=0)
    return votes / votes.sum(axis=1, keepdims=True)


def register_classifier(spark: SparkSession, model: PipelineModel, features: Sequence[str], name: str = "classify") -> str:
    """``classify(features...)``: label, class name and rounded confidence by a trained forest, as ``models.score`` gives them."""
    shared = spark.sparkContext.broadcast(forest_arrays(spark, model))
    width = len(features)

    @F.arrow_udf(CLASSIFIED)
    def classify(*columns: pa.Array) -> pa.Array:
        if len(columns) != width:
            raise ValueError(f"{name} takes {width} features, got {len(columns)}")
        numbers = [column.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False) for column in columns]
        shares = forest_shares(shared.value, np.stack(numbers, axis=1))
        label = shares.argmax(axis=1)
        sure = [round(value, fv.CONFIDENCE_PLACES) for value in shares.max(axis=1).tolist()]
        names = [fv.CLASS_NAMES[at] if at < len(fv.CLASS_NAMES) else None for at in label.tolist()]
        return pa.StructArray.from_arrays(
            [pa.array(label, pa.int32()), pa.array(names, pa.string()), pa.array(sure, pa.float64())],
            ["predicted_label", "class_name", "confidence"],
        )

    spark.udf.register(name, classify)
    return name


def register_search(
    spark: SparkSession, knowledge: DataFrame, base_id: str = "id", base_vector: str = "embedding", doc_type: str | None = "incident",
    k: int = fv.SIMILAR_INCIDENTS, name: str = "search_incidents",
) -> str:
    """``SELECT * FROM search_incidents(vector)``: rank, id and squared distance of the nearest documents, ties to the smaller id.

    One question over one scan; tables of questions go through ``similarity`` or its index.  Documents of another length, or
    with values that are not finite numbers, are never found; a NULL question finds nothing.
    """
    base = knowledge if doc_type is None else knowledge.where(F.col("type") == doc_type)
    kind = base.schema[base_id].dataType.simpleString()
    view = f"{name}_documents"
    base.select(F.col(base_id).alias("match_id"), F.col(base_vector).cast("array<double>").alias("v")).createOrReplaceTempView(view)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked ARRAY<DOUBLE>) RETURNS TABLE (rank INT, match_id {kind}, distance DOUBLE) RETURN "
        "SELECT CAST(row_number() OVER (ORDER BY distance, match_id) AS INT), match_id, distance FROM ("
        "SELECT match_id, aggregate(zip_with(v, asked, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x) AS distance "
        f"FROM {view} WHERE size(v) = size(asked) AND size(v) > 0 "
        "AND forall(v, x -> coalesce(NOT isnan(x) AND abs(x) < double('infinity'), false))"
        f") WHERE distance IS NOT NULL AND NOT isnan(distance) ORDER BY distance, match_id LIMIT {int(k)}"
    )
    return name


def _drivers(stats: Stats, features: Sequence[str]) -> str:
    """SQL of the features that deviate most, as ``incident.top_drivers`` ranks them."""
    def z(feature: str) -> str:
        mean, std = stats[feature]
        if mean is None or np.isnan(mean) or not usable_std(std):
            return "CAST(NULL AS DOUBLE)"
        return f"abs(CASE WHEN NOT isnan({feature}) THEN {feature} END - ({float(mean)!r}D)) / {float(std)!r}D"

    scored = ", ".join(
        f"named_struct('feature_name', {_text(f)}, 'measured_value', {f}, 'z_score', {z(f)}, 'position', {at})" for at, f in enumerate(features)
    )
    order = "CASE WHEN a.z_score > b.z_score THEN -1 WHEN a.z_score < b.z_score THEN 1 ELSE a.position - b.position END"
    return (
        f"transform(slice(array_sort(filter(array({scored}), s -> s.z_score IS NOT NULL), (a, b) -> {order}), 1, {fv.TOP_DRIVERS}), "
        "s -> named_struct('feature_name', s.feature_name, 'measured_value', s.measured_value, 'z_score', s.z_score))"
    )


def register_record(
    spark: SparkSession, stats: Stats, features: Sequence[str], satellite_id: str = fv.SATELLITE_ID, name: str = "assemble_record",
) -> str:
    """``assemble_record(key, moment, predicted_label, class_name, confidence, features...)``: the nested incident record.

    It calls the functions that ``sql.register`` creates, so these come first.  Equal to ``incident.incident_record`` behind
    the default policy and taxonomy.
    """
    arguments = ", ".join(f"{feature} DOUBLE" for feature in features)
    utc = f"date_format(to_utc_timestamp(moment, current_timezone()), {_text(fv.UTC_FORMAT)})"
    digest = f"sha2(concat_ws('|', {_text(satellite_id)}, coalesce({utc}, ''), row_key), 256)"
    # Inlined by Catalyst: equal calls are evaluated once a row.
    mitigation, context = "decide_mitigation(class_name, confidence)", "class_mapping(class_name)"
    notes = " ".join(f"WHEN {_text(risk)} THEN {_text(note)}" for risk, note in _risk_notes().items())
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(row_key STRING, moment TIMESTAMP, predicted_label INT, class_name STRING, "
        f"confidence DOUBLE, {arguments}) RETURNS {RECORD} RETURN named_struct("
        f"'incident_id', concat({_text(fv.INCIDENT_PREFIX)}, upper(substring({digest}, 1, {fv.INCIDENT_HEX_DIGITS}))), "
        f"'timestamp_utc', moment, 'satellite_id', {_text(satellite_id)}, "
        "'classification', named_struct('predicted_label', predicted_label, 'class_name', class_name, 'confidence', confidence, "
        f"'severity', incident_severity(class_name, {mitigation}.action)), "
        f"'shap_drivers', {_drivers(stats, features)}, "
        f"'sparta_context', named_struct('tactic_id', {context}.tactic_id, 'tactic_name', {context}.tactic_name, "
        f"'technique_id', {context}.technique_id, 'technique_name', {context}.technique_name), "
        f"'mitigation', named_struct('recommended_action', {mitigation}.action, 'executed_tool_call', {mitigation}.tool_function, "
        f"'autonomous_execution', {mitigation}.autonomous, 'guardrail_note', {mitigation}.guardrail_note, "
        f"'guardrail_fired', confidence < {fv.GUARDRAIL_CONFIDENCE}D), "
        f"'false_positive_risk', named_struct('fp_risk_score', fp_risk_score(class_name, confidence), 'risk_note', CASE {_risk_rule()} {notes} END), "
        f"'human_review', named_struct('status', {_text(fv.REVIEW_STATUS)}, 'reviewer_id', CAST(NULL AS STRING), "
        "'review_timestamp', CAST(NULL AS TIMESTAMP)))"
    )
    return name


def _risk_notes() -> dict[str, str]:
    return {rule: note for rule, (_, note) in fv.FP_RISK.items()}


def _risk_rule() -> str:
    """Which rule of the false-positive risk holds, first match wins."""
    confused = ", ".join(_text(name) for name in fv.CONFUSED_CLASSES)
    return (
        f"CASE WHEN class_name = {_text(fv.CLASS_NAMES[fv.NORMAL_LABEL])} THEN 'normal' "
        f"WHEN confidence < {fv.GUARDRAIL_CONFIDENCE}D THEN 'guardrail' "
        f"WHEN class_name IN ({confused}) AND confidence < {fv.CAUTION_CONFIDENCE}D THEN 'confused' "
        f"WHEN class_name = {_text(fv.FALSE_ALARM_CLASS)} THEN 'false_alarm' ELSE 'other' END"
    )
