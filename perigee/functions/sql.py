"""The row rules as SQL functions, for users who write SQL.

They are SQL-defined temporary functions: Catalyst inlines their bodies, so a query
that calls them plans like one that spells the rule out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from perigee import fixed_values as fv
from perigee.functions.numeric import usable_std
from perigee.operators.gate import Stats


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def register(
    spark: SparkSession,
    stats: Stats,
    features: Sequence[str] = tuple(fv.FEATURES),
    z_threshold: float = fv.Z_THRESHOLD,
    min_features: int = fv.MIN_FEATURES,
) -> list[str]:
    """Creates the functions and returns their names.

    ``check_escalation(features...)``, ``decide_mitigation(class_name, confidence)``,
    ``class_mapping(class_name)``, ``incident_severity(class_name, action)`` and
    ``fp_risk_score(class_name, confidence)``.
    """
    terms = [
        f"CAST(coalesce(NOT isnan({name}) AND abs({name} - {stats[name][0]!r}D) / {stats[name][1]!r}D"
        f" > {z_threshold!r}D, false) AS INT)"
        for name in features if usable_std(stats[name][1])
    ]
    arguments = ", ".join(f"{name} DOUBLE" for name in features)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION check_escalation({arguments}) RETURNS BOOLEAN "
        f"RETURN ({' + '.join(terms) or '0'}) >= {min_features}"
    )
    levels = " ".join(f"WHEN {_text(a)} THEN {_text(s)}" for a, s in fv.SEVERITY_OF_ACTION.items())
    normal = _text(fv.CLASS_NAMES[fv.NORMAL_LABEL])
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION incident_severity(class_name STRING, action STRING) RETURNS STRING "
        f"RETURN CASE WHEN class_name = {normal} THEN {_text(fv.NORMAL_SEVERITY)} "
        f"ELSE CASE action {levels} ELSE {_text(fv.OTHER_SEVERITY)} END END"
    )
    confused = ", ".join(_text(name) for name in fv.CONFUSED_CLASSES)
    score = {rule: _text(value[0]) for rule, value in fv.FP_RISK.items()}
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION fp_risk_score(class_name STRING, confidence DOUBLE) RETURNS STRING "
        f"RETURN CASE WHEN class_name = {normal} THEN {score['normal']} "
        f"WHEN confidence < {fv.GUARDRAIL_CONFIDENCE}D THEN {score['guardrail']} "
        f"WHEN class_name IN ({confused}) AND confidence < {fv.CAUTION_CONFIDENCE}D THEN {score['confused']} "
        f"WHEN class_name = {_text(fv.FALSE_ALARM_CLASS)} THEN {score['false_alarm']} ELSE {score['other']} END"
    )
    bands = " ".join(
        f"WHEN class_name = {_text(name)} AND NOT isnan(confidence) AND confidence >= {low!r}D THEN "
        f"named_struct('action', {_text(action)}, 'tool_function', {_text(tool)}, 'guardrail_note', {_text(note)}, "
        f"'autonomous', {str(action != fv.MANUAL_ACTION).lower()}, 'error', CAST(NULL AS STRING))"
        for name, low, action, tool, note in sorted(fv.POLICY, key=lambda band: -band[1])
    )
    known = ", ".join(_text(name) for name in dict.fromkeys(band[0] for band in fv.POLICY))
    nothing = "CAST(NULL AS STRING)"
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION decide_mitigation(class_name STRING, confidence DOUBLE) "
        "RETURNS STRUCT<action: STRING, tool_function: STRING, guardrail_note: STRING, autonomous: BOOLEAN, error: STRING> "
        f"RETURN CASE {bands} ELSE named_struct('action', {nothing}, 'tool_function', {nothing}, "
        f"'guardrail_note', {nothing}, 'autonomous', CAST(NULL AS BOOLEAN), 'error', "
        f"CASE WHEN class_name IN ({known}) THEN {_text(fv.UNREACHABLE)} "
        "ELSE concat('No policy defined for class \\'', coalesce(class_name, 'null'), '\\'') END) END"
    )
    mappings = " ".join(
        f"WHEN {_text(name)} THEN named_struct('tactic_id', {_text(tactic)}, 'tactic_name', {_text(tactic_name)}, "
        f"'technique_id', {_text(technique)}, 'technique_name', {_text(technique_name)}, 'error', {nothing})"
        for _, _, name, tactic, tactic_name, technique, technique_name in fv.CLASS_MAPPINGS
    )
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION class_mapping(class_name STRING) "
        "RETURNS STRUCT<tactic_id: STRING, tactic_name: STRING, technique_id: STRING, technique_name: STRING, error: STRING> "
        f"RETURN CASE class_name {mappings} ELSE named_struct('tactic_id', {nothing}, 'tactic_name', {nothing}, "
        f"'technique_id', {nothing}, 'technique_name', {nothing}, 'error', "
        "concat('No class mapping found for \\'', coalesce(class_name, 'null'), '\\'')) END"
    )
    return ["check_escalation", "incident_severity", "fp_risk_score", "decide_mitigation", "class_mapping"]
