"""Row rules that turn a classified, policy-checked window into an incident record."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions.numeric import abs_z, as_column, round_exact


def severity(class_name: Column | str, action: Column | str) -> Column:
    """Severity level; the Normal rule comes first, then the level of the action."""
    class_name, action = as_column(class_name), as_column(action)
    level = F.when(class_name == fv.CLASS_NAMES[fv.NORMAL_LABEL], F.lit(fv.NORMAL_SEVERITY))
    for grade in dict.fromkeys(fv.SEVERITY_OF_ACTION.values()):
        actions = [a for a, g in fv.SEVERITY_OF_ACTION.items() if g == grade]
        level = level.when(action.isin(actions), F.lit(grade))
    return level.otherwise(F.lit(fv.OTHER_SEVERITY))


def false_positive_risk(class_name: Column | str, confidence: Column | str) -> Column:
    """Struct ``(fp_risk_score, risk_note)``; a missing confidence is below no cut-off."""
    class_name, confidence = as_column(class_name), as_column(confidence)

    def verdict(rule: str) -> Column:
        score, note = fv.FP_RISK[rule]
        return F.struct(F.lit(score).alias("fp_risk_score"), F.lit(note).alias("risk_note"))

    return (
        F.when(class_name == fv.CLASS_NAMES[fv.NORMAL_LABEL], verdict("normal"))
        .when(confidence < fv.GUARDRAIL_CONFIDENCE, verdict("guardrail"))
        .when(class_name.isin(fv.CONFUSED_CLASSES) & (confidence < fv.CAUTION_CONFIDENCE), verdict("confused"))
        .when(class_name == fv.FALSE_ALARM_CLASS, verdict("false_alarm"))
        .otherwise(verdict("other"))
    )


def triage_status(
    class_name: Column | str,
    confidence: Column | str,
    context_text: Column | str,
    mitigation_text: Column | str,
    report_text: Column | str,
) -> Column:
    """First match wins: no class, low confidence, an error reported, the class not named."""
    class_name, confidence = as_column(class_name), as_column(confidence)
    context, mitigation, report = (
        F.coalesce(F.lower(as_column(text)), F.lit("")) for text in (context_text, mitigation_text, report_text)
    )
    named = F.lower(class_name)
    return (
        F.when(class_name.isNull() | confidence.isNull(), F.lit(fv.STATUS_ERROR))
        .when(confidence < fv.GUARDRAIL_CONFIDENCE, F.lit(fv.STATUS_FLAGGED))
        .when(context.contains("error") | mitigation.contains("error"), F.lit(fv.STATUS_FLAGGED))
        .when(~context.contains(named) | ~report.contains(named), F.lit(fv.STATUS_FLAGGED))
        .otherwise(F.lit(fv.STATUS_AUTONOMOUS))
    )


def autonomous(action: Column | str) -> Column:
    return as_column(action) != fv.MANUAL_ACTION


def incident_id(
    key: Column | str, moment: Column | str | None = None, satellite_id: str = fv.SATELLITE_ID, random: bool = False
) -> Column:
    """``INC-`` and 12 upper-case hex digits.

    By default they come from a hash of satellite, moment (UTC) and row key, so a re-run task
    writes the same id and row 7 of another ingest gets another one; ``random=True`` draws a
    fresh uuid.  48 bits collide at scale: keep the key.
    """
    when = F.lit("") if moment is None else F.coalesce(utc_text(moment), F.lit(""))
    named = F.concat_ws("|", F.lit(satellite_id), when, as_column(key).cast("string"))
    digits = F.replace(F.uuid(), F.lit("-"), F.lit("")) if random else F.sha2(named, 256)
    return F.concat(F.lit(fv.INCIDENT_PREFIX), F.upper(F.substring(digits, 1, fv.INCIDENT_HEX_DIGITS)))


def utc_text(moment: Column | str) -> Column:
    """ISO text in UTC, whatever the time zone of the session."""
    utc = F.to_utc_timestamp(as_column(moment).cast("timestamp"), F.current_timezone())
    return F.date_format(utc, fv.UTC_FORMAT)


def top_drivers(stats: Mapping[str, tuple[float, float]], features: Sequence[str], k: int = fv.TOP_DRIVERS) -> Column:
    """The ``k`` features deviating most from the baseline, as an array of structs.

    Built inside the row: no unpivot, no shuffle.  Features without a z are left out;
    equal scores keep feature order.
    """
    scored = F.array(*[
        F.struct(
            F.lit(name).alias("feature_name"),
            F.col(name).cast("double").alias("measured_value"),
            abs_z(name, *stats[name]).alias("z_score"),
            F.lit(position).alias("position"),
        )
        for position, name in enumerate(features)
    ])
    known = F.filter(scored, lambda s: s["z_score"].isNotNull())
    ranked = F.array_sort(
        known,
        lambda a, b: F.when(a["z_score"] > b["z_score"], -1)
        .when(a["z_score"] < b["z_score"], 1)
        .otherwise(a["position"] - b["position"]),
    )
    return F.transform(
        F.slice(ranked, 1, k),
        lambda s: F.struct(
            s["feature_name"].alias("feature_name"),
            s["measured_value"].alias("measured_value"),
            s["z_score"].alias("z_score"),
        ),
    )


def incident_record(
    key: Column | str,
    moment: Column | str,
    drivers: Column | str,
    satellite_id: str = fv.SATELLITE_ID,
) -> Column:
    """The nested record over the columns a triaged row carries.

    Field names follow the documented record; the drivers hold baseline deviations
    (``z_score``), not attributions of a model.
    """
    risk = false_positive_risk("class_name", "confidence")
    return F.struct(
        incident_id(key, moment, satellite_id).alias("incident_id"),
        as_column(moment).cast("timestamp").alias("timestamp_utc"),
        F.lit(satellite_id).alias("satellite_id"),
        F.struct(
            F.col("predicted_label").cast("int").alias("predicted_label"),
            F.col("class_name"),
            F.col("confidence"),
            severity("class_name", "action").alias("severity"),
        ).alias("classification"),
        as_column(drivers).alias("shap_drivers"),
        F.struct("tactic_id", "tactic_name", "technique_id", "technique_name").alias("sparta_context"),
        F.struct(
            F.col("action").alias("recommended_action"),
            F.col("tool_function").alias("executed_tool_call"),
            autonomous("action").alias("autonomous_execution"),
            F.col("guardrail_note"),
            (F.col("confidence") < fv.GUARDRAIL_CONFIDENCE).alias("guardrail_fired"),
        ).alias("mitigation"),
        risk.alias("false_positive_risk"),
        F.struct(
            F.lit(fv.REVIEW_STATUS).alias("status"),
            F.lit(None).cast("string").alias("reviewer_id"),
            F.lit(None).cast("timestamp").alias("review_timestamp"),
        ).alias("human_review"),
    )


def report_text(record: Column | str) -> Column:
    """Deterministic six-section text of one record, in place of written narration."""
    r = as_column(record)
    cls, mit, ctx, risk = r["classification"], r["mitigation"], r["sparta_context"], r["false_positive_risk"]

    def shown(value: Column) -> Column:
        return F.coalesce(value.cast("string"), F.lit("n/a"))

    drivers = F.array_join(
        F.transform(
            r["shap_drivers"],
            lambda d: F.format_string(
                "%s=%.2f (z %.2f)", d["feature_name"], round_exact(d["measured_value"], 2), round_exact(d["z_score"], 2)
            ),
        ),
        ", ",
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("INCIDENT REPORT "), r["incident_id"], F.lit(" for "), r["satellite_id"]),
        F.concat(
            F.lit("1. Detection: "), shown(cls["class_name"]), F.lit(" (label "), shown(cls["predicted_label"]),
            F.lit("), confidence "), F.coalesce(F.format_string("%.4f", round_exact(cls["confidence"], 4)), F.lit("n/a")),
            F.lit(", severity "), cls["severity"],
        ),
        F.concat(F.lit("2. Feature drivers: "), F.when(F.size(r["shap_drivers"]) > 0, drivers).otherwise(F.lit("none"))),
        F.concat(
            F.lit("3. Taxonomy: tactic "), shown(ctx["tactic_id"]), F.lit(", technique "), shown(ctx["technique_id"])
        ),
        F.concat(F.lit("4. False-positive risk: "), risk["fp_risk_score"], F.lit(" - "), risk["risk_note"]),
        F.concat(
            F.lit("5. Mitigation: "), shown(mit["recommended_action"]), F.lit(" via "),
            shown(mit["executed_tool_call"]), F.lit("; "), shown(mit["guardrail_note"]),
        ),
        F.concat(F.lit("6. Human review: "), r["human_review"]["status"]),
    )
