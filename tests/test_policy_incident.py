import datetime as dt
import json
import math
import re

import pytest
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions import incident as rec
from perigee.functions import sql as sql_functions
from perigee.functions.numeric import percent_text
from perigee.operators import lookup
from perigee.plans.triage import assemble, flatten_incidents, incidents_as_json, parse_incidents, triage, write_incidents
from perigee.session import materialize, scratch_root, scratch_scope
from perigee.sources import dims

BOUNDARIES = [
    ("Storage Exhaustion", 0.849, "flush_command_queue"),
    ("Storage Exhaustion", 0.85, "flush_command_queue + App Restart"),
    ("Storage Exhaustion", 0.699, "log_only"),
    ("Storage Exhaustion", 0.70, "flush_command_queue"),
    ("Command Flooding", 0.84, "flush_command_queue"),
    ("Command Flooding", 0.85, "flush_command_queue + Rate Limit"),
    ("Command Flooding", 0.69, "log_only"),
    ("Command Flooding", 0.70, "flush_command_queue"),
    ("Data Injection", 0.849, "isolate_subsystem + Ground Review"),
    ("Data Injection", 0.85, "isolate_subsystem"),
    ("Data Injection", 0.699, "log_only"),
    ("Data Injection", 0.70, "isolate_subsystem + Ground Review"),
    ("Defence Impairment", 0.699, "Escalate Alert"),
    ("Defence Impairment", 0.70, "enable_safe_mode"),
]
STORED = [
    ("Normal", 0.9982, "AUTONOMOUS", "NONE", "N/A"),
    ("Storage Exhaustion", 0.9996, "AUTONOMOUS", "HIGH", "LOW"),
    ("Command Flooding", 0.9996, "AUTONOMOUS", "HIGH", "LOW"),
    ("Data Injection", 0.6103, "FLAGGED_FOR_REVIEW", "LOW", "HIGH"),
    ("Defence Impairment", 0.6746, "FLAGGED_FOR_REVIEW", "HIGH", "HIGH"),
]
CASES = "i int, class_name string, confidence double"


def decide(spark, table, rows, bands=None):
    df = table(CASES, [(i, *row) for i, row in enumerate(rows)])
    return lookup.with_mitigation(df, dims.policy_bands(spark) if bands is None else bands).orderBy("i").collect()


def test_fourteen_boundaries(spark, table):
    decided = decide(spark, table, [case[:2] for case in BOUNDARIES])
    assert [r.action for r in decided] == [case[2] for case in BOUNDARIES]
    assert {r.policy_error for r in decided} == {None}


def test_policy_errors(spark, table):
    decided = decide(spark, table, [("Unheard", 0.9), ("Normal", -0.1), ("Normal", math.nan), ("Normal", None)])
    assert [r.policy_error for r in decided] == ["No policy defined for class 'Unheard'"] + ["unreachable"] * 3
    assert [r.action for r in decided] == [None] * 4


def test_every_confidence_meets_one_band(spark, table):
    rows = [(name, c / 200) for name in fv.CLASS_NAMES for c in range(-5, 221)]
    decided = decide(spark, table, rows)
    assert len(decided) == len(rows)
    assert all((r.policy_error == "unreachable") == (r.confidence < 0) for r in decided)


def test_bands_from_a_policy_table(spark, table):
    policy = table("class_name string, lo double, action string, tool_function string, guardrail_note string",
                   fv.POLICY)
    rows = [case[:2] for case in BOUNDARIES] + [("Normal", -1.0)]
    assert decide(spark, table, rows, dims.bands_from_policy(policy)) == decide(spark, table, rows)


def test_sql_functions_agree_with_the_joins(spark, table):
    from perigee.functions import sql as sql_functions

    cases = [case[:2] for case in BOUNDARIES] + [("Unheard", 0.9), ("Normal", -0.1), ("Normal", math.nan)]
    joined = decide(spark, table, cases)
    sql_functions.register(spark, {"x": (0.0, 1.0)}, ["x"])
    table(CASES, [(i, *case) for i, case in enumerate(cases)]).createOrReplaceTempView("cases")
    called = spark.sql(
        "SELECT i, d.*, m.tactic_id FROM (SELECT i, decide_mitigation(class_name, confidence) AS d, "
        "class_mapping(class_name) AS m FROM cases) ORDER BY i").collect()
    fields = ["action", "tool_function", "guardrail_note", "autonomous"]
    assert [[r[f] for f in fields] + [r.policy_error] for r in joined] == [[r[f] for f in fields] + [r.error] for r in called]
    assert called[0].tactic_id == "ST0009" and called[-3].tactic_id is None


def test_low_confidence_logging_counts_as_autonomous(spark, table):
    decided = decide(spark, table, [("Data Injection", 0.1), ("Defence Impairment", 0.1)])
    assert [r.autonomous for r in decided] == [True, False]


def test_stored_cases(spark, table):
    df = table(CASES + ", x double", [(i, c, p, 1.0) for i, (c, p, *_) in enumerate(STORED)])
    rows = df.select("*", F.col("i").alias("predicted_label"), F.current_timestamp().alias("ts"))
    got = flatten_incidents(
        assemble(rows, {"x": (0.0, 1.0)}, ["x"], "i", "ts", dims.knowledge(spark), dims.policy_bands(spark)), "i"
    ).orderBy("i").collect()
    assert [(r.class_name, r.confidence, r.status, r.severity, r.fp_risk_score) for r in got] == STORED


def test_risk_ladder(spark, table):
    cases = [("Command Flooding", 0.7), ("Command Flooding", 0.85), ("Data Injection", 0.84),
             ("Data Injection", 0.99), ("Storage Exhaustion", 0.7), ("Normal", 0.1), ("Data Injection", 0.69),
             ("Storage Exhaustion", None)]
    df = table(CASES, [(i, *c) for i, c in enumerate(cases)])
    got = df.select("i", rec.false_positive_risk("class_name", "confidence").alias("r")).orderBy("i").collect()
    assert [r.r.fp_risk_score for r in got] == ["MEDIUM", "LOW", "MEDIUM", "MEDIUM", "LOW", "N/A", "HIGH", "LOW"]
    assert got[2].r.risk_note != got[3].r.risk_note


def test_status_order(table):
    rows = [
        (0, None, 0.9, "x", "x", "x"), (1, "Normal", 0.69, "error", "", ""), (2, "Normal", 0.7, "NORMAL Error", "", "normal"),
        (3, "Normal", 0.9, "normal", "an ERROR", "normal"), (4, "Normal", 0.9, "none", "ok", "normal"),
        (5, "Normal", 0.9, "normal", "ok", "nothing"), (6, "Normal", 0.7, "aNORMALb", None, "Normal"),
        (7, "Normal", 0.9, None, None, "normal"),
    ]
    df = table("i int, c string, p double, a string, m string, r string", rows)
    got = [r.s for r in df.select("i", rec.triage_status("c", "p", "a", "m", "r").alias("s")).orderBy("i").collect()]
    assert got == ["ERROR"] + ["FLAGGED_FOR_REVIEW"] * 5 + ["AUTONOMOUS", "FLAGGED_FOR_REVIEW"]


def test_incident_ids(spark):
    ids = spark.range(3).select(rec.incident_id("id").alias("a"), rec.incident_id("id", random=True).alias("b")).collect()
    assert all(re.fullmatch(r"INC-[0-9A-F]{12}", v) for r in ids for v in r)
    assert len({r.a for r in ids}) == 3 and len({r.b for r in ids}) == 3


def test_mapping_lookup(spark, table):
    twice = dims.knowledge(spark).unionByName(
        table("id string, type string, class_name string, tactic_id string",
              [("zzz", "class_mapping", "Normal", "other"), ("aaa", "incident", "Normal", "no")]),
        allowMissingColumns=True)
    df = table("i int, class_name string", [(0, "Normal"), (1, "Nope"), (2, None), (3, "Command Flooding")])
    got = lookup.with_class_mapping(df, lookup.class_mappings(twice)).orderBy("i").collect()
    assert [r.tactic_id for r in got] == ["N/A", None, None, "ST0009 / ST0003"]
    assert got[1].mapping_error == "No class mapping found for 'Nope'"


def test_cached_result_messages(spark, table):
    asked = table("class_name string", [("Normal",), ("Data Injection",), ("Command Flooding",)])
    stored = table("class_name string, status string, detected string, confidence double, true_label int",
                   [("Normal", "AUTONOMOUS", "Normal", 0.9, 0), ("Data Injection", "ERROR", None, None, 3)])
    got = {r.class_name: (r.detected, r.message) for r in lookup.cached_results(asked, stored).collect()}
    assert got == {"Normal": ("Normal", "ok"), "Data Injection": ("ERROR", "classification missing"),
                   "Command Flooding": (None, "'Command Flooding' not stored yet")}
    assert {r.message for r in lookup.cached_results(asked, None).collect()} == {"No results stored yet"}


@pytest.fixture
def incidents(spark, table):
    stats = {"x": (0.0, 1.0), "y": (0.0, 1.0), "flat": (0.0, 0.0), "w": (0.0, 1.0)}
    df = table("seq long, x double, y double, flat double, w double, predicted_label int, confidence double",
               [(1, 9.0, -9.0, 5.0, 1.0, 2, 0.9), (2, 8.0, None, 1.0, 0.5, 4, 0.3), (3, 0.0, 0.0, 99.0, 0.0, 1, 0.9),
                (4, 7.0, 0.0, 0.0, 0.0, 9, 0.9)])
    return triage(df.withColumn("ts", F.lit("2026-07-25 22:45:12").cast("timestamp")), stats, list(stats))


def test_triage_keeps_escalated_rows_only_and_never_drops_a_bad_one(incidents):
    got = {r.seq: r for r in incidents.collect()}
    assert set(got) == {1, 2, 4}
    assert (got[1].status, got[2].status, got[4].status) == ("AUTONOMOUS", "FLAGGED_FOR_REVIEW", "ERROR")
    record = got[1].record
    assert [d.feature_name for d in record.shap_drivers] == ["x", "y", "w"]
    assert record.mitigation.executed_tool_call == "tool_rate_limit_uplink"
    assert record.human_review.asDict() == {"status": "PENDING_REVIEW", "reviewer_id": None, "review_timestamp": None}
    assert [d.feature_name for d in got[2].record.shap_drivers] == ["x", "w"]
    assert "Command Flooding" in got[1].report and got[1].report.count("\n") == 6


def test_records_survive_json(incidents, spark, tmp_path):
    text = incidents_as_json(incidents)
    first = json.loads(text.where("seq = 1").first().json)
    assert list(first) == ["incident_id", "timestamp_utc", "satellite_id", "classification", "shap_drivers",
                           "sparta_context", "mitigation", "false_positive_risk", "human_review"]
    assert first["timestamp_utc"] == "2026-07-25T22:45:12Z" and first["human_review"]["reviewer_id"] is None
    back = parse_incidents(text, incidents)
    assert sorted(back.select("seq", "record").collect()) == sorted(incidents.select("seq", "record").collect())
    write_incidents(incidents, str(tmp_path / "out"))
    assert spark.read.schema(incidents.schema).json(str(tmp_path / "out")).count() == 3


def test_ids_differ_between_satellites_and_moments(spark, table):
    rows = table("seq long, ts timestamp", [(7, dt.datetime(2026, 1, 1)), (7, dt.datetime(2026, 1, 2))])
    ids = {r[0] for name in ("A", "B") for r in rows.select(rec.incident_id("seq", "ts", name)).collect()}
    assert len(ids) == 4


def test_utc_text_in_any_session_zone(spark, table):
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert spark.sql("SELECT timestamp_seconds(0) AS ts").select(rec.utc_text("ts")).first()[0] == "1970-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_text_is_rounded_half_to_even(table):
    rows = table("v double", [(0.025,)])
    assert rows.select(percent_text("v", 0)).first()[0] == "2%"


def test_sql_and_joins_agree_on_null_and_unknown_classes(spark, table):
    sql_functions.register(spark, {"a": (0.0, 1.0)}, ["a"])
    rows = table("class_name string, confidence double", [(None, 0.9), ("nope", 0.9), ("Normal", None)])
    joined = lookup.with_mitigation(rows, dims.policy_bands(spark)).select("class_name", "policy_error")
    joined = lookup.with_class_mapping(joined, lookup.class_mappings(dims.knowledge(spark)))
    by_join = {r.class_name: (r.policy_error, r.mapping_error) for r in joined.collect()}
    rows.createOrReplaceTempView("null_classes")
    by_sql = {r[0]: (r[1], r[2]) for r in spark.sql(
        "SELECT class_name, decide_mitigation(class_name, confidence).error, class_mapping(class_name).error FROM null_classes").collect()}
    assert by_join == by_sql and by_sql[None][0] == "No policy defined for class 'null'"


def test_a_run_written_twice_is_there_once(spark, tmp_path, table):
    rows = table("seq long, ts timestamp, a double, predicted_label int, confidence double", [(1, dt.datetime(2026, 1, 1), 9.0, 1, 0.9)])
    incidents = triage(rows, {"a": (0.0, 1.0)}, ["a"])
    for run in ("r1", "r1", "r2"):
        write_incidents(incidents, str(tmp_path / "out"), run)
    assert spark.read.json(str(tmp_path / "out")).groupBy("run").count().orderBy("run").collect() == [("r1", 1), ("r2", 1)]


def test_scratch_is_empty_after_its_scope(spark):
    import glob
    root = scratch_root(spark).removeprefix("file:")
    before = set(glob.glob(f"{root}/*"))
    with scratch_scope(spark):
        assert materialize(spark.range(5), "x").count() == 5
    assert set(glob.glob(f"{root}/*")) == before
