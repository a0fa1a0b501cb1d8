"""The same queries as ANSI SQL over the given tables, for checking results.

Written apart from the DataFrame code: only fixed values are shared.  Trained models
have no SQL form and are checked by row counts and tests.
"""

from __future__ import annotations

from perigee import fixed_values as fv
from perigee.sources import proxy

FEATURES = proxy.FEATURES
Z = 3.0

PROXY = """
proxy AS (
  SELECT event_id AS seq, ts,
    CAST(user_id AS DOUBLE) AS MsgId,
    CAST(k AS DOUBLE) AS CmdCode,
    2 * pi() * ((epoch_us(ts) % 86400000000) / 1e6) / 86400.0 AS TimeRadians,
    value AS MsgLength,
    CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2
      WHEN 'signup' THEN 3 WHEN 'error' THEN 4 END AS Label,
    k % 5 AS pred,
    CAST(k AS DOUBLE) / CAST(100 AS DOUBLE) AS confidence
  FROM (SELECT *, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events) e
)"""

BASE = "base AS (SELECT " + ", ".join(
    f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in FEATURES
) + " FROM proxy WHERE Label = 0)"


def _z(feature: str) -> str:
    return f"(abs({feature} - m_{feature}) / nullif(s_{feature}, 0))"


def _tripped(threshold: float) -> str:
    return " + ".join(f"(CASE WHEN {_z(f)} > {threshold} THEN 1 ELSE 0 END)" for f in FEATURES)


def _text(value: object) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


CLASSES = "classes(label, class_name) AS (VALUES " + ", ".join(
    f"({i}, {_text(name)})" for i, name in enumerate(fv.CLASS_NAMES)
) + ")"
POLICY = "policy(class_name, lo, action, tool_function, guardrail_note) AS (VALUES " + ", ".join(
    f"({_text(c)}, CAST({lo} AS DOUBLE), {_text(a)}, {_text(t)}, {_text(n)})" for c, lo, a, t, n in fv.POLICY
) + ")"
MAPPING = "mapping(class_name, tactic_id, technique_id) AS (VALUES " + ", ".join(
    f"({_text(c)}, {_text(tactic)}, {_text(technique)})"
    for _, _, c, tactic, _, technique, _ in fv.CLASS_MAPPINGS
) + ")"
CLASSIFIED = "classified AS (SELECT p.*, p.pred AS predicted_label, c.class_name FROM proxy p LEFT JOIN classes c ON c.label = p.pred)"
# The highest bound a confidence reaches, found by ranking instead of by bands.
DECIDED = """decided AS (
  SELECT c.*, b.action, b.tool_function, b.guardrail_note
  FROM classified c LEFT JOIN (
    SELECT x.seq, p.action, p.tool_function, p.guardrail_note,
      row_number() OVER (PARTITION BY x.seq ORDER BY p.lo DESC) AS place
    FROM classified x JOIN policy p ON p.class_name = x.class_name AND x.confidence >= p.lo
  ) b ON b.seq = c.seq AND b.place = 1
)"""
SEVERITY = (
    "CASE WHEN class_name = 'Normal' THEN 'NONE' ELSE CASE action "
    + " ".join(f"WHEN {_text(a)} THEN {_text(s)}" for a, s in fv.SEVERITY_OF_ACTION.items())
    + " ELSE 'LOW' END END"
)


def _risk(part: int, class_name: str = "class_name") -> str:
    value = {rule: _text(pair[part]) for rule, pair in fv.FP_RISK.items()}
    return (
        f"CASE WHEN {class_name} = 'Normal' THEN {value['normal']} WHEN confidence < 0.7 THEN {value['guardrail']} "
        f"WHEN {class_name} IN ('Command Flooding', 'Data Injection') AND confidence < 0.85 THEN {value['confused']} "
        f"WHEN {class_name} = 'Data Injection' THEN {value['false_alarm']} ELSE {value['other']} END"
    )


DRIVERS = "drivers AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY z DESC, pos) AS place FROM (" + " UNION ALL ".join(
    f"SELECT seq, '{f}' AS feature, {f} AS value, {_z(f)} AS z, {i} AS pos FROM proxy, base"
    for i, f in enumerate(FEATURES)
) + ") d WHERE z IS NOT NULL)"
INCIDENT_ID = (
    f"'INC-' || substr(upper(sha256('{fv.SATELLITE_ID}|' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || '|' || CAST(d.seq AS VARCHAR))), 1, 12)"
)


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"


TRIAGED = _with(PROXY, BASE, CLASSES, POLICY, MAPPING, CLASSIFIED, DECIDED, DRIVERS)
ESCALATED = f"(SELECT seq FROM proxy, base WHERE {_tripped(Z)} >= 1)"

_RECORD_FIELDS = f"""
  d.seq, {INCIDENT_ID} AS incident_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc,
  '{fv.SATELLITE_ID}' AS satellite_id, predicted_label, d.class_name, confidence, {SEVERITY.replace("class_name", "d.class_name")} AS severity,
  tactic_id, technique_id, action AS recommended_action, tool_function AS executed_tool_call,
  action <> 'Escalate Alert' AS autonomous_execution, guardrail_note, confidence < 0.7 AS guardrail_fired,
  {_risk(0, "d.class_name")} AS fp_risk_score, {_risk(1, "d.class_name")} AS risk_note,
  'PENDING_REVIEW' AS review_status, top.feature AS top_feature,
  CASE WHEN confidence < 0.7 THEN 'FLAGGED_FOR_REVIEW' ELSE 'AUTONOMOUS' END AS status
"""
INCIDENT = TRIAGED + f"""SELECT {_RECORD_FIELDS}
FROM decided d LEFT JOIN mapping m ON m.class_name = d.class_name
LEFT JOIN drivers top ON top.seq = d.seq AND top.place = 1
WHERE d.seq IN {ESCALATED}"""

REPORT = TRIAGED + f"""SELECT d.seq,
  'INCIDENT REPORT ' || {INCIDENT_ID} || ' for {fv.SATELLITE_ID}' || chr(10)
  || '1. Detection: ' || d.class_name || ' (label ' || predicted_label || '), confidence ' || printf('%.4f', confidence)
  || ', severity ' || {SEVERITY.replace("class_name", "d.class_name")} || chr(10)
  || '2. Feature drivers: ' || t.shown || chr(10)
  || '3. Taxonomy: tactic ' || tactic_id || ', technique ' || technique_id || chr(10)
  || '4. False-positive risk: ' || {_risk(0, "d.class_name")} || ' - ' || {_risk(1, "d.class_name")} || chr(10)
  || '5. Mitigation: ' || action || ' via ' || tool_function || '; ' || guardrail_note || chr(10)
  || '6. Human review: PENDING_REVIEW' AS report
FROM decided d JOIN mapping m ON m.class_name = d.class_name
JOIN (SELECT seq, string_agg(feature || '=' || printf('%.2f', value) || ' (z ' || printf('%.2f', z) || ')', ', ' ORDER BY place) AS shown
      FROM drivers WHERE place <= 3 GROUP BY seq) t ON t.seq = d.seq
WHERE d.seq IN {ESCALATED}"""

_ERRORS = "errors AS (SELECT seq, Label, pred, MsgLength * MsgLength / 100.0 AS error FROM proxy)"
_LIMITS = """limits AS (SELECT quantile_cont(error, 0.95) AS pct, avg(error) + 2 * stddev_pop(error) AS adaptive
  FROM errors WHERE Label = 0)"""
_OVERRIDE = """overridden AS (SELECT seq, Label, pred AS model, CASE WHEN error < pct THEN 0 ELSE pred END AS ensemble,
  CASE WHEN error < adaptive THEN 0 ELSE pred END AS tuned_ensemble FROM errors, limits)"""


def _metrics(counts: str, by: str = "") -> str:
    """Class metrics over a relation ``counts(by, truth, predicted, n)``."""
    key = f"{by}, " if by else ""
    return f"""sides AS (
  SELECT {key}truth AS class, n AS support, 0 AS claimed, CASE WHEN truth = predicted THEN n ELSE 0 END AS hits FROM {counts}
  UNION ALL SELECT {key}predicted, 0, n, 0 FROM {counts}),
totals AS (SELECT {key}class, sum(support) AS support, sum(claimed) AS claimed, sum(hits) AS hits FROM sides GROUP BY {key}class),
scores AS (SELECT {key}class, CAST(support AS BIGINT) AS support,
  CASE WHEN claimed > 0 THEN hits / claimed ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall,
  CASE WHEN support + claimed > 0 THEN 2 * hits / (support + claimed) ELSE 0.0 END AS f1, hits FROM totals)"""


_COUNTS = "counts AS (SELECT Label AS truth, pred AS predicted, count(*) AS n FROM proxy GROUP BY 1, 2)"
_OVERALL = """CAST(sum(support) AS BIGINT) AS rows, round(sum(hits) / sum(support), 6) AS accuracy,
  round(avg(f1), 6) AS macro_f1 FROM scores"""

_SPLITS = """raw AS (SELECT *, CAST(k AS DOUBLE) % 7 AS CommandErrorCounter FROM (SELECT *, CmdCode AS k FROM proxy) r),
noised AS (SELECT seq, MsgId, CmdCode + 3.0 * sin(CAST(seq AS DOUBLE)) AS CmdCode, TimeRadians,
  MsgLength + 10.0 * sin(CAST(seq AS DOUBLE)) AS MsgLength, Label FROM proxy)"""

_NUMBERED = "numbered AS (SELECT *, row_number() OVER (ORDER BY seq) - 1 AS idx FROM proxy)"
_LINES = [*proxy.LINE_FEATURES, "l_linenumber", "constant"]


def _corr(x: str, y: str) -> str:
    r = "1.0::DOUBLE" if x == y else f"round(corr({x}, {y}), 6)"
    return f"SELECT '{x}' AS f1, '{y}' AS f2, CASE WHEN stddev_pop({x}) > 0 AND stddev_pop({y}) > 0 THEN {r} END AS r FROM lines"


_LIVE = "SELECT seq, Label, CmdCode, MsgLength FROM proxy ORDER BY seq DESC LIMIT 200"
_HISTORY = _with(PROXY) + "SELECT seq, MsgLength, CmdCode FROM proxy ORDER BY seq DESC LIMIT 300"

ORACLE: dict[str, str] = {
    "baseline_stats": _with(PROXY, BASE) + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std FROM base" for f in FEATURES
    ),
    "escalation_gate": _with(PROXY, BASE)
    + f"SELECT seq, {_tripped(Z)} AS tripped, ({_tripped(Z)}) >= 1 AS escalate FROM proxy, base",
    "escalation_gate_two_features": _with(PROXY, BASE)
    + f"SELECT seq, {_tripped(1.5)} AS tripped, ({_tripped(1.5)}) >= 2 AS escalate FROM proxy, base",
    "escalation_rate": _with(PROXY, BASE)
    + f"""SELECT Label, CAST(sum(e) AS BIGINT) AS escalated, count(*) AS total, round(sum(e) / count(*), 6) AS rate,
  format('{{:,}}', CAST(sum(e) AS BIGINT)) || '/' || format('{{:,}}', count(*)) AS shown
FROM (SELECT Label, CASE WHEN ({_tripped(5.0)}) >= 1 THEN 1 ELSE 0 END AS e FROM proxy, base) g GROUP BY Label""",
    "escalation_sql": _with(PROXY, BASE)
    + f"SELECT seq, ({_tripped(Z)}) >= 1 AS escalate, {_risk(0, _text('Data Injection'))} AS risk FROM proxy, base",
    "mitigation_sql": _with(PROXY, CLASSES, POLICY, MAPPING, CLASSIFIED, DECIDED)
    + f"""SELECT seq, action, tool_function, guardrail_note, action <> 'Escalate Alert' AS autonomous, tactic_id, technique_id,
  {SEVERITY.replace("class_name", "d.class_name")} AS severity
FROM decided d JOIN mapping m ON m.class_name = d.class_name""",
    "feature_z": _with(PROXY, BASE) + " UNION ALL ".join(
        f"SELECT seq, '{f}' AS feature, round({f}, 6) AS value, round({_z(f)}, 6) AS z FROM proxy, base"
        for f in FEATURES
    ),
    "top_drivers": _with(PROXY, BASE, DRIVERS)
    + "SELECT seq, CAST(place AS INTEGER) AS rank, feature, round(z, 6) AS z FROM drivers WHERE place <= 3",
    "class_mapping": _with(PROXY, CLASSES, MAPPING, CLASSIFIED)
    + """SELECT seq, c.class_name, tactic_id, technique_id,
  CASE WHEN m.class_name IS NULL THEN 'No class mapping found for ''' || c.class_name || '''' END AS mapping_error
FROM classified c LEFT JOIN mapping m ON m.class_name = c.class_name""",
    "policy_bands": _with(PROXY, CLASSES, POLICY, CLASSIFIED, DECIDED)
    + """SELECT seq, class_name, confidence, action, tool_function, guardrail_note,
  action <> 'Escalate Alert' AS autonomous, CAST(NULL AS VARCHAR) AS policy_error FROM decided""",
    "policy_errors": _with(
        POLICY,
        """classified AS (SELECT event_id AS seq, CASE WHEN event_type = 'view' THEN 'Data Injection' ELSE event_type END AS class_name,
  (value - 20.0) / 50.0 AS confidence FROM events)""",
        DECIDED,
    )
    + """SELECT seq, action, CASE WHEN class_name <> 'Data Injection' THEN 'No policy defined for class ''' || class_name || ''''
  WHEN action IS NULL THEN 'unreachable' END AS policy_error FROM decided""",
    "severity_fp_risk": _with(PROXY, CLASSES, POLICY, CLASSIFIED, DECIDED)
    + f"SELECT seq, {SEVERITY} AS severity, {_risk(0)} AS fp_risk_score, {_risk(1)} AS risk_note FROM decided",
    "triage_status": _with(PROXY, CLASSES, CLASSIFIED)
    + """SELECT c.seq, CASE WHEN class_name IS NULL THEN 'ERROR' WHEN confidence < 0.7 THEN 'FLAGGED_FOR_REVIEW'
  WHEN contains(lower(concat_ws(' ', text, class_name)), 'error') OR contains(lower(coalesce(source, '')), 'error')
    THEN 'FLAGGED_FOR_REVIEW'
  WHEN CmdCode >= 90 THEN 'FLAGGED_FOR_REVIEW' ELSE 'AUTONOMOUS' END AS status
FROM classified c LEFT JOIN documents d ON d.doc_id = c.seq""",
    "incident_record": INCIDENT,
    "incident_json": TRIAGED
    + f"""SELECT seq, incident_id, timestamp_utc, class_name, severity, recommended_action, autonomous_execution,
  guardrail_fired, fp_risk_score, review_status FROM (SELECT {_RECORD_FIELDS}
FROM decided d LEFT JOIN mapping m ON m.class_name = d.class_name
LEFT JOIN drivers top ON top.seq = d.seq AND top.place = 1) r""",
    "report_text": REPORT,
    "rounded_confidence": """WITH s AS (SELECT event_id AS seq, [CAST((event_id * (c * 6 + 7) + user_id * (c + 3)) % 101 AS DOUBLE)
  FOR c IN [0, 1, 2, 3, 4]] AS s FROM events)
SELECT seq, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS predicted_label,
  CASE WHEN list_sum(s) > 0 THEN CAST(printf('%.4f', list_max(s) / list_sum(s)) AS DOUBLE) END AS confidence,
  CASE WHEN list_sum(s) > 0 THEN printf('%.0f', CAST(printf('%.2f', list_max(s) / list_sum(s)) AS DOUBLE) * 100) || '%' END AS shown
FROM s""",
    "similar_incidents": """SELECT vec_id, CAST(place AS INTEGER) AS rank, match_id, round(distance, 6) AS distance FROM (
  SELECT q.vec_id, b.vec_id AS match_id,
    pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS place
  FROM embeddings q, embeddings b WHERE b.label >= 5) r WHERE place <= 2""",
    "result_refresh": _with(
        PROXY,
        """done AS (SELECT Label, MsgId, max(confidence) AS confidence,
  CASE WHEN max(confidence) > 0.9 THEN 'AUTONOMOUS' ELSE 'ERROR' END AS status FROM proxy WHERE Label <> 4 GROUP BY 1, 2)""",
        "good AS (SELECT * FROM done WHERE status <> 'ERROR')",
    )
    + """SELECT Label, MsgId, confidence, status FROM good
UNION ALL SELECT Label, MsgId, min(confidence), CASE WHEN min(confidence) < 0.7 THEN 'FLAGGED_FOR_REVIEW' ELSE 'AUTONOMOUS' END
FROM proxy p WHERE NOT EXISTS (SELECT 1 FROM good g WHERE g.Label = p.Label AND g.MsgId = p.MsgId) GROUP BY 1, 2""",
    "cached_lookup": _with(
        PROXY, CLASSES,
        "found AS (SELECT pred, max(confidence) AS confidence FROM proxy WHERE pred <> 4 GROUP BY pred)",
    )
    + """SELECT class_name, CASE WHEN pred = 3 THEN 'ERROR' WHEN pred IS NOT NULL THEN 'AUTONOMOUS' END AS status,
  CASE WHEN pred = 3 THEN 'ERROR' WHEN pred IS NOT NULL THEN class_name END AS detected, confidence, pred AS true_label,
  CASE WHEN pred IS NULL THEN '''' || class_name || ''' not stored yet' WHEN pred = 3 THEN 'classification missing' ELSE 'ok' END AS message
FROM classes LEFT JOIN found ON pred = label""",
    "kb_upsert": """WITH w AS (SELECT user_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS size,
  row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM events)
SELECT id, 'incident' AS type, size FROM w WHERE place = 1
UNION ALL SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT id FROM w)""",
    "label_mix": _with(PROXY) + "SELECT Label, count(*) AS n FROM proxy WHERE Label IS NOT NULL GROUP BY Label",
    "range_audit": _with(PROXY)
    + """SELECT round(min(TimeRadians), 6) AS min_value, round(max(TimeRadians), 6) AS max_value,
  count(*) FILTER (WHERE TimeRadians < 0 OR TimeRadians > 6.28) AS out_of_range FROM proxy""",
    "dataset_profile": _with(PROXY)
    + "SELECT count(*) AS rows, 9 AS columns, count(DISTINCT Label) AS classes FROM proxy",
    "correlation": "WITH lines AS (SELECT *, CAST(0.5 AS DOUBLE) AS constant FROM lineitem)\n" + " UNION ALL ".join(
        _corr(x, y) for x in _LINES for y in _LINES
    ),
    "class_diversity": _with(PROXY)
    + """SELECT Label, round(quantile_cont(MsgLength, 0.25), 6) AS p25, round(quantile_cont(MsgLength, 0.5), 6) AS p50,
  round(quantile_cont(MsgLength, 0.75), 6) AS p75, count(DISTINCT CmdCode) AS codes FROM proxy GROUP BY Label""",
    "class_sizes": _with(PROXY, CLASSES)
    + """SELECT p.Label, class_name, count(*) AS n FROM proxy p JOIN classes c ON c.label = p.Label
WHERE class_name IN ('Command Flooding', 'Data Injection') GROUP BY 1, 2""",
    "confusion": _with(PROXY, _COUNTS) + "SELECT truth, predicted, n FROM counts",
    "confusion_matrix": _with(PROXY) + "SELECT Label AS truth, " + ", ".join(
        f"count(*) FILTER (WHERE pred = {c}) AS predicted_{c}" for c in range(len(fv.CLASS_NAMES))
    ) + " FROM proxy GROUP BY Label",
    "class_metrics": _with(PROXY, _COUNTS, _metrics("counts"))
    + "SELECT class, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM scores",
    "macro_f1": _with(PROXY, _COUNTS, _metrics("counts")) + f"SELECT {_OVERALL}",
    "accuracy": _with(PROXY)
    + "SELECT round(avg(CASE WHEN Label = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM proxy",
    "label_agreement": _with(
        "counts AS (SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels GROUP BY 1, 2)",
        _metrics("counts"),
    ) + f"SELECT {_OVERALL}",
    "threshold_percentile": _with(PROXY, _ERRORS, _LIMITS) + "SELECT round(pct, 6) AS threshold FROM limits",
    "threshold_adaptive": _with(PROXY, _ERRORS, _LIMITS) + "SELECT round(adaptive, 6) AS threshold FROM limits",
    "ensemble_override": _with(PROXY, _ERRORS, _LIMITS, _OVERRIDE) + "SELECT * FROM overridden",
    "model_comparison": _with(
        PROXY, _ERRORS, _LIMITS, _OVERRIDE,
        "counts AS (" + " UNION ALL ".join(
            f"SELECT '{m}' AS model, Label AS truth, {m} AS predicted, count(*) AS n FROM overridden GROUP BY 1, 2, 3"
            for m in ["model", "ensemble", "tuned_ensemble"]
        ) + ")",
        _metrics("counts", "model"),
    ) + f"SELECT model, {_OVERALL} GROUP BY model",
    "reconstruction_error": """WITH x AS (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
m AS (SELECT label, pos, avg(CAST(v AS DOUBLE)) AS mean FROM x GROUP BY 1, 2)
SELECT vec_id, round(avg(pow(CAST(v AS DOUBLE) - mean, 2)), 6) AS error FROM x JOIN m ON m.label = x.label AND m.pos = x.pos GROUP BY vec_id""",
    "misclassified_drivers": _with(PROXY, BASE) + " UNION ALL ".join(
        f"SELECT '{f}' AS feature, round(avg({_z(f)}), 6) AS mean_abs_z FROM proxy, base WHERE Label = 2 AND pred = 3"
        for f in FEATURES
    ),
    "scaled_features": "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, " + ", ".join(
        f"round(({f} - (SELECT avg({f}) FROM lineitem)) / (SELECT stddev_pop({f}) FROM lineitem), 6) AS {f}"
        for f in proxy.LINE_FEATURES
    ) + " FROM lineitem",
    "cyclic_time": _with(PROXY)
    + "SELECT seq, round(sin(TimeRadians), 6) AS Time_Sin, round(cos(TimeRadians), 6) AS Time_Cos FROM proxy",
    "contract_split": """SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'not numeric: MsgLength'
  WHEN event_type NOT IN ('error', 'view') THEN 'unknown class: ' || event_type END AS contract_error FROM events""",
    "shared_features": _with(PROXY, _SPLITS) + "SELECT seq, " + ", ".join(
        f"round({f}, 6) AS {f}" for f in FEATURES
    ) + " FROM noised",
    "split_union": _with(PROXY, _SPLITS)
    + """SELECT seq, 'raw' AS split, CAST(Label AS VARCHAR) AS Label, round(CmdCode, 6) AS CmdCode, CommandErrorCounter FROM raw
UNION ALL SELECT seq, 'noised', CAST(Label AS VARCHAR), round(CmdCode, 6), NULL FROM noised""",
    "sequences_labelled": _with(PROXY, _NUMBERED) + "SELECT idx, Label, " + ", ".join(
        f"t{i}" for i in range(10)
    ) + " FROM (SELECT idx, Label, " + ", ".join(
        f"lag(MsgLength, {10 - i}) OVER (ORDER BY idx) AS t{i}" for i in range(10)
    ) + " FROM numbered) w WHERE idx >= 10",
    "sequences_unlabelled": _with(PROXY, _NUMBERED) + "SELECT * FROM (SELECT idx, " + ", ".join(
        f"lag({c}, {9 - i}) OVER (ORDER BY idx) AS {n}{i}" for i in range(10) for c, n in [("CmdCode", "c"), ("MsgLength", "m")]
    ) + " FROM numbered) w WHERE idx >= 9",
    "straddling_sequences": _with(PROXY, _NUMBERED)
    + """SELECT straddles, count(*) AS n, round(avg(CASE WHEN Label <> pred THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM (
  SELECT idx, Label, pred, NOT (lag(Label, 1) OVER o = lag(Label, 2) OVER o AND lag(Label, 2) OVER o = lag(Label, 3) OVER o) AS straddles
  FROM numbered WINDOW o AS (ORDER BY idx)) w WHERE idx >= 3 GROUP BY straddles""",
    "representative_row": _with(PROXY)
    + """SELECT seq, Label, CmdCode, MsgLength FROM (SELECT *, row_number() OVER (PARTITION BY Label ORDER BY seq) - 1 AS pos,
  count(*) OVER (PARTITION BY Label) AS n FROM proxy) r WHERE pos = n // 3""",
    "last_n": _with(PROXY) + "SELECT seq, Label, MsgLength FROM proxy ORDER BY seq DESC LIMIT 200",
    "newest_first": _with(PROXY)
    + """SELECT seq, Label, MsgLength, CAST(place AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (ORDER BY seq DESC) AS place FROM proxy) r WHERE place <= 20""",
    "first_rows": _with(PROXY) + "SELECT seq, Label, MsgLength FROM proxy ORDER BY seq LIMIT 8",
    "metric_history": _HISTORY,
    "replay_shuffled": _with(PROXY)
    + "SELECT seq, Label, row_number() OVER (ORDER BY md5(CAST(seq AS VARCHAR) || ':42'), seq) - 1 AS position FROM proxy",
    "replay_sequential": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
  row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS position FROM lineitem""",
    "stream_triage": INCIDENT,
    "stream_counters": _with(PROXY, BASE)
    + f"SELECT count(*) AS seen, CAST(sum(CASE WHEN ({_tripped(Z)}) >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS escalated FROM proxy, base",
    "stream_last_n": _with(PROXY) + _LIVE,
    "stream_label_mix": _with(PROXY) + f"SELECT Label, count(*) AS n FROM ({_LIVE}) b GROUP BY Label",
    "stream_metric_history": _HISTORY,
}
ORACLE["stream_gate"] = ORACLE["escalation_gate"]
ORACLE["gate_counts"] = ORACLE["stream_counters"]
ORACLE["stats_files"] = ORACLE["baseline_stats"]
ORACLE["incident_files"] = INCIDENT
ORACLE["csv_ingest"] = _with(PROXY) + "SELECT seq, MsgId, CmdCode, round(TimeRadians, 6) AS TimeRadians, MsgLength, Label FROM proxy"

_BROKEN = """broken AS (SELECT seq, CASE WHEN seq % 29 = 5 AND seq % 17 = 3 THEN 'not numeric: CmdCode,MsgLength'
  WHEN seq % 29 = 5 THEN 'not numeric: CmdCode' WHEN seq % 17 = 3 THEN 'not numeric: MsgLength' END AS reason FROM proxy)"""
ORACLE["triage_quarantine"] = _with(PROXY, BASE, CLASSES, POLICY, CLASSIFIED, DECIDED, _BROKEN) + f"""SELECT d.seq,
  CASE WHEN reason IS NOT NULL THEN 'ERROR' WHEN confidence < 0.7 THEN 'FLAGGED_FOR_REVIEW' ELSE 'AUTONOMOUS' END AS status,
  reason, CASE WHEN reason IS NULL THEN {INCIDENT_ID} END AS incident_id, CASE WHEN reason IS NULL THEN action END AS recommended_action
FROM decided d JOIN broken b ON b.seq = d.seq WHERE reason IS NOT NULL OR d.seq IN {ESCALATED}"""
ORACLE["stream_quarantine"] = ORACLE["triage_quarantine"]
ORACLE["quarantine_counts"] = _with(PROXY, BASE, _BROKEN) + f"""SELECT count(*) AS seen,
  count(*) FILTER (WHERE reason IS NULL AND seq IN {ESCALATED}) AS escalated,
  count(*) FILTER (WHERE reason IS NULL AND seq NOT IN {ESCALATED}) AS skipped,
  count(*) FILTER (WHERE reason IS NOT NULL) AS quarantined FROM broken"""
ORACLE["incident_precedent"] = _with(PROXY, BASE) + f"""SELECT e.seq, p.precedent_id, p.distance FROM {ESCALATED} e LEFT JOIN (
  SELECT q.vec_id AS seq, b.vec_id AS precedent_id,
    round(pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2), 6) AS distance,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY
      list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), b.vec_id) AS place
  FROM embeddings q, embeddings b WHERE b.label >= 5) p ON p.seq = e.seq AND p.place = 1"""
ORACLE["similar_by_blocks"] = ORACLE["similar_incidents"]
ORACLE["importance_sum"] = f"SELECT CAST({len(FEATURES)} AS BIGINT) AS features, CAST(1 AS DOUBLE) AS total, true AS none_negative"
ORACLE["model_predictions"] = _with(PROXY) + "SELECT seq, Label, true AS known, true AS possible, true AS named FROM proxy"
ORACLE["anomaly_two_features"] = _with(
    PROXY, _SPLITS,
    "fit AS (SELECT avg(CmdCode) AS m1, stddev_pop(CmdCode) AS s1, avg(MsgLength) AS m2, stddev_pop(MsgLength) AS s2 FROM raw)",
    "z AS (SELECT (CmdCode - m1) / s1 AS x, (MsgLength - m2) / s2 AS y FROM raw, fit WHERE Label = 0)",
    "moments AS (SELECT avg(x) AS cx, avg(y) AS cy, var_samp(x) AS a, covar_samp(x, y) AS b, var_samp(y) AS c FROM z)",
    # The axis of the smaller variance, as an angle: what is left of a row lies along it.
    "axis AS (SELECT cx, cy, 0.5 * atan2(2 * b, a - c) + pi() / 2 AS t FROM moments)",
) + """SELECT seq, round(pow(cos(t) * ((CmdCode - m1) / s1 - cx) + sin(t) * ((MsgLength - m2) / s2 - cy), 2) / 2, 6) AS error
FROM noised, fit, axis"""
_WIDE = "wide AS (SELECT " + ", ".join(f"{sql} AS {f}" for sql, f in zip(proxy.WIDE, fv.FEATURES)) + f", {proxy.WIDE_LABEL} AS Label FROM lineitem)"
_WIDE_BASE = "wide_base AS (SELECT " + ", ".join(f"avg({f}) AS m_{f}, stddev_samp({f}) AS s_{f}" for f in fv.FEATURES) + " FROM wide WHERE Label = 0)"
_WIDE_TRIPPED = " + ".join(f"(CASE WHEN {_z(f)} > 2.0 THEN 1 ELSE 0 END)" for f in fv.FEATURES)
ORACLE["wide_baseline"] = _with(_WIDE, _WIDE_BASE) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, round(m_{f}, 6) AS mean, round(s_{f}, 6) AS std FROM wide_base" for f in fv.FEATURES
)
ORACLE["wide_gate"] = _with(_WIDE, _WIDE_BASE, f"gated AS (SELECT Label, {_WIDE_TRIPPED} AS tripped FROM wide, wide_base)") + """
SELECT Label, count(*) AS total, count(*) FILTER (WHERE tripped >= 2) AS escalated, CAST(sum(tripped) AS BIGINT) AS tripped FROM gated GROUP BY Label"""
ORACLE["discovered_files"] = "SELECT 'raw' AS role, count(*) AS rows FROM events UNION ALL SELECT 'noised', count(*) FROM events"
ORACLE["manifest_files"] = _with(PROXY) + "SELECT seq, " + ", ".join(f"round({f}, 6) AS {f}" for f in FEATURES) + " FROM proxy"
ORACLE["noised_features"] = ORACLE["shared_features"]
ORACLE["table_versions"] = _with(PROXY) + "SELECT Label, count(*) AS n FROM proxy WHERE Label <> 4 GROUP BY Label"
ORACLE["results_by_key"] = _with(PROXY) + """SELECT Label, MsgId, max(confidence) AS confidence,
  CASE WHEN Label = 1 THEN 'FLAGGED_FOR_REVIEW' WHEN max(confidence) > 0.9 THEN 'AUTONOMOUS' ELSE 'ERROR' END AS status
FROM proxy WHERE Label <> 4 GROUP BY 1, 2"""

ORACLE["table_versions"] = _with(PROXY) + "SELECT Label, count(*) AS n FROM proxy WHERE Label <> 4 GROUP BY Label"
ORACLE["boosted_predictions"] = _with(PROXY) + "SELECT seq, Label, true AS known, true AS possible, true AS decided FROM proxy"
ORACLE["metrics_agree"] = _with(PROXY) + "SELECT unnest(['forest', 'boosted']) AS model, count(*) AS rows, true AS accuracy_agrees, true AS macro_f1_agrees FROM proxy"
ORACLE["sequence_predictions"] = _with(PROXY, _NUMBERED) + "SELECT idx AS seq, Label, true AS known FROM numbered WHERE idx >= 10"
_CLOSED = "date_trunc('milliseconds', (SELECT max(ts) FROM proxy)) - INTERVAL 5 MINUTE"
_TRAFFIC = """SELECT strftime(start, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(start + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end, CmdCode,
  round(sum(MsgLength), 4) AS FlowLengthInWindow, count(*) AS MessageCountInWindow, count(DISTINCT MsgId) AS UniqueMessageIDsInWindow,
  round(avg(MsgLength), 4) AS AverageMessageLengthInWindow, round(count(*) / 21600.0, 4) AS MessageRateInWindow,
  round(stddev_pop(MsgLength), 4) AS StdDevMessageLengthInWindow,
  CASE WHEN count(*) > 1 THEN round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) END AS IntervalsSec
FROM (SELECT *, time_bucket(INTERVAL 3 HOUR, ts, TIMESTAMP '1970-01-01') - unnest([0, 3]) * INTERVAL 1 HOUR AS start FROM proxy) w"""
ORACLE["traffic_windows"] = _with(PROXY) + _TRAFFIC + " GROUP BY start, CmdCode"
ORACLE["stream_traffic_windows"] = _with(PROXY) + _TRAFFIC + f" WHERE start + INTERVAL 6 HOUR <= {_CLOSED} GROUP BY start, CmdCode"
ORACLE["stream_sessions"] = _with(
    PROXY,
    "marked AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY MsgId ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM proxy)",
    "bursts AS (SELECT *, sum(opens) OVER (PARTITION BY MsgId ORDER BY ts ROWS UNBOUNDED PRECEDING) AS burst FROM marked)",
) + f"""SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(ts) + INTERVAL 30 MINUTE, '%Y-%m-%d %H:%M:%S') AS session_end, MsgId,
  count(*) AS n, round(sum(MsgLength), 4) AS total FROM bursts GROUP BY MsgId, burst HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}"""
ORACLE["stream_accounts"] = _with(PROXY, "later AS (SELECT count(*) AS n FROM proxy WHERE seq > (SELECT max(seq) // 2 FROM proxy))") + """
SELECT 2 * count(*) + any_value(later.n) AS seen, 2 * count(*) AS turned_away, true AS agrees, any_value(later.n) AS kept, any_value(later.n) AS different FROM proxy, later"""
ORACLE["stream_triage_once"] = INCIDENT
ORACLE["stream_last_n_by_key"] = _with(PROXY) + """SELECT CmdCode, seq, MsgId, Label FROM (
  SELECT *, row_number() OVER (PARTITION BY CmdCode ORDER BY seq DESC) AS place FROM proxy) w WHERE place <= 3"""
ORACLE["csv_quarantine"] = _with(PROXY) + """SELECT CASE WHEN seq % 13 = 4 THEN seq || ',' || CAST(MsgId AS BIGINT)
  WHEN seq % 19 = 6 THEN seq || ',n/a,' || CAST(CmdCode AS BIGINT) || ',' || Label ELSE CAST(seq AS VARCHAR) END AS line,
  CASE WHEN bad IS NULL THEN MsgId END AS MsgId, CASE WHEN bad IS NULL THEN CmdCode END AS CmdCode, CASE WHEN bad IS NULL THEN Label END AS Label, bad AS reason
FROM (SELECT *, CASE WHEN seq % 13 = 4 THEN '2 fields instead of 4' WHEN seq % 19 = 6 THEN 'a field is not of its type' END AS bad FROM proxy) b"""
ORACLE["threshold_merged"] = _with(PROXY, _ERRORS) + "SELECT count(*) AS sketched, true AS within_bound FROM errors WHERE Label = 0"
ORACLE["permuted_features"] = _with(PROXY, _SPLITS) + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, count(*) AS rows, round(CAST(sum({f}) AS DOUBLE), 3) AS total FROM noised" for f in FEATURES
)
ORACLE["incident_inputs"] = _with(PROXY) + """SELECT seq, error AS contract_error, CASE WHEN error IS NULL THEN confidence END AS typed_confidence FROM (
  SELECT seq, confidence, CASE WHEN seq % 17 = 3 AND seq % 29 = 5 THEN 'missing or of another type: confidence,autonomous'
    WHEN seq % 17 = 3 THEN 'missing or of another type: confidence' WHEN seq % 29 = 5 THEN 'missing or of another type: autonomous'
    WHEN seq % 31 = 4 THEN 'confidence outside 0 to 1' WHEN seq % 23 = 2 THEN 'unknown class: Solar Flare' END AS error FROM proxy) e"""
ORACLE["index_recall"] = """SELECT count(*) AS queries, sum(least(2, (SELECT count(*) FROM embeddings WHERE label >= 5)))::BIGINT AS rows,
  true AS recall_reached FROM embeddings"""
ORACLE["autoencoder_errors"] = _with(PROXY, _SPLITS) + "SELECT count(*) AS rows, count(*) AS errors, true AS no_worse FROM noised"
ORACLE["record_sql"] = f"""SELECT seq, incident_id, class_name, confidence, severity, tactic_id, technique_id, recommended_action, autonomous_execution,
  guardrail_fired, fp_risk_score, risk_note, top_feature FROM ({ORACLE["incident_record"]}) r"""
ORACLE["classify_sql"] = _with(PROXY, _SPLITS) + "SELECT seq, Label, true AS same_label, true AS same_confidence FROM noised"
ORACLE["search_sql"] = """SELECT CAST(row_number() OVER (ORDER BY d, match_id) AS INTEGER) AS rank, match_id, round(d, 6) AS distance FROM (
  SELECT b.vec_id AS match_id, pow(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 2) AS d
  FROM embeddings b, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) q WHERE b.label >= 5 ORDER BY d, match_id LIMIT 20) n"""
