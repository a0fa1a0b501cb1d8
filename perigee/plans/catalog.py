"""Queries over the given tables: each operator of the package on a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions import incident as rec
from perigee.functions import sql as sql_functions
from perigee.functions import sql_tools
from perigee.functions.numeric import argmax, mean_squared_error, percent_text, round_exact, thousands_text
from perigee.operators import evaluate as ev
from perigee.operators import features as fx
from perigee.operators import gate as gt
from perigee.operators import autoencoder, boosting, lookup, models, order, profile, refresh, sequences, similarity, similarity_index
from perigee.plans import training
from perigee.plans.triage import (
    JSON_OPTIONS, assemble, flatten_incidents, incidents_as_json, parse_incidents, triage, triage_or_quarantine, with_precedent,
    write_incidents,
)
from perigee.session import materialize, scratch_path, scratch_root
from perigee.sources import dims, proxy, telemetry
from perigee.sources.artifacts import load_manifest, load_model, load_stats, manifest, save_model, save_table, stats_map
from perigee.streaming import event_time, keyed, live

Query = Callable[[SparkSession, str], DataFrame]
FEATURES = proxy.FEATURES
# The proxy table has few columns far from their mean; a lower bar makes the gate work.
PROXY_Z = 3.0
LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({name: F.round(name, places) for name in columns})


def _stats(rows: DataFrame) -> dict[str, tuple[float, float]]:
    return stats_map(gt.baseline_stats(rows, FEATURES), FEATURES)


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = proxy.telemetry(spark, sf_dir).withColumnRenamed("pred", "predicted_label")
    return lookup.with_class_name(rows, dims.classes(spark), "predicted_label")


# --- baseline and gate --------------------------------------------------------


def baseline_stats(spark, sf_dir):
    return rounded(gt.baseline_stats(proxy.telemetry(spark, sf_dir), FEATURES), "mean", "std")


def escalation_gate(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    return gt.gate(rows, _stats(rows), FEATURES, PROXY_Z).select("seq", "tripped", "escalate")


def escalation_gate_two_features(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    return gt.gate(rows, _stats(rows), FEATURES, 1.5, 2).select("seq", "tripped", "escalate")


def escalation_rate(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    rates = gt.escalation_rate(gt.gate(rows, _stats(rows), FEATURES))
    return rates.select(
        "Label", "escalated", "total", F.round("rate", 6).alias("rate"),
        F.concat(thousands_text("escalated"), F.lit("/"), thousands_text("total")).alias("shown"),
    )


def escalation_sql(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    sql_functions.register(spark, _stats(rows), FEATURES, PROXY_Z)
    rows.createOrReplaceTempView("perigee_windows")
    return spark.sql(
        f"SELECT seq, check_escalation({', '.join(FEATURES)}) AS escalate, "
        "fp_risk_score('Data Injection', confidence) AS risk FROM perigee_windows"
    )


def mitigation_sql(spark, sf_dir):
    """Policy, taxonomy and severity of all rows by SQL functions."""
    rows = _classified(spark, sf_dir)
    sql_functions.register(spark, _stats(proxy.telemetry(spark, sf_dir)), FEATURES)
    rows.createOrReplaceTempView("perigee_classified")
    return spark.sql(
        "SELECT seq, d.action, d.tool_function, d.guardrail_note, d.autonomous, m.tactic_id, m.technique_id, "
        "incident_severity(class_name, d.action) AS severity FROM (SELECT seq, class_name, "
        "decide_mitigation(class_name, confidence) AS d, class_mapping(class_name) AS m FROM perigee_classified)"
    )


def feature_z(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    return rounded(gt.feature_z(rows, gt.baseline_stats(rows, FEATURES), FEATURES, ["seq"]), "value", "z")


def top_drivers(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    drivers = rows.select("seq", F.posexplode(rec.top_drivers(_stats(rows), FEATURES)).alias("at", "d"))
    return drivers.select(
        "seq", (F.col("at") + 1).alias("rank"), F.col("d.feature_name").alias("feature"),
        F.round("d.z_score", 6).alias("z"),
    )


def gate_counts(spark, sf_dir):
    """Rows seen and escalated, observed while the escalated rows pass by."""
    rows = proxy.telemetry(spark, sf_dir)
    seen = Observation("gate_counts")
    escalated = gt.escalated_rows(rows, _stats(rows), FEATURES, PROXY_Z, observation=seen)
    escalated.write.format("noop").mode("overwrite").save()
    return dims.local_table(spark, {"seen": pa.int64(), "escalated": pa.int64()}, [(seen.get["seen"], seen.get["escalated"])])


def stats_files(spark, sf_dir):
    """Baseline statistics saved and loaded again."""
    path = scratch_path(spark, "stats")
    save_table(gt.baseline_stats(proxy.telemetry(spark, sf_dir), FEATURES), path, "json")
    return rounded(load_stats(spark, path, "json"), "mean", "std")


def csv_ingest(spark, sf_dir):
    """Rows written as CSV files and read again with a declared schema and their position."""
    path = scratch_path(spark, "csv")
    rows = proxy.telemetry(spark, sf_dir).orderBy("seq").select(*FEATURES, "Label")
    rows.write.option("header", True).csv(path)
    return rounded(telemetry.read_ordered_csv(spark, path, telemetry.telemetry_schema(FEATURES)), "TimeRadians")


# --- triage -------------------------------------------------------------------


def class_mapping(spark, sf_dir):
    rows = _classified(spark, sf_dir)
    mapped = lookup.with_class_mapping(rows, lookup.class_mappings(dims.knowledge(spark)))
    return mapped.select("seq", "class_name", "tactic_id", "technique_id", "mapping_error")


def policy_bands(spark, sf_dir):
    decided = lookup.with_mitigation(_classified(spark, sf_dir), dims.policy_bands(spark))
    return decided.select(
        "seq", "class_name", "confidence", "action", "tool_function", "guardrail_note", "autonomous", "policy_error"
    )


def policy_errors(spark, sf_dir):
    """Class names straight from the event type, and confidences that run below zero."""
    rows = proxy.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "view", F.lit("Data Injection")).otherwise(F.col("event_type"))
        .alias("class_name"),
        ((F.col("value") - 20.0) / 50.0).alias("confidence"),
    )
    decided = lookup.with_mitigation(rows, dims.policy_bands(spark))
    return decided.select("seq", "action", "policy_error")


def severity_fp_risk(spark, sf_dir):
    decided = lookup.with_mitigation(_classified(spark, sf_dir), dims.policy_bands(spark))
    risk = rec.false_positive_risk("class_name", "confidence")
    return decided.select(
        "seq",
        rec.severity("class_name", "action").alias("severity"),
        risk["fp_risk_score"].alias("fp_risk_score"),
        risk["risk_note"].alias("risk_note"),
    )


def triage_status(spark, sf_dir):
    """Documents as context and as report of the event with the same number."""
    texts = proxy.read(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), "text", "source")
    rows = _classified(spark, sf_dir).join(texts, "seq", "left")
    context = F.concat_ws(" ", F.col("text"), F.col("class_name"))
    report = F.concat_ws(" ", F.lit("detected"), F.when(F.col("CmdCode") < 90, F.col("class_name")))
    status = rec.triage_status("class_name", "confidence", context, F.col("source"), report)
    return rows.select("seq", status.alias("status"))


def incident_record(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    incidents = triage(
        rows.withColumnRenamed("pred", "predicted_label"), _stats(rows), FEATURES, z_threshold=PROXY_Z
    )
    return flatten_incidents(incidents)


def incident_json(spark, sf_dir):
    """Records of all rows written as JSON text and read back."""
    incidents = assemble(_classified(spark, sf_dir), _stats(proxy.telemetry(spark, sf_dir)), FEATURES, "seq", "ts",
                         dims.knowledge(spark), dims.policy_bands(spark))
    back = parse_incidents(incidents_as_json(incidents), incidents)
    return flatten_incidents(back).select(
        "seq", "incident_id", "timestamp_utc", "class_name", "severity", "recommended_action",
        "autonomous_execution", "guardrail_fired", "fp_risk_score", "review_status",
    )


def incident_files(spark, sf_dir):
    """Incident records written as JSON lines and read again."""
    rows = proxy.telemetry(spark, sf_dir).withColumnRenamed("pred", "predicted_label")
    incidents = triage(rows, _stats(rows), FEATURES, z_threshold=PROXY_Z)
    path = scratch_path(spark, "incidents")
    write_incidents(incidents, path)
    return flatten_incidents(spark.read.schema(incidents.schema).options(**JSON_OPTIONS).json(path))


def report_text(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    incidents = triage(
        rows.withColumnRenamed("pred", "predicted_label"), _stats(rows), FEATURES, z_threshold=PROXY_Z
    )
    return incidents.select("seq", "report")


def rounded_confidence(spark, sf_dir):
    """Argmax and rounding over five class scores made from each event's numbers."""
    scores = F.transform(
        F.sequence(F.lit(0), F.lit(4)),
        lambda c: ((F.col("event_id") * (c * 6 + 7) + F.col("user_id") * (c + 3)) % 101).cast("double"),
    )
    rows = proxy.read(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), scores.alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select(
        "seq",
        argmax("s").alias("predicted_label"),
        F.when(total > 0, round_exact(F.array_max("s") / total, fv.CONFIDENCE_PLACES)).alias("confidence"),
        F.when(total > 0, percent_text(round_exact(F.array_max("s") / total, 2), 0)).alias("shown"),
    )


def similar_incidents(spark, sf_dir):
    """Each vector's two nearest among those whose label marks them as incidents."""
    vectors = proxy.read(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") >= 5, "incident").otherwise("class_mapping").alias("type")
    )
    found = similarity.similar_incidents(vectors, vectors, query_id="vec_id", base_id="vec_id")
    return rounded(found, "distance")


# --- keyed refresh --------------------------------------------------------------


def _stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result per (label, user) as an earlier run left it: some good, some in ERROR."""
    rows = proxy.telemetry(spark, sf_dir).where("Label <> 4")
    return rows.groupBy("Label", "MsgId").agg(F.max("confidence").alias("confidence")).withColumn(
        "status", F.when(F.col("confidence") > 0.9, fv.STATUS_AUTONOMOUS).otherwise(fv.STATUS_ERROR)
    )


def result_refresh(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    wanted = rows.select("Label", "MsgId").distinct()

    def compute(todo: DataFrame) -> DataFrame:
        fresh = rows.join(todo, ["Label", "MsgId"], "left_semi").groupBy("Label", "MsgId").agg(
            F.min("confidence").alias("confidence")
        )
        return fresh.withColumn(
            "status", F.when(F.col("confidence") < 0.7, fv.STATUS_FLAGGED).otherwise(fv.STATUS_AUTONOMOUS)
        )

    return refresh.refresh_results(wanted, _stored_results(spark, sf_dir), compute, ["Label", "MsgId"])


def cached_lookup(spark, sf_dir):
    """Stored result of each class: one class was never stored, one has no classification."""
    rows = _classified(spark, sf_dir).where(F.col("predicted_label") != 4)
    results = rows.groupBy("class_name").agg(
        F.max("confidence").alias("confidence"), F.max("predicted_label").alias("true_label")
    ).select(
        "class_name", "confidence", "true_label",
        F.when(F.col("true_label") == 3, fv.STATUS_ERROR).otherwise(fv.STATUS_AUTONOMOUS).alias("status"),
        F.when(F.col("true_label") != 3, F.col("class_name")).alias("detected"),
    )
    return lookup.cached_results(dims.classes(spark).select("class_name"), results)


def kb_upsert(spark, sf_dir):
    """Documents replaced by a batch with several writes of one key: the last one stays."""
    documents = proxy.read(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("source").alias("type"), F.col("n_chars").alias("size")
    )
    writes = proxy.read(spark, sf_dir, "events").select(
        F.col("user_id").alias("id"), F.lit("incident").alias("type"),
        F.get_json_object("props", "$.k").cast("long").alias("size"), F.col("event_id").alias("written"),
    )
    return refresh.upsert(documents, writes, "id", "written")


# --- audits ---------------------------------------------------------------------


def label_mix(spark, sf_dir):
    return profile.label_mix(proxy.telemetry(spark, sf_dir))


def range_audit(spark, sf_dir):
    return rounded(profile.range_audit(proxy.telemetry(spark, sf_dir)), "min_value", "max_value")


def dataset_profile(spark, sf_dir):
    return profile.dataset_profile(proxy.telemetry(spark, sf_dir))


def correlation(spark, sf_dir):
    lines = proxy.read(spark, sf_dir, "lineitem").withColumn("constant", F.lit(0.5))
    names = [*proxy.LINE_FEATURES, "l_linenumber", "constant"]
    pairs = profile.correlation(lines, names)
    return rounded(profile.correlation_matrix(pairs), "r")


def class_diversity(spark, sf_dir):
    return rounded(
        profile.class_diversity(proxy.telemetry(spark, sf_dir), "MsgLength", "CmdCode"), "p25", "p50", "p75"
    )


def class_sizes(spark, sf_dir):
    """Training rows of the two classes most often confused."""
    mix = lookup.with_class_name(profile.label_mix(proxy.telemetry(spark, sf_dir)), dims.classes(spark), "Label")
    return mix.where(F.col("class_name").isin(fv.CONFUSED_CLASSES)).select("Label", "class_name", "n")


# --- evaluation -----------------------------------------------------------------


def confusion(spark, sf_dir):
    return ev.confusion(proxy.telemetry(spark, sf_dir))


def confusion_matrix(spark, sf_dir):
    counts = ev.confusion(proxy.telemetry(spark, sf_dir))
    wide = ev.confusion_matrix(counts, range(len(fv.CLASS_NAMES)))
    return wide.select("truth", *[F.col(str(c)).alias(f"predicted_{c}") for c in range(len(fv.CLASS_NAMES))])


def class_metrics(spark, sf_dir):
    metrics = ev.class_metrics(ev.confusion(proxy.telemetry(spark, sf_dir)))
    return rounded(metrics, "precision", "recall", "f1")


def macro_f1(spark, sf_dir):
    return rounded(ev.overall_metrics(ev.confusion(proxy.telemetry(spark, sf_dir))), "accuracy", "macro_f1")


def accuracy(spark, sf_dir):
    return rounded(ev.accuracy(proxy.telemetry(spark, sf_dir)), "accuracy")


def label_agreement(spark, sf_dir):
    """Two-class metrics: one rating of the labelled documents against the other."""
    counts = ev.confusion(proxy.read(spark, sf_dir, "labels"), "quality", "toxic")
    return rounded(ev.overall_metrics(counts), "accuracy", "macro_f1")


def _errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proxy.telemetry(spark, sf_dir).select(
        "seq", "Label", "pred", "CmdCode", (F.col("MsgLength") * F.col("MsgLength") / 100.0).alias("error")
    )


def threshold_percentile(spark, sf_dir):
    threshold = ev.percentile_threshold(_errors(spark, sf_dir))
    return spark.range(1).select(F.round(F.lit(threshold), 6).alias("threshold"))


def threshold_merged(spark, sf_dir):
    """The threshold from sketches of daily batches: rows sketched, and whether its exact rank is within the bound."""
    rows = _errors(spark, sf_dir).withColumn("batch", F.col("seq") % 7)
    stored = materialize(ev.threshold_sketches(rows, "batch"), "threshold-sketches")
    found = ev.merged_threshold(stored).first()
    normal = rows.where((F.col("Label") == fv.NORMAL_LABEL) & F.col("error").isNotNull())
    below, upto = (F.avg((c).cast("double")) for c in (F.col("error") < found["threshold"], F.col("error") <= found["threshold"]))
    slack = 3 / ev.SKETCH_K
    within = (below <= fv.CALIBRATION_PERCENTILE + slack) & (upto >= fv.CALIBRATION_PERCENTILE - slack)
    return normal.agg(F.lit(found["n"]).cast("long").alias("sketched"), within.alias("within_bound"))


def threshold_adaptive(spark, sf_dir):
    return rounded(ev.adaptive_threshold(_errors(spark, sf_dir)), "threshold")


def _overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _errors(spark, sf_dir)
    adaptive = float(ev.adaptive_threshold(rows).first()["threshold"])
    percentile = ev.percentile_threshold(rows)
    return rows.select(
        "seq", "Label", F.col("pred").alias("model"),
        ev.override_normal("pred", "error", percentile).alias("ensemble"),
        ev.override_normal("pred", "error", adaptive).alias("tuned_ensemble"),
    )


def ensemble_override(spark, sf_dir):
    return _overridden(spark, sf_dir)


def model_comparison(spark, sf_dir):
    compared = ev.compare_models(_overridden(spark, sf_dir), ["model", "ensemble", "tuned_ensemble"])
    return rounded(compared, "accuracy", "macro_f1")


def reconstruction_error(spark, sf_dir):
    """Squared distance of each vector to the mean vector of its label, per dimension."""
    vectors = proxy.read(spark, sf_dir, "embeddings")
    means = (
        vectors.select("label", F.posexplode("embedding").alias("at", "x"))
        .groupBy("label", "at").agg(F.avg(F.col("x").cast("double")).alias("mean"))
        # At most one row per dimension is left of each label, whatever its size.
        .groupBy("label").agg(F.array_sort(F.collect_list(F.struct("at", "mean"))).alias("m"))
        .select("label", F.transform("m", lambda s: s["mean"]).alias("rebuilt"))
    )
    # Written, the means have a known size: below Spark's bound they are sent to the vectors, which then stay where they are.
    errors = vectors.join(materialize(means, "means"), "label").select("vec_id", mean_squared_error("embedding", "rebuilt").alias("error"))
    return rounded(errors, "error")


def misclassified_drivers(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir)
    return rounded(ev.misclassified_drivers(rows, _stats(rows), FEATURES, 2, 3), "mean_abs_z")


# --- features -------------------------------------------------------------------


def scaled_features(spark, sf_dir):
    lines = proxy.read(spark, sf_dir, "lineitem")
    scaled = fx.scale(lines, fx.fit_scaler(lines, proxy.LINE_FEATURES), proxy.LINE_FEATURES,
                      ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"])
    return rounded(scaled, *proxy.LINE_FEATURES)


def cyclic_time(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir).select("seq", "TimeRadians")
    return rounded(fx.cyclic_time(rows), "Time_Sin", "Time_Cos")


def contract_split(spark, sf_dir):
    """Text values that are not all numbers, and class names that are not all classes."""
    rows = proxy.read(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").alias("CmdCode"),
        F.when(F.col("event_type") == "purchase", F.col("event_type")).otherwise(F.col("value").cast("string"))
        .alias("MsgLength"),
        F.when(F.col("event_type") == "error", F.lit("Normal")).when(F.col("event_type") == "view",
                                                                     F.lit("Data Injection"))
        .otherwise(F.col("event_type")).alias("class_name"),
    )
    return fx.contract_split(rows, ["CmdCode", "MsgLength"], dims.classes(spark)).select("seq", "contract_error")


def shared_features(spark, sf_dir):
    """Ordered projection of the noised rows onto what both splits have."""
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    names = fx.shared_features(raw, noised, drop=("Label", "seq"))
    return rounded(fx.project(noised, names, ["seq"]), *names)


def split_union(spark, sf_dir):
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    stacked = fx.as_label(fx.stack_splits(raw, noised), "Label", text=True)
    return rounded(stacked.select("seq", "split", "Label", "CmdCode", "CommandErrorCounter"), "CmdCode")


# --- order and sequences ----------------------------------------------------------


def sequences_labelled(spark, sf_dir):
    rows = order.with_dense_index(proxy.telemetry(spark, sf_dir).select("seq", "Label", "MsgLength"), ["seq"])
    built = sequences.labelled_sequences(rows, ["MsgLength"], "idx")
    return built.select(
        "idx", "Label", *[F.col("steps")[i][0].alias(f"t{i}") for i in range(fv.SEQUENCE_LENGTH)]
    )


def sequences_unlabelled(spark, sf_dir):
    rows = order.with_dense_index(proxy.telemetry(spark, sf_dir).select("seq", "CmdCode", "MsgLength"), ["seq"])
    built = sequences.sequences(rows, ["CmdCode", "MsgLength"], "idx")
    columns = [
        F.col("steps")[i][j].alias(f"{name}{i}") for i in range(fv.SEQUENCE_LENGTH) for j, name in enumerate("cm")
    ]
    return built.select("idx", *columns)


def straddling_sequences(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir).select("seq", "Label", "pred")
    marked = sequences.straddling(order.with_dense_index(rows, ["seq"]), "idx", carry=["pred"], length=3)
    return marked.groupBy("straddles").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col("Label") != F.col("pred")).cast("double")), 6).alias("error_rate"),
    )


def representative_row(spark, sf_dir):
    return order.representative_rows(proxy.telemetry(spark, sf_dir).select("seq", "Label", "CmdCode", "MsgLength"))


def last_n(spark, sf_dir):
    return order.last_rows(proxy.telemetry(spark, sf_dir).select("seq", "Label", "MsgLength"), 200)


def newest_first(spark, sf_dir):
    return order.newest_first(proxy.telemetry(spark, sf_dir).select("seq", "Label", "MsgLength"))


def first_rows(spark, sf_dir):
    return order.first_rows(proxy.telemetry(spark, sf_dir).select("seq", "Label", "MsgLength"), 8)


def metric_history(spark, sf_dir):
    return order.metric_history(proxy.telemetry(spark, sf_dir), ["MsgLength", "CmdCode", "MemoryAnonMB"])


def replay_shuffled(spark, sf_dir):
    rows = proxy.telemetry(spark, sf_dir).select("seq", "Label")
    return order.replay_order(rows, "shuffled")


def replay_sequential(spark, sf_dir):
    """All lines in the order of their keys; ties in the key are settled by the other columns."""
    lines = proxy.read(spark, sf_dir, "lineitem").select(LINE_ORDER)
    return order.replay_order(lines, "sequential", LINE_ORDER)


# --- models ---------------------------------------------------------------------


_SAVED_MODELS: dict[tuple[str, str, str], str] = {}


def _classifier(spark: SparkSession, sf_dir: str, train=models.train_classifier) -> PipelineModel:
    """The classifier of the raw split: trained and saved once per application, loaded by every user."""
    at = (spark.sparkContext.applicationId, sf_dir, train.__name__)
    if at not in _SAVED_MODELS:
        raw, _ = proxy.splits(proxy.telemetry(spark, sf_dir))
        # Kept for the whole application: not among the scratch folders that a query's end removes.
        path = f"{scratch_root(spark)}/classifier-{uuid.uuid4().hex}"
        save_model(train(raw, FEATURES), path)
        _SAVED_MODELS[at] = path
    return load_model(_SAVED_MODELS[at])


def train_score(spark, sf_dir):
    """Trained on raw, scored on noised; the share of hits is left to ``cross_domain_metrics``."""
    _, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    return models.score(noised, _classifier(spark, sf_dir), dims.classes(spark)).select(
        "seq", "Label", "predicted_label", "class_name", "confidence"
    )


def cross_domain_metrics(spark, sf_dir):
    scored = train_score(spark, sf_dir)
    return ev.overall_metrics(ev.confusion(scored, "Label", "predicted_label"))


def importance(spark, sf_dir):
    return models.feature_importance(spark, _classifier(spark, sf_dir), FEATURES)


def importance_permuted(spark, sf_dir):
    """What each feature is worth to the model on rows that it was not trained on."""
    _, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    return models.permutation_importance(noised, _classifier(spark, sf_dir), FEATURES)


def permuted_features(spark, sf_dir):
    """What any permutation keeps: all rows, and the sum of the permuted feature."""
    _, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    copies = models.permuted(noised.select("seq", *FEATURES), FEATURES).where("permuted IS NOT NULL")
    value = F.coalesce(*[F.when(F.col("permuted") == name, F.col(name).cast("double")) for name in FEATURES])
    found = copies.groupBy(F.col("permuted").alias("feature")).agg(F.count("*").alias("rows"), F.sum(value).alias("total"))
    return rounded(found, "total", places=3)


def importance_sum(spark, sf_dir):
    """What holds for the importances of any forest: one per feature, none negative, 1 in all."""
    return importance(spark, sf_dir).agg(
        F.count("*").alias("features"), F.round(F.sum("importance"), 6).alias("total"),
        F.min(F.col("importance") >= 0).alias("none_negative"),
    )


def model_predictions(spark, sf_dir):
    """What holds for any trained model: each row scored once, with a known class and a possible confidence."""
    scored = train_score(spark, sf_dir)
    return scored.select(
        "seq", "Label", F.col("predicted_label").between(0, 4).alias("known"),
        F.col("confidence").between(0.2, 1.0).alias("possible"), F.col("class_name").isNotNull().alias("named"),
    )


def _boosted(raw: DataFrame, names: list[str]) -> PipelineModel:
    """Fewer rounds than the default: each is a few small jobs per class."""
    return boosting.train_boosted(raw, names, rounds=6, depth=4)


def boosted_score(spark, sf_dir):
    """Boosted trees trained on raw, scored on noised."""
    _, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    return models.score(noised, _classifier(spark, sf_dir, _boosted), dims.classes(spark)).select(
        "seq", "Label", "predicted_label", "class_name", "confidence"
    )


def boosted_predictions(spark, sf_dir):
    """What holds for boosted predictions: each row scored once, a known class, a possible confidence, and the band it falls into."""
    scored = boosted_score(spark, sf_dir)
    decided = lookup.with_mitigation(scored, dims.policy_bands(spark))
    return decided.select(
        "seq", "Label", F.col("predicted_label").between(0, 4).alias("known"),
        F.col("confidence").between(0.2, 1.0).alias("possible"),
        (F.col("action").isNotNull() & F.col("tool_function").isNotNull()).alias("decided"),
    )


def boosted_comparison(spark, sf_dir):
    """Accuracy and macro F1 on the noised split, of the forest and of the boosted trees."""
    forest = train_score(spark, sf_dir).select("seq", "Label", F.col("predicted_label").alias("forest"))
    boosted = boosted_score(spark, sf_dir).select("seq", F.col("predicted_label").alias("boosted"))
    return ev.compare_models(materialize(forest.join(boosted, "seq"), "compared"), ["forest", "boosted"], "Label")


def metrics_agree(spark, sf_dir):
    """The metrics of both models on the noised split, computed by operators and by plain SQL over the written predictions."""
    forest = train_score(spark, sf_dir).select("seq", "Label", F.col("predicted_label").alias("forest"))
    boosted = boosted_score(spark, sf_dir).select("seq", F.col("predicted_label").alias("boosted"))
    written = materialize(forest.join(boosted, "seq"), "predictions")
    found = ev.compare_models(written, ["forest", "boosted"], "Label").select("model", "accuracy", "macro_f1")
    by_sql = spark.sql(
        """WITH p AS (SELECT 'forest' AS model, Label, forest AS pred FROM {written} UNION ALL SELECT 'boosted', Label, boosted FROM {written}),
        classes AS (SELECT model, Label AS c FROM p UNION SELECT model, pred FROM p),
        f1 AS (SELECT classes.model, c, 2 * count_if(Label = c AND pred = c) / (count_if(Label = c) + count_if(pred = c)) AS f1
            FROM classes JOIN p ON p.model = classes.model GROUP BY classes.model, c)
        SELECT p.model, count(*) AS rows, avg(CASE WHEN Label = pred THEN 1D ELSE 0D END) AS accuracy, first(m.f1) AS macro_f1
        FROM p JOIN (SELECT model, avg(f1) AS f1 FROM f1 GROUP BY model) m ON m.model = p.model GROUP BY p.model""", written=written,
    )
    joined = found.alias("a").join(by_sql.alias("b"), "model")
    near = [F.abs(F.col(f"a.{name}") - F.col(f"b.{name}")) < 1e-9 for name in ("accuracy", "macro_f1")]
    return joined.select("model", "rows", near[0].alias("accuracy_agrees"), near[1].alias("macro_f1_agrees"))


def sequence_predictions(spark, sf_dir):
    """What holds for any sequence model: one known class for each sequence that has a next row, in its order."""
    scored = sequence_model(spark, sf_dir)
    return scored.select("seq", "Label", F.col("sequence_pred").between(0, 4).alias("known"))


def anomaly_two_features(spark, sf_dir):
    """Reconstruction error over two features and one axis, which has a closed form."""
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    names = ["CmdCode", "MsgLength"]
    errors = models.train_anomaly(raw, names, components=1).error(noised)
    return rounded(errors.select("seq", "error"), "error")


def anomaly_score(spark, sf_dir):
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    return models.train_anomaly(raw, FEATURES, components=2).error(noised).select("seq", "Label", "error")


def autoencoder_errors(spark, sf_dir):
    """What holds for the non-linear model: an error for each row, and on Normal rows no more of it than the linear model leaves."""
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    model = autoencoder.train_autoencoder(raw, FEATURES, components=2, rounds=30)
    both = materialize(model.error(model.linear.error(raw, "linear")).select("Label", "linear", "error"), "both-errors")
    scored = materialize(model.error(noised).select("seq", "error"), "noised-errors")
    normal = both.where(F.col("Label") == fv.NORMAL_LABEL).agg((F.avg("error") <= F.avg("linear") * (1 + 1e-9)).alias("no_worse")).first()
    return scored.agg(
        F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("error") >= 0, 1)).alias("errors"), F.lit(normal["no_worse"]).alias("no_worse")
    )


def _ordered_splits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both splits with ``seq`` made dense, as sequences need it."""
    rows = proxy.telemetry(spark, sf_dir).select("seq", *FEATURES, "Label")
    dense = order.with_dense_index(rows, ["seq"]).drop("seq").withColumnRenamed("idx", "seq")
    return proxy.splits(dense)


def sequence_model(spark, sf_dir):
    raw, noised = _ordered_splits(spark, sf_dir)
    scaler = training.fitted_scaler(raw, FEATURES)
    built = training.scaled_sequences(scaler, raw, FEATURES)
    network = models.train_sequence_classifier(built, fv.SEQUENCE_LENGTH, len(FEATURES), len(fv.CLASS_NAMES))
    return models.score_sequences(training.scaled_sequences(scaler, noised, FEATURES), network)


def offline_evaluation(spark, sf_dir):
    raw, noised = _ordered_splits(spark, sf_dir)
    return training.evaluate(raw, noised, FEATURES, components=2).comparison


def model_triage(spark, sf_dir):
    """The triage plan with the trained model in place of a given prediction."""
    rows = proxy.telemetry(spark, sf_dir)
    windows = rows.select("seq", "ts", "Label", *FEATURES)
    return flatten_incidents(triage(windows, _stats(rows), FEATURES, _classifier(spark, sf_dir), z_threshold=PROXY_Z))


# --- streams ----------------------------------------------------------------------


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = proxy.read(spark, sf_dir, "events").schema
    return proxy.as_telemetry(live.read_stream(spark, sf_dir, schema, "events.parquet"))


def _finish(query) -> None:
    """Waits for a query that works off what is there."""
    query.awaitTermination()


def stream_gate(spark, sf_dir):
    stats = _stats(proxy.telemetry(spark, sf_dir))
    rows = gt.gate(_event_stream(spark, sf_dir), stats, FEATURES, PROXY_Z).select("seq", "tripped", "escalate")
    path = scratch_path(spark, "stream-gate")
    _finish(live.write_stream(rows, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def stream_triage(spark, sf_dir):
    stats = _stats(proxy.telemetry(spark, sf_dir))
    rows = _event_stream(spark, sf_dir).withColumnRenamed("pred", "predicted_label")
    incidents = flatten_incidents(triage(rows, stats, FEATURES, z_threshold=PROXY_Z))
    path = scratch_path(spark, "stream-triage")
    _finish(live.write_stream(incidents, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(incidents.schema).parquet(f"{path}/rows")


def stream_counters(spark, sf_dir):
    stats = _stats(proxy.telemetry(spark, sf_dir))
    path = scratch_path(spark, "stream-counters")
    _finish(live.start_counters(
        _event_stream(spark, sf_dir), stats, FEATURES, f"{path}/rows", f"{path}/checkpoint", PROXY_Z
    ))
    return live.Versions(f"{path}/rows").read(spark, "counters")


def _live(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    stream = _event_stream(spark, sf_dir).select("seq", "Label", "CmdCode", "MsgLength")
    path = scratch_path(spark, "stream-live")
    view = live.LiveView(f"{path}/view", stream.schema, 200, ["MsgLength", "CmdCode"])
    _finish(view.start(stream, f"{path}/checkpoint"))
    return view.read(spark, table)


def stream_last_n(spark, sf_dir):
    return _live(spark, sf_dir, "buffer")


def stream_label_mix(spark, sf_dir):
    return _live(spark, sf_dir, "label_mix")


def stream_metric_history(spark, sf_dir):
    return _live(spark, sf_dir, "history")


# --- quarantine, precedents, width -------------------------------------------------


def _with_broken_rows(rows: DataFrame) -> DataFrame:
    """Some windows lose a feature, some carry text in one."""
    return rows.withColumns({
        "MsgLength": F.when(F.col("seq") % 17 == 3, F.lit("n/a")).otherwise(F.col("MsgLength").cast("string")),
        "CmdCode": F.when(F.col("seq") % 29 != 5, F.col("CmdCode")),
    }).withColumnRenamed("pred", "predicted_label")


def _quarantine_rows(checked: DataFrame) -> DataFrame:
    return checked.select(
        "seq", "status", "reason", F.col("record.incident_id").alias("incident_id"),
        F.col("record.mitigation.recommended_action").alias("recommended_action"),
    )


def triage_quarantine(spark, sf_dir):
    """Incidents, and the windows that break the input contract with their reason."""
    rows = proxy.telemetry(spark, sf_dir)
    return _quarantine_rows(triage_or_quarantine(_with_broken_rows(rows), _stats(rows), FEATURES, z_threshold=PROXY_Z))


def quarantine_counts(spark, sf_dir):
    """Rows seen are escalated, skipped or quarantined, none is lost."""
    rows = proxy.telemetry(spark, sf_dir)
    seen = Observation("quarantine_counts")
    checked = triage_or_quarantine(_with_broken_rows(rows), _stats(rows), FEATURES, z_threshold=PROXY_Z, observation=seen)
    checked.write.format("noop").mode("overwrite").save()
    names = ("seen", "escalated", "skipped", "quarantined")
    return dims.local_table(spark, dict.fromkeys(names, pa.int64()), [tuple(seen.get[name] for name in names)])


def stream_quarantine(spark, sf_dir):
    stats = _stats(proxy.telemetry(spark, sf_dir))
    checked = triage_or_quarantine(_with_broken_rows(_event_stream(spark, sf_dir)), stats, FEATURES, z_threshold=PROXY_Z)
    rows, path = _quarantine_rows(checked), scratch_path(spark, "stream-quarantine")
    _finish(live.write_stream(rows, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def incident_precedent(spark, sf_dir):
    """Each incident with the nearest stored incident; incidents beyond the last vector have none."""
    rows = proxy.telemetry(spark, sf_dir).withColumnRenamed("pred", "predicted_label")
    vectors = proxy.read(spark, sf_dir, "embeddings")
    stored = vectors.where("label >= 5").select(F.col("vec_id").alias("id"), F.lit("incident").alias("type"), "embedding")
    found = with_precedent(
        triage(rows, _stats(rows), FEATURES, z_threshold=PROXY_Z), vectors.select(F.col("vec_id").alias("seq"), "embedding"), stored
    )
    return found.select("seq", F.col("precedent.id").alias("precedent_id"), F.round("precedent.distance", 6).alias("distance"))


def similar_by_blocks(spark, sf_dir):
    """As ``similar_incidents``, in a grid of small blocks."""
    vectors = proxy.read(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") >= 5, "incident").otherwise("class_mapping").alias("type")
    )
    found = similarity.similar_incidents(
        vectors, vectors, query_id="vec_id", base_id="vec_id", broadcast_rows=0, block_values=64 * 200
    )
    return rounded(found, "distance")


def record_sql(spark, sf_dir):
    """From the gate to the incident record in one SQL statement."""
    rows = _classified(spark, sf_dir)
    stats = _stats(proxy.telemetry(spark, sf_dir))
    sql_functions.register(spark, stats, FEATURES, PROXY_Z)
    sql_tools.register_record(spark, stats, FEATURES)
    rows.createOrReplaceTempView("perigee_rows")
    names = ", ".join(FEATURES)
    return spark.sql(
        "SELECT seq, r.incident_id, r.classification.class_name, r.classification.confidence, r.classification.severity, r.sparta_context.tactic_id, "
        "r.sparta_context.technique_id, r.mitigation.recommended_action, r.mitigation.autonomous_execution, r.mitigation.guardrail_fired, "
        "r.false_positive_risk.fp_risk_score, r.false_positive_risk.risk_note, element_at(r.shap_drivers, 1).feature_name AS top_feature "
        f"FROM (SELECT seq, assemble_record(seq, ts, predicted_label, class_name, confidence, {names}) AS r "
        f"FROM perigee_rows WHERE check_escalation({names}))"
    )


def classify_sql(spark, sf_dir):
    """The forest as an SQL function: label and confidence of every row, and whether they are those of the scoring plan."""
    _, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    model = _classifier(spark, sf_dir)
    sql_tools.register_classifier(spark, model, FEATURES)
    models.score(noised, model).createOrReplaceTempView("perigee_scored")
    return spark.sql(
        "SELECT seq, Label, c.predicted_label = predicted_label AS same_label, c.confidence = confidence AS same_confidence "
        f"FROM (SELECT *, classify({', '.join(FEATURES)}) AS c FROM perigee_scored)"
    )


def search_sql(spark, sf_dir):
    """The incidents nearest to the first vector, by an SQL table function over all vectors."""
    vectors = proxy.read(spark, sf_dir, "embeddings")
    sql_tools.register_search(spark, vectors.where("label >= 5"), base_id="vec_id", doc_type=None, k=20)
    asked = vectors.orderBy("vec_id").select(F.col("embedding").cast("array<double>").alias("v")).first()["v"]
    found = spark.sql(f"SELECT * FROM search_incidents(array({', '.join(f'{x!r}D' for x in asked)}))")
    return rounded(found, "distance")


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and what the index finds for each of them among the incidents."""
    vectors = proxy.read(spark, sf_dir, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("label") >= 5, "incident").otherwise("class_mapping").alias("type")
    )
    index = similarity_index.build_index(vectors, base_id="vec_id")
    return vectors, similarity_index.search_index(index, vectors, query_id="vec_id")


def similar_by_index(spark, sf_dir):
    """As ``similar_incidents``, by the index: nearly all of its rows, with exact distances."""
    return rounded(_indexed(spark, sf_dir)[1], "distance")


def index_recall(spark, sf_dir):
    """What holds for any index: rows for every query, and nine tenths of what the exact search finds, or more."""
    vectors, found = _indexed(spark, sf_dir)
    found = materialize(found, "by-index")
    exact = similarity.similar_incidents(vectors, vectors, query_id="vec_id", base_id="vec_id", keep_unmatched=False)
    recall = similarity_index.measured_recall(found, exact, "vec_id")
    return found.agg(
        F.countDistinct("vec_id").alias("queries"), F.count(F.lit(1)).alias("rows"), F.lit(recall >= 0.9).alias("recall_reached")
    )


def wide_baseline(spark, sf_dir):
    """Baseline of all 22 features over order lines."""
    return rounded(gt.baseline_stats(proxy.wide(spark, sf_dir), fv.FEATURES), "mean", "std")


def wide_gate(spark, sf_dir):
    """Escalations per label with all 22 features, and the feature that deviates most."""
    rows = proxy.wide(spark, sf_dir)
    stats = stats_map(gt.baseline_stats(rows, fv.FEATURES), fv.FEATURES)
    gated = gt.gate(rows, stats, fv.FEATURES, 2.0, 2)
    return gated.groupBy("Label").agg(
        F.count("*").alias("total"), F.sum(F.col("escalate").cast("long")).alias("escalated"), F.sum("tripped").alias("tripped")
    )


# --- files, manifests, projections -------------------------------------------------


def discovered_files(spark, sf_dir):
    """Both splits written under names as the data sets have, found again by role, and counted."""
    root = scratch_path(spark, "files")
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    raw.write.option("header", True).csv(f"{root}/consolidated_dataset_raw.csv")
    noised.write.option("header", True).csv(f"{root}/noised_dataset.csv")
    found = {row["role"]: row["path"] for row in telemetry.discover(spark, root).collect()}
    counts = [
        spark.read.option("header", True).csv(found[role]).agg(F.lit(role).alias("role"), F.count("*").alias("rows"))
        for role in ("raw", "noised")
    ]
    return counts[0].unionByName(counts[1])


def manifest_files(spark, sf_dir):
    """The feature order saved, loaded, and used to project the rows strictly."""
    path = scratch_path(spark, "manifest")
    save_table(manifest(spark, FEATURES[::-1]), path)
    names = load_manifest(spark, path)
    return rounded(fx.project(proxy.telemetry(spark, sf_dir), names, ["seq"]), *names)


def noised_features(spark, sf_dir):
    """Columns that only the noised split offers, in manifest order: projection that tolerates absent ones."""
    raw, noised = proxy.splits(proxy.telemetry(spark, sf_dir))
    names = fx.noised_features(noised, drop=("Label", "seq"))
    wanted = [*names, "CommandErrorCounter"]
    return rounded(fx.project(noised, wanted, ["seq"], strict=False), *names)


def table_versions(spark, sf_dir):
    """A table saved as versions: the greatest one is read, also if it is empty; one whose writing did not end is not."""
    path = scratch_path(spark, "versions")
    mix = profile.label_mix(proxy.telemetry(spark, sf_dir))
    refresh.save_version(mix, path, 1)
    refresh.save_version(mix.where("Label > 99"), path, 2)
    empty = refresh.load_version(spark, path)
    refresh.save_version(mix.where("Label <> 4"), path, 3)
    mix.write.parquet(f"{path}/version=4")
    return refresh.load_version(spark, path).unionAll(empty)


def results_by_key(spark, sf_dir):
    """Results stored by key; a second run replaces the keys it brings and keeps the others."""
    path = scratch_path(spark, "results")
    first = _stored_results(spark, sf_dir)
    refresh.save_by_key(first, path, ["Label", "MsgId"], 8)
    again = first.where("Label = 1").withColumn("status", F.lit(fv.STATUS_FLAGGED))
    refresh.save_by_key(again, path, ["Label", "MsgId"], 8)
    return refresh.load_results(spark, path)


# --- event time, keyed state, malformed input ----------------------------------------


def _wall_clock(moment: str):
    return F.date_format(F.col(moment).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")


def _deliveries(spark: SparkSession, parts: list[DataFrame], name: str) -> DataFrame:
    """Events as a stream that gets each part in a batch of its own, in their order."""
    path = scratch_path(spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(path)
    return proxy.as_telemetry(live.read_stream(spark, path, parts[0].schema, files_per_batch=1))


def _append(spark: SparkSession, rows: DataFrame, name: str) -> DataFrame:
    path = scratch_path(spark, name)
    _finish(live.write_stream(rows, f"{path}/rows", f"{path}/checkpoint"))
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def _traffic(rows: DataFrame) -> DataFrame:
    features = event_time.window_features(rows, key="CmdCode", message="MsgId", size="6 hours", slide="3 hours")
    names = [name for name in features.columns if name.endswith("InWindow")]
    # All intervals of a window together are whole microseconds, which rounding cannot split differently in two engines.
    intervals = F.round(F.col("SlidingWindowMeanIntervalSec") * (F.col("MessageCountInWindow") - 1), 6).alias("IntervalsSec")
    return rounded(features.select(
        _wall_clock("window_start").alias("window_start"), _wall_clock("window_end").alias("window_end"), "CmdCode", *names, intervals
    ), "FlowLengthInWindow", "AverageMessageLengthInWindow", "MessageRateInWindow", "StdDevMessageLengthInWindow", places=4)


def traffic_windows(spark, sf_dir):
    """Traffic features in sliding windows of a table."""
    return _traffic(event_time.in_time(proxy.telemetry(spark, sf_dir)))


def stream_traffic_windows(spark, sf_dir):
    """The same on a stream that delivers everything twice: windows that the watermark has closed, each once."""
    events = proxy.read(spark, sf_dir, "events")
    rows = event_time.in_time(_deliveries(spark, [events, events], "twice"))
    return _append(spark, _traffic(rows), "stream-traffic")


def stream_sessions(spark, sf_dir):
    """Bursts of a user's events on a stream."""
    rows = event_time.in_time(_event_stream(spark, sf_dir))
    found = event_time.sessions(rows, key="MsgId", gap="30 minutes")
    return _append(spark, rounded(found.select(
        _wall_clock("session_start").alias("session_start"), _wall_clock("session_end").alias("session_end"), "MsgId", "n", "total"
    ), "total", places=4), "stream-sessions")


def stream_accounts(spark, sf_dir):
    """The later half of all events twice, then the earlier half, then all again: rows are used, late or repeated, none is lost."""
    events = proxy.read(spark, sf_dir, "events")
    middle = events.agg(F.max("event_id")).first()[0] // 2
    later = events.where(F.col("event_id") > middle)
    parts = [later, later, events.where(F.col("event_id") <= middle), events]
    rows = event_time.in_time(_deliveries(spark, parts, "late"), delay="10 days")
    path = scratch_path(spark, "stream-accounts")
    query = live.write_stream(rows.select("seq"), f"{path}/rows", f"{path}/checkpoint")
    _finish(query)
    found = event_time.accounts(query)
    kept = spark.read.schema("seq long").parquet(f"{path}/rows")
    return kept.agg(F.count("*").alias("kept"), F.count_distinct("seq").alias("different")).select(
        F.lit(found.seen).cast("long").alias("seen"), F.lit(found.late + found.repeated).cast("long").alias("turned_away"),
        (F.lit(found.used) == F.col("kept")).alias("agrees"), "kept", "different",
    )


def stream_triage_once(spark, sf_dir):
    """Incidents of a stream that delivers every row twice: each incident once."""
    events = proxy.read(spark, sf_dir, "events")
    stats = _stats(proxy.telemetry(spark, sf_dir))
    rows = event_time.in_time(_deliveries(spark, [events, events], "again")).withColumnRenamed("pred", "predicted_label")
    return _append(spark, flatten_incidents(triage(rows, stats, FEATURES, z_threshold=PROXY_Z)), "stream-once")


def stream_last_n_by_key(spark, sf_dir):
    """The newest three events of each code, held in keyed state over several batches."""
    events = proxy.read(spark, sf_dir, "events")
    stream = _deliveries(spark, [events.where(F.col("event_id") % 3 == i) for i in range(3)], "by-key")
    path = scratch_path(spark, "stream-by-key")
    _finish(keyed.start_latest(stream, "CmdCode", ["seq", "MsgId", "Label"], 3, f"{path}/rows", f"{path}/checkpoint"))
    return keyed.newest(spark, f"{path}/rows", "CmdCode").select("CmdCode", "seq", "MsgId", "Label")


def csv_quarantine(spark, sf_dir):
    """Telemetry lines of which some are cut short and some hold a word for a number: each is good, or set apart with its text."""
    rows = proxy.telemetry(spark, sf_dir)
    schema = telemetry.telemetry_schema(["MsgId", "CmdCode"], with_seq=True)
    whole = F.concat_ws(",", "seq", F.col("MsgId").cast("long"), F.col("CmdCode").cast("long"), "Label")
    line = F.when(F.col("seq") % 13 == 4, F.concat_ws(",", "seq", F.col("MsgId").cast("long"))).when(
        F.col("seq") % 19 == 6, F.concat_ws(",", "seq", F.lit("n/a"), F.col("CmdCode").cast("long"), "Label")
    ).otherwise(whole)
    path = scratch_path(spark, "lines")
    rows.select(line.alias("seq,MsgId,CmdCode,Label")).write.option("header", True).option("sep", "\u0001").csv(path)
    checked = telemetry.read_csv_checked(spark, path, schema)
    good = telemetry.good_rows(checked).select(F.col("seq").cast("string").alias("line"), "MsgId", "CmdCode", "Label", F.lit(None).cast("string").alias("reason"))
    bad = telemetry.malformed_rows(checked).select(F.col("raw_line").alias("line"), F.col("malformed_reason").alias("reason"))
    return good.unionByName(bad, allowMissingColumns=True)


def incident_inputs(spark, sf_dir):
    """Inputs of the incident record under their contract: some lack a field, carry a word for a number or name no class."""
    with_class = lookup.with_class_name(proxy.telemetry(spark, sf_dir), dims.classes(spark), "pred")
    decided = lookup.with_mitigation(with_class, dims.policy_bands(spark))
    seq = F.col("seq")
    given = decided.select(
        "seq", F.when(seq % 23 == 2, F.lit("Solar Flare")).otherwise(F.col("class_name")).alias("class_name"),
        F.when(seq % 17 == 3, F.lit("high")).when(seq % 31 == 4, F.lit("1.5")).otherwise(F.col("confidence").cast("string")).alias("confidence"),
        F.lit("T").alias("tactic_id"), F.lit("t").alias("technique_id"), "action", "tool_function", "guardrail_note",
        F.when(seq % 29 != 5, F.col("autonomous")).alias("autonomous"),
    )
    checked = fx.incident_contract(given, dims.classes(spark))
    ready = fx.valid_incidents(checked).select("seq", F.col("confidence").alias("typed_confidence"))
    return checked.join(ready, "seq", "left").select("seq", "contract_error", "typed_confidence")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in [
        baseline_stats, escalation_gate, escalation_gate_two_features, escalation_rate, escalation_sql, mitigation_sql, feature_z,
        gate_counts, stats_files, csv_ingest, incident_files,
        top_drivers, class_mapping, policy_bands, policy_errors, severity_fp_risk, triage_status, incident_record,
        incident_json, report_text, rounded_confidence, similar_incidents, result_refresh, cached_lookup, kb_upsert,
        label_mix, range_audit, dataset_profile, correlation, class_diversity, class_sizes, confusion,
        confusion_matrix, class_metrics, macro_f1, accuracy, label_agreement, threshold_percentile,
        threshold_adaptive, ensemble_override, model_comparison, reconstruction_error, misclassified_drivers,
        scaled_features, cyclic_time, contract_split, shared_features, split_union, sequences_labelled,
        sequences_unlabelled, straddling_sequences, representative_row, last_n, newest_first, first_rows,
        metric_history, replay_shuffled, replay_sequential, train_score, cross_domain_metrics, importance,
        anomaly_score, sequence_model, offline_evaluation, model_triage, stream_gate, stream_triage,
        stream_counters, stream_last_n, stream_label_mix, stream_metric_history,
        importance_sum, model_predictions, anomaly_two_features, triage_quarantine, quarantine_counts, stream_quarantine,
        incident_precedent, similar_by_blocks, wide_baseline, wide_gate, discovered_files, manifest_files, noised_features,
        table_versions, results_by_key, boosted_score, boosted_predictions, boosted_comparison, metrics_agree, sequence_predictions,
        traffic_windows, stream_traffic_windows, stream_sessions, stream_accounts, stream_triage_once, stream_last_n_by_key, csv_quarantine,
        incident_inputs, threshold_merged, importance_permuted, permuted_features,
        similar_by_index, index_recall, autoencoder_errors, record_sql, classify_sql, search_sql,
    ]
}
