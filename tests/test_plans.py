"""Shapes of physical plans that must hold at any size."""

import re

import pytest
from pyspark.sql import functions as F

from perigee.operators import evaluate as ev
from perigee.operators import gate as gt
from perigee.operators import lookup, order, sequences
from perigee.plans.catalog import FEATURES
from perigee.plans.triage import triage
from perigee.sources import dims, proxy

SF = "/root/testdata/sf0.001"
STATS = {name: (0.0, 1.0) for name in FEATURES}


@pytest.fixture
def rows(spark):
    return proxy.telemetry(spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_triage_shuffles_no_rows(spark, rows):
    text = plan(triage(rows.withColumnRenamed("pred", "predicted_label"), STATS, FEATURES))
    assert "SortMergeJoin" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    # The only exchange by hash belongs to the five taxonomy rows.
    assert re.findall(r"Exchange hashpartitioning\((\w+)", text) == ["class_name"]
    assert "SinglePartition" not in text


def test_gate_runs_before_the_joins_and_reads_needed_columns_only(spark, rows):
    text = plan(gt.escalated_rows(rows, STATS, FEATURES).select("seq"))
    assert "Exchange" not in text and "event_type" not in text.split("ReadSchema")[1]


def test_policy_is_a_hash_join(spark, rows):
    df = lookup.with_class_name(rows, dims.classes(spark), "pred")
    text = plan(lookup.with_mitigation(df, dims.policy_bands(spark)))
    assert text.count("BroadcastHashJoin") == 2 and "NestedLoop" not in text


def test_sequences_have_no_global_window(rows):
    text = plan(sequences.labelled_sequences(rows, ["MsgLength"]))
    assert "SinglePartition" not in text and "hashpartitioning(_bucket" in text


def test_dense_index_meets_only_partition_sizes_in_one_task(rows):
    text = plan(order.with_dense_index(rows.select("seq"), ["seq"]))
    above_single = text[text.index("SinglePartition"):]
    assert "hashpartitioning(_part" in above_single


def test_tails_are_taken_per_task(rows):
    assert "TakeOrderedAndProject" in plan(order.last_rows(rows, 20))


def test_confusion_counts_before_the_shuffle(rows):
    text = plan(ev.confusion(rows))
    assert text.index("Exchange hashpartitioning") < text.index("partial_count")


def test_normal_filter_reaches_the_scan(spark, tmp_path):
    spark.range(10).select((F.col("id") % 5).cast("int").alias("Label"), F.rand().alias("x"), F.rand().alias("y")) \
        .write.parquet(str(tmp_path / "t"))
    text = plan(gt.baseline_stats(spark.read.parquet(str(tmp_path / "t")), ["x"]))
    assert "EqualTo(Label,0)" in text and "y:double" not in text
