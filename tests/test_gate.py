import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Observation
from pyspark.sql import functions as F

from perigee import fixed_values as fv
from perigee.functions import sql as sql_functions
from perigee.operators import gate as gt
from perigee.sources import dims
from perigee.sources.artifacts import stats_map

STATS = {"a": (10.0, 2.0), "b": (0.0, 0.0), "c": (1.0, 1.0)}
NAMES = ["a", "b", "c"]


def escalations(df, **kwargs):
    return [r.escalate for r in gt.gate(df, STATS, NAMES, **kwargs).orderBy("i").collect()]


def windows(table, *rows):
    return table("i int, a double, b double, c double", [(i, *row) for i, row in enumerate(rows)])


def test_edge_rows(table):
    df = windows(
        table,
        (20.0, 0.0, 1.0),                # exactly five deviations
        (20.000001, 0.0, 1.0),           # just above
        (10.0, 1e9, 1.0),                # flat feature far off
        (math.nan, math.nan, math.nan),  # nothing measured
        (None, None, None),
        (-0.1, 0.0, 1.0),                # below the mean
        (math.inf, 0.0, 1.0),
    )
    assert escalations(df) == [False, True, False, False, False, True, True]
    assert escalations(df, min_features=2) == [False] * 7


def test_two_features(table):
    df = windows(table, (30.0, 0.0, 9.0), (30.0, 0.0, 1.0))
    assert escalations(df, min_features=2) == [True, False]


def test_zero_minimum_lets_all_through(table):
    assert escalations(windows(table, (10.0, 0.0, 1.0)), min_features=0) == [True]


def test_baseline_uses_sample_deviation_of_normal_rows(table):
    df = table("x double, y double, Label int",
               [(1.0, 5.0, 0), (3.0, math.nan, 0), (None, 7.0, 0), (100.0, 100.0, 1), (9.0, 9.0, None)])
    stats = {r.feature: (r.mean, r.std) for r in gt.baseline_stats(df, ["x", "y"]).collect()}
    assert stats["x"] == (2.0, pytest.approx(math.sqrt(2)))
    assert stats["y"] == (6.0, pytest.approx(math.sqrt(2)))


def test_baseline_of_one_row_has_no_deviation_and_never_trips(table):
    df = table("x double, Label int", [(1.0, 0)])
    stats = stats_map(gt.baseline_stats(df, ["x"]), ["x"])
    assert stats["x"] == (1.0, None)
    assert gt.gate(table("x double", [(1e9,)]), stats, ["x"]).first().escalate is False


def test_missing_statistics_fail(spark):
    with pytest.raises(ValueError, match="nope"):
        stats_map(dims.nominal_baseline(spark), ["MsgId", "nope"])


def test_nominal_baseline_covers_all_features(spark, table):
    stats = stats_map(dims.nominal_baseline(spark), fv.FEATURES)
    row = {name: stats[name][0] for name in fv.FEATURES}
    far = dict(row, MemoryShmemMB=stats["MemoryShmemMB"][0] + 5.01 * stats["MemoryShmemMB"][1])
    schema = "i int, " + ", ".join(f"{name} double" for name in fv.FEATURES)
    df = table(schema, [(i, *(r[n] for n in fv.FEATURES)) for i, r in enumerate([row, far])])
    assert [r.escalate for r in gt.gate(df, stats, fv.FEATURES).orderBy("i").collect()] == [False, True]
    sql_functions.register(spark, stats)
    df.createOrReplaceTempView("w")
    flagged = spark.sql(f"SELECT i, check_escalation({', '.join(fv.FEATURES)}) AS e FROM w ORDER BY i").collect()
    assert [r.e for r in flagged] == [False, True]


def test_rates_and_counts_in_one_pass(table):
    df = table("a double, b double, c double, Label int",
               [(10.0, 0.0, 1.0, 0), (99.0, 0.0, 1.0, 0), (99.0, 0.0, 1.0, 1)])
    rates = {r.Label: (r.escalated, r.total, r.rate) for r in
             gt.escalation_rate(gt.gate(df, STATS, NAMES)).collect()}
    assert rates == {0: (1, 2, 0.5), 1: (1, 1, 1.0)}
    seen = Observation("gate")
    assert gt.escalated_rows(df, STATS, NAMES, observation=seen).count() == 2
    assert seen.get == {"seen": 3, "escalated": 2}


def test_long_form_agrees_with_wide_form(spark, table):
    df = windows(table, (20.1, 5.0, 1.0), (math.nan, None, 9.0))
    stats = table("feature string, mean double, std double", [(n, *STATS[n]) for n in NAMES])
    z = {(r.i, r.feature): r.z for r in gt.feature_z(df, stats, NAMES, ["i"]).collect()}
    assert z[(0, "a")] == pytest.approx(5.05) and z[(0, "b")] is None and z[(1, "a")] is None and z[(1, "c")] == 8.0


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    rows=st.lists(st.tuples(*[st.one_of(st.none(), st.floats(-100, 100))] * 3), min_size=1, max_size=8),
    z=st.floats(0, 10), more=st.floats(0, 5), m=st.integers(0, 3),
)
def test_gate_is_monotone(table, rows, z, more, m):
    df = windows(table, *rows)
    strict = gt.gate(df, STATS, NAMES, z + more, m)
    joined = gt.gate(df, STATS, NAMES, z, m).select("i", F.col("escalate").alias("loose")).join(
        strict.select("i", "escalate"), "i")
    assert joined.where("escalate AND NOT loose").count() == 0
    fewer = gt.gate(df, STATS, NAMES, z, m + 1).select("i", F.col("escalate").alias("more"))
    assert gt.gate(df, STATS, NAMES, z, m).join(fewer, "i").where("more AND NOT escalate").count() == 0
