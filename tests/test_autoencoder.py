"""Gradients against differences, sums over partitions against one matrix, and the network against the linear model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.operators import autoencoder as ae
from perigee.operators import models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def curved(spark):
    """Normal rows on a curved line, others off it."""
    draw = np.random.default_rng(3)
    rows = []
    for i in range(900):
        t = draw.uniform(-2, 2)
        bend = t * t if i % 3 else -t * t
        rows.append((i, float(t), float(bend + draw.normal() * 0.05), float(np.sin(2 * t)), 0 if i % 3 else 2))
    return spark.createDataFrame(rows, "seq long, a double, b double, c double, Label int")


def _weights(seed=1, sizes=(3, 5, 2, 5, 3)):
    draw = np.random.default_rng(seed)
    return [(draw.standard_normal((m, n)), draw.standard_normal(n)) for m, n in zip(sizes, sizes[1:])]


def test_gradient_equals_differences():
    weights, rows = _weights(), np.random.default_rng(2).standard_normal((40, 3))
    got = ae.sums(weights, rows)
    assert got[0] == 40 and got[1] == pytest.approx(ae.row_errors(weights, rows).sum())
    values, tiny = ae.flat(weights), 1e-6
    for at in range(len(values)):
        up, down = values.copy(), values.copy()
        up[at] += tiny
        down[at] -= tiny
        slope = (ae.row_errors(ae.shaped(up, weights), rows).sum() - ae.row_errors(ae.shaped(down, weights), rows).sum()) / (2 * tiny)
        assert got[2 + at] == pytest.approx(slope, rel=1e-4, abs=1e-5)


@pytest.mark.parametrize("partitions", [1, 7])
def test_sums_over_partitions_equal_one_matrix(spark, partitions):
    weights, rows = _weights(), np.random.default_rng(4).standard_normal((200, 3))
    df = spark.createDataFrame(rows.tolist(), "a double, b double, c double").repartition(partitions)
    np.testing.assert_allclose(ae.gradient_sums(df, weights), ae.sums(weights, rows), rtol=1e-9, atol=1e-9)
    assert not ae.gradient_sums(df.where("a > 100"), weights).any()


def test_network_starts_as_the_linear_model_and_improves(curved):
    linear = models.train_anomaly(curved, NAMES, components=1)
    start = ae.train_autoencoder(curved, NAMES, components=1, rounds=0)
    both = linear.error(curved.where("Label = 0"), "plain")
    same = start.error(both).agg(F.max(F.abs(F.col("plain") - F.col("error"))).alias("gap"), F.avg("plain").alias("plain")).first()
    assert same.gap < 1e-9 and start.losses == [pytest.approx(same.plain)]
    model = ae.train_autoencoder(curved, NAMES, components=1, rounds=60)
    errors = {r.Label: r.e for r in model.error(curved).groupBy("Label").agg(F.avg("error").alias("e")).collect()}
    assert errors[0] == pytest.approx(min(model.losses)) and errors[0] < 0.8 * same.plain
    assert errors[2] > 2 * errors[0]
    again = ae.train_autoencoder(curved.repartition(5), NAMES, components=1, rounds=5)
    np.testing.assert_allclose(again.losses, model.losses[:6], rtol=1e-6)  # scaler and axes are sums in another order


def test_missing_values_and_no_normal_rows(curved, spark):
    odd = spark.createDataFrame([(1, None, 1.0, 1.0, 0), (2, float("nan"), 1.0, 1.0, 0), (3, 0.0, 0.0, 0.0, 0)], curved.schema)
    model = ae.train_autoencoder(curved.unionByName(odd), NAMES, components=2, rounds=2)
    got = {r.seq: r.error for r in model.error(odd).collect()}
    assert got[1] is None and got[2] is None and got[3] >= 0
    assert model.error(odd.where("seq > 9")).count() == 0
