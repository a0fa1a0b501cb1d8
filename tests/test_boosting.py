"""Boosted trees: margins against the saved trees, probabilities, and their use as confidence."""

import math
import random

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from perigee.operators import boosting, lookup, models
from perigee.sources import dims
from perigee.sources.artifacts import load_model, save_model

NAMES = ["a", "b"]


def some_rows(n, seed=3):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a, b = rng.uniform(-3, 3), rng.uniform(-3, 3)
        label = 0 if a * a + b * b < 3 else 1 + (a > 0) + 2 * (b > 0 and a < 0)
        out.append((i, a, b, label if rng.random() < 0.97 else rng.randrange(4)))
    return out


@pytest.fixture(scope="module")
def trained(spark, tmp_path_factory):
    rows = spark.createDataFrame(some_rows(600), "seq long, a double, b double, Label int").repartition(3)
    model = boosting.train_boosted(rows, NAMES, rounds=3, depth=2, partitions=2)
    path = str(tmp_path_factory.mktemp("boosted") / "model")
    save_model(model, path)
    return rows, load_model(path)


def leaf(node, x):
    """The value of a saved tree, walked by its nodes."""
    while node.numDescendants() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_margins_are_the_weighted_sums_of_the_saved_trees(spark, trained):
    rows, model = trained
    boosters = boosting.boosters(model)
    assert len(boosters) == 5
    out = model.transform(rows).select("a", "b", vector_to_array("margins").alias("m")).limit(40).collect()
    for row in out:
        for k, booster in enumerate(boosters):
            by_hand = sum(w * leaf(tree._call_java("rootNode"), (row.a, row.b)) for tree, w in zip(booster.trees, booster.treeWeights))
            assert row.m[k] == pytest.approx(by_hand, abs=1e-12)


def test_probabilities_follow_the_margins(spark, trained):
    rows, model = trained
    last = model.stages[-1]
    weights, intercept = last.coefficientMatrix.toArray(), last.interceptVector.toArray()
    for row in model.transform(rows).select(vector_to_array("margins").alias("m"), vector_to_array("probability").alias("p")).limit(40).collect():
        powers = [math.exp(sum(w * m for w, m in zip(weights[k], row.m)) + intercept[k]) for k in range(5)]
        assert row.p == pytest.approx([x / sum(powers) for x in powers], abs=1e-9)


def test_confidence_meets_the_policy_and_is_calibrated(spark, trained):
    rows, model = trained
    scored = models.score(rows, model, dims.classes(spark))
    decided = lookup.with_mitigation(scored, dims.policy_bands(spark))
    assert decided.count() == 600 and decided.where("action IS NULL OR policy_error IS NOT NULL").count() == 0
    fresh = spark.createDataFrame(some_rows(600, 8), rows.schema)
    found = models.score(fresh, model).agg(
        F.avg((F.col("Label") == F.col("predicted_label")).cast("double")).alias("right"), F.avg("confidence").alias("claimed")
    ).first()
    assert found.right > 0.7 and abs(found.right - found.claimed) < 0.12


def test_the_same_rows_give_the_same_model(spark, trained):
    rows, model = trained
    again = boosting.train_boosted(rows.repartition(7), NAMES, rounds=3, depth=2, partitions=2)
    first, second = (models.score(rows, m).select("seq", "predicted_label", "confidence") for m in (model, again))
    assert first.exceptAll(second).count() == 0


def test_missing_classes_labels_and_values(spark):
    rows = [(i, float(i % 5), None if i == 7 else 1.0, None if i % 11 == 0 else i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "seq long, a double, b double, Label int")
    model = boosting.train_boosted(df, NAMES, rounds=2, depth=2, partitions=2)
    scored = models.score(df, model).collect()
    assert len(scored) == 200 and {r.predicted_label for r in scored} <= {0, 1}


def test_margins_are_kept_while_the_regression_goes_over_them(table, monkeypatch):
    rows = table("seq long, a double, b double, Label int", some_rows(100))
    kept, plain = [], boosting.LogisticRegression.fit
    monkeypatch.setattr(boosting.LogisticRegression, "fit", lambda self, df: kept.append(df.storageLevel.useMemory) or plain(self, df))
    boosting.train_boosted(rows, NAMES, rounds=1, depth=1, partitions=2)
    assert kept == [True]


def test_many_rows_are_boosted_for_one_class_after_the_other(table, monkeypatch):
    rows = table("seq long, a double, b double, Label int", some_rows(100))
    at_work, most, plain = set(), [], boosting.GBTClassifier.fit

    def fit(self, df):
        at_work.add(id(self))
        most.append(len(at_work))
        try:
            return plain(self, df)
        finally:
            at_work.discard(id(self))

    together = models.score(rows, boosting.train_boosted(rows, NAMES, rounds=2, depth=2, partitions=2))
    monkeypatch.setattr(boosting, "ROWS_AT_ONCE", 1)
    monkeypatch.setattr(boosting.GBTClassifier, "fit", fit)
    in_turn = models.score(rows, boosting.train_boosted(rows, NAMES, rounds=2, depth=2, partitions=2))
    assert most == [1] * 5
    assert sorted(in_turn.collect()) == sorted(together.collect())


def test_classes_boosted_at_once_follow_the_rows():
    asked = [0, 1, 400_000, 1_000_000, 2_000_000, 2_000_001, 36_000_000]
    assert [boosting.boosted_at_once(rows, 5) for rows in asked] == [5, 5, 5, 2, 1, 1, 1]
    assert boosting.boosted_at_once(10, 3) == 3
