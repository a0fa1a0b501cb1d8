import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.operators import evaluate as ev
from perigee.operators import models, sequences
from perigee.plans import training
from perigee.plans.triage import triage
from perigee.sources import artifacts, dims

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def raw(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(600):
        label = (i // 40) % 5
        rows.append((i, *(float(x) for x in rng.normal(size=3) + np.array([label * 3, -label, label % 2])), label))
    return spark.createDataFrame(rows, "seq long, a double, b double, c double, Label int")


@pytest.fixture(scope="module")
def forest(raw):
    return models.train_classifier(raw, NAMES, trees=10)


def test_scores_agree_with_probabilities(raw, forest, spark):
    scored = models.score(raw, forest, dims.classes(spark)).orderBy("seq").collect()
    plain = forest.transform(raw).orderBy("seq").collect()
    for got, row in zip(scored, plain):
        assert got.predicted_label == int(np.argmax(row.probability)) == int(row.prediction)
        assert got.confidence == round(float(max(row.probability)), 4)
    assert {r.class_name for r in scored} == set(r.class_name for r in dims.classes(spark).collect())


def test_metrics_equal_sql_over_predictions(raw, forest, spark):
    models.score(raw, forest).createOrReplaceTempView("scored")
    expected = spark.sql("SELECT avg(CAST(Label = predicted_label AS DOUBLE)) AS a FROM scored").first().a
    got = ev.overall_metrics(ev.confusion(spark.table("scored"), "Label", "predicted_label")).first()
    assert got.accuracy == pytest.approx(expected) and got.accuracy > 0.8


def test_missing_values_are_scored_too(forest, spark):
    odd = spark.createDataFrame([(1, None, float("nan"), 1.0)], "seq long, a double, b double, c double")
    assert models.score(odd, forest).first().predicted_label in range(5)


def test_model_survives_saving(raw, forest, tmp_path):
    artifacts.save_model(forest, str(tmp_path / "m"))
    loaded = artifacts.load_model(str(tmp_path / "m"))
    assert models.score(raw, loaded).exceptAll(models.score(raw, forest)).count() == 0


def test_importance_sums_to_one(forest, spark):
    got = {r.feature: r.importance for r in models.feature_importance(spark, forest, NAMES).collect()}
    assert set(got) == set(NAMES) and sum(got.values()) == pytest.approx(1.0) and max(got, key=got.get) in ("a", "b")


def test_anomaly_score_equals_numpy(raw):
    model = models.train_anomaly(raw, NAMES, components=2)
    x = np.array([[r.a, r.b, r.c] for r in raw.orderBy("seq").collect()])
    labels = np.array([r.Label for r in raw.orderBy("seq").collect()])
    scaled = (x - x.mean(axis=0)) / x.std(axis=0)
    normal = scaled[labels == 0]
    centre = normal.mean(axis=0)
    axes = np.linalg.svd(normal - centre, full_matrices=False)[2][:2]
    centred = scaled - centre
    expected = ((centred - centred @ axes.T @ axes) ** 2).mean(axis=1)
    got = np.array([r.error for r in model.error(raw).orderBy("seq").collect()])
    assert np.allclose(got, expected, atol=1e-10)
    assert got[labels == 0].mean() < got[labels == 4].mean()


def test_sequence_model_scores_each_sequence(raw):
    built = training.scaled_sequences(training.fitted_scaler(raw, NAMES), raw, NAMES)
    assert built.count() == 590
    network = models.train_sequence_classifier(built, 10, 3, 5, hidden=8, iterations=40)
    scored = models.score_sequences(built, network)
    assert scored.count() == 590
    assert ev.accuracy(scored, "Label", "sequence_pred").first().accuracy > 0.5


def test_offline_evaluation(raw, spark):
    noised = raw.withColumn("a", F.col("a") + F.sin("seq"))
    result = training.evaluate(raw, noised, NAMES, trees=5, components=2)
    compared = {r.model: (r.rows, r.accuracy) for r in result.comparison.collect()}
    assert set(compared) == {"model", "ensemble", "tuned_ensemble", "sequence_pred"}
    assert compared["model"][0] == 600 and compared["sequence_pred"][0] == 590
    rows = result.predictions.collect()
    assert all(r.ensemble == (0 if r.error < result.percentile else r.model) for r in rows)
    assert all(r.tuned_ensemble == (0 if r.error < result.adaptive else r.model) for r in rows)
    normal = [r.error for r in rows if r.Label == 0]
    assert result.percentile == pytest.approx(float(np.percentile(normal, 95)))
    apart = training.evaluate(raw, noised, NAMES, trees=5, components=2, calibration=raw, sequence_model=False)
    assert apart.percentile != result.percentile and set(apart.comparison.columns) == {"model", "rows", "accuracy", "macro_f1"}


def test_triage_scores_only_what_the_gate_lets_through(raw, forest):
    stats = {name: (0.0, 1.0) for name in NAMES}
    windows = raw.withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    got = triage(windows, stats, NAMES, forest)
    assert got.count() == raw.where("abs(a) > 5 OR abs(b) > 5 OR abs(c) > 5").count()
    assert got.where("record.classification.class_name IS NULL").count() == 0


def test_model_does_not_depend_on_how_rows_were_cut(raw):
    found = {
        tuple(models.train_classifier(raw.repartition(n), NAMES, trees=5).stages[-1].featureImportances.toArray())
        for n in (2, 4, 8)
    }
    assert len(found) == 1


def test_anomaly_fit_keeps_rows_with_a_missing_feature(raw):
    holed = raw.withColumn("b", F.when(F.col("seq") % 5 != 0, F.col("b")))
    model = models.train_anomaly(holed, NAMES, components=2)
    x = np.array([[r.a, np.nan if r.b is None else r.b, r.c, r.Label] for r in holed.collect()])
    mean, std = np.nanmean(x[:, :3], axis=0), np.nanstd(x[:, :3], axis=0)
    normal = ((x[:, :3] - mean) / std)[x[:, 3] == 0]
    centre = np.nanmean(normal, axis=0)
    filled = np.where(np.isnan(normal), centre, normal) - centre
    axes = np.linalg.svd(filled - filled.mean(axis=0), full_matrices=False)[2][:2]
    got = np.array(model.components)
    assert np.allclose(np.abs((got * axes).sum(axis=1)), 1.0, atol=1e-8)


def test_permuted_values_are_dealt_once_each(raw):
    rows = models.permuted(raw.drop("Label"), NAMES).collect()
    plain = sorted((r.seq, r.a, r.b, r.c) for r in rows if r.permuted is None)
    assert plain == sorted((r.seq, r.a, r.b, r.c) for r in raw.collect())
    for at, name in enumerate(NAMES, 1):
        copy = sorted((r.seq, r.a, r.b, r.c) for r in rows if r.permuted == name)
        assert sorted(r[at] for r in copy) == sorted(r[at] for r in plain)
        assert [r[:at] + r[at + 1:] for r in copy] == [r[:at] + r[at + 1:] for r in plain]
        assert sum(x != y for x, y in zip(copy, plain)) > 500


def test_permutation_importance_of_a_noise_column(raw):
    with_noise = raw.withColumn("noise", F.rand(3)).persist()
    names = [*NAMES, "noise"]
    model = models.train_classifier(with_noise, names, trees=10)
    found = {r.feature: r for r in models.permutation_importance(with_noise, model, names).collect()}
    assert set(found) == set(names)
    assert abs(found["noise"].importance) < 0.05 < max(found[n].importance for n in NAMES)
    permuted = models.score(models.permuted(with_noise, names), model)
    permuted.createOrReplaceTempView("permuted_scores")
    hits = "SELECT avg(CAST(Label = predicted_label AS DOUBLE)) FROM permuted_scores WHERE permuted = 'a'"
    assert found["a"].accuracy == pytest.approx(raw.sparkSession.sql(hits).first()[0])


def test_merged_sketches_keep_the_rank(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.exponential(size=40_000), np.full(20_000, 0.5)])
    rows = spark.createDataFrame([(int(i % 9), float(v), 0) for i, v in enumerate(values)] + [(1, None, 0), (2, float("nan"), 0), (3, 99.0, 1)],
                                 "batch int, error double, Label int")
    sketches = ev.threshold_sketches(rows, "batch")
    got = ev.merged_threshold(sketches, 0.95).first()
    assert sketches.count() == 9 and got.n == 60_000
    assert (values < got.threshold).mean() <= 0.95 + 3 / ev.SKETCH_K and (values <= got.threshold).mean() >= 0.95 - 3 / ev.SKETCH_K
    assert ev.merged_threshold(sketches.limit(0)).first().threshold is None


def test_pieces_grow_with_the_rows(table, monkeypatch):
    rows = table("a double, Label int", [(float(i), i % 2) for i in range(100)])
    dealt, deal = [], models.fixed_partitions
    monkeypatch.setattr(models, "fixed_partitions", lambda df, pieces, *order: dealt.append(pieces) or deal(df, pieces, *order))
    for rows_each in (1_000, 20):
        monkeypatch.setattr(models, "PIECE_ROWS", rows_each)
        models.train_classifier(rows, ["a"], trees=2, depth=2, partitions=4)
    assert dealt == [4, 5]


def test_rows_are_worked_out_once_for_all_passes_of_the_training(raw, spark):
    seen = spark.sparkContext.accumulator(0)

    def watched(value):
        seen.add(1)
        return value

    models.train_classifier(raw.withColumn("a", F.udf(watched, "double")("a")), NAMES, trees=2, depth=2)
    assert seen.value == 600


def test_sequences_are_built_once_for_all_that_the_fit_asks(table, spark):
    built = table("seq long, steps array<array<double>>, Label int", [(i, [[float(i % 3)], [float(i % 2)]], i % 2) for i in range(60)])
    seen = spark.sparkContext.accumulator(0)

    def watched(value):
        seen.add(1)
        return value

    models.train_sequence_classifier(built.withColumn("Label", F.udf(watched, "int")("Label")), 2, 1, 2, hidden=2, iterations=3, partitions=2)
    assert seen.value == 60
