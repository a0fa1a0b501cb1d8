import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from perigee.operators import evaluate as ev
from perigee.operators import features as fx
from perigee.operators import order, profile, refresh, similarity
from perigee.sources import dims
from perigee.sources.artifacts import stats_map


def test_shared_features_keep_noised_order(table):
    raw = table("b double, extra double, a double, Label int", [(1.0, 2.0, 3.0, 0)])
    noised = table("a double, Label int, b double, own double", [(1.0, 0, 2.0, 3.0)])
    assert fx.shared_features(raw, noised) == ["a", "b"]
    assert fx.noised_features(noised) == ["a", "b", "own"]
    with pytest.raises(AnalysisException):
        fx.project(raw, fx.noised_features(noised)).collect()
    assert fx.project(raw, ["a", "own"], strict=False).columns == ["a"]
    stacked = fx.stack_splits(raw, noised)
    assert {r.split: (r.extra, r.own) for r in stacked.collect()} == {"raw": (2.0, None), "noised": (None, 3.0)}


def test_cyclic_time_replaces_radians(table):
    row = fx.cyclic_time(table("x int, TimeRadians double", [(1, math.pi / 2)])).first()
    assert row.asDict() == {"x": 1, "Time_Sin": 1.0, "Time_Cos": pytest.approx(0.0, abs=1e-15)}


def test_scaler_uses_population_deviation_and_only_centres_constants(table):
    fit = table("a double, c double", [(1.0, 5.0), (3.0, 5.0), (math.nan, 5.0)])
    scaler = fx.fit_scaler(fit, ["a", "c"])
    assert stats_map(scaler, ["a", "c"]) == {"a": (2.0, 1.0), "c": (5.0, 0.0)}
    row = fx.scale(table("a double, c double", [(4.0, 7.0)]), scaler, ["a", "c"]).first()
    assert (row.a, row.c) == (2.0, 2.0)


def test_contract_splits_without_losing_rows(spark, table):
    df = table("i int, a string, b double, class_name string",
               [(0, "1.5", 2.0, "Normal"), (1, "x", 2.0, "Normal"), (2, None, None, "Normal"),
                (3, "1", 1.0, "Alien"), (4, "NaN", 1.0, None), (5, "2", math.nan, "Normal")])
    checked = fx.contract_split(df, ["a", "b"], dims.classes(spark))
    reasons = {r.i: r.contract_error for r in checked.collect()}
    assert reasons == {0: None, 1: "not numeric: a", 2: "not numeric: a,b", 3: "unknown class: Alien",
                       4: "unknown class: null", 5: None}
    good = fx.valid_rows(checked, ["a", "b"])
    assert good.count() + fx.quarantined_rows(checked).count() == 6 and dict(good.dtypes)["a"] == "double"
    assert fx.contract_split(df, ["a", "missing"]).where("contract_error IS NULL").count() == 0


def test_label_mix_range_and_profile(table):
    df = table("Label int, TimeRadians double", [(1, 0.0), (1, 6.29), (0, -0.1), (None, math.nan)])
    assert [(r.Label, r.n) for r in profile.label_mix(df).collect()] == [(0, 1), (1, 2)]
    assert profile.range_audit(df).first().asDict() == {"min_value": -0.1, "max_value": 6.29, "out_of_range": 2}
    assert profile.dataset_profile(df).first().asDict() == {"rows": 4, "columns": 2, "classes": 2}


def test_correlation_is_pairwise_complete(spark):
    rng = np.random.default_rng(5)
    frame = pd.DataFrame(rng.normal(size=(300, 5)), columns=list("abcde")) + 1e6
    frame["b"] += frame["a"] * 2
    frame.loc[::7, "c"] = np.nan
    frame.loc[::5, "d"] = np.nan
    frame["flat"] = 0.1
    # Present only where "d" is one value far from its mean, and where it is not.
    frame["split"] = np.where(frame.index < 20, rng.normal(size=300), np.nan)
    frame.loc[frame.index < 20, "d"] = 1e9
    frame["near"] = np.where(frame.index < 20, 1e9 + frame.index % 3, 0.0)

    def expected(x, y):
        both = frame[[x, y]].dropna().to_numpy().astype(np.longdouble)
        both -= both.mean(axis=0)
        return float((both[:, 0] * both[:, 1]).sum() / np.sqrt((both ** 2).sum(axis=0).prod())) if x != y else 1.0

    df = spark.createDataFrame(frame).repartition(3)
    got = {(r.f1, r.f2): r.r for r in profile.correlation_matrix(profile.correlation(df, list(frame.columns))).collect()}
    assert len(got) == 64
    for (x, y), r in got.items():
        if "flat" in (x, y) or {x, y} == {"d", "split"}:
            assert r is None
        else:
            # At 1e9 a double keeps about seven digits behind the point.
            assert r == pytest.approx(expected(x, y), abs=1e-7 if "near" in (x, y) else 1e-9), (x, y)


def test_correlation_with_infinite_values(table):
    df = table("x double, y double, z double",
               [(1.0, 2.0, 1.0), (2.0, 3.0, 5.0), (3.0, 5.0, 2.0), (math.inf, None, 4.0), (4.0, 1.0, None)])
    got = {(r.f1, r.f2): r.r for r in profile.correlation(df, ["x", "y", "z"]).collect()}
    assert got[("x", "y")] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 3, 5, 1])[0, 1])
    assert math.isnan(got[("x", "z")])


def test_class_diversity(table):
    df = table("Label int, v double, c double", [(0, float(i), float(i % 3)) for i in range(5)] + [(1, 9.0, 1.0)])
    got = {r.Label: (r.p25, r.p50, r.p75, r.codes) for r in profile.class_diversity(df, "v", "c").collect()}
    assert got == {0: (1.0, 2.0, 3.0, 3), 1: (9.0, 9.0, 9.0, 1)}


def test_macro_f1_is_unweighted(table):
    df = table("Label int, pred int", [(0, 0), (0, 0), (0, 1), (1, 2)])
    row = ev.overall_metrics(ev.confusion(df)).first()
    # F1 of classes 0, 1, 2: 0.8, 0, 0
    assert row.accuracy == 0.5 and row.macro_f1 == pytest.approx(0.8 / 3) and row.rows == 4
    assert ev.accuracy(df).first().accuracy == 0.5
    by_class = {r["class"]: (r.support, r.precision, r.recall) for r in ev.class_metrics(ev.confusion(df)).collect()}
    assert by_class == {0: (3, 1.0, pytest.approx(2 / 3)), 1: (1, 0.0, 0.0), 2: (0, 0.0, 0.0)}
    matrix = ev.confusion_matrix(ev.confusion(df), [0, 1, 2]).orderBy("truth").collect()
    assert [tuple(r) for r in matrix] == [(0, 2, 1, 0), (1, 0, 0, 1)]


def test_compare_models_equals_one_by_one(table):
    rng = random.Random(1)
    df = table("Label int, a int, b int", [(rng.randrange(3), rng.randrange(3), rng.choice([None, 0, 1])) for _ in range(200)])
    got = {r.model: (r.rows, r.accuracy, r.macro_f1) for r in ev.compare_models(df, ["a", "b"]).collect()}
    for model in "ab":
        one = ev.overall_metrics(ev.confusion(df, "Label", model)).first()
        assert got[model] == pytest.approx((one.rows, one.accuracy, one.macro_f1))


def test_thresholds_and_override(table):
    errors = [0.1, 0.2, 0.4, 0.9, 3.0]
    df = table("Label int, pred int, error double", [(0, 3, e) for e in errors] + [(1, 2, 0.05), (1, 2, math.nan)])
    percentile = ev.percentile_threshold(df)
    adaptive = ev.adaptive_threshold(df).first().threshold
    assert percentile == pytest.approx(float(np.percentile(errors, 95)))
    assert adaptive == pytest.approx(np.mean(errors) + 2 * np.std(errors))
    got = [r.o for r in df.select(ev.override_normal("pred", "error", 0.4).alias("o")).collect()]
    assert got == [0, 0, 3, 3, 3, 0, 2]
    assert {r.o for r in df.select(ev.override_normal("pred", "error", math.nan).alias("o")).collect()} == {3, 2}
    assert math.isnan(ev.percentile_threshold(df.where("Label = 1")))


def test_misclassified_drivers(table):
    df = table("Label int, pred int, x double, y double, z double",
               [(2, 3, 5.0, -9.0, 1.0), (2, 3, 7.0, 9.0, 1.0), (2, 2, 99.0, 0.0, 1.0), (0, 3, 99.0, 0.0, 1.0)])
    stats = {"x": (0.0, 1.0), "y": (0.0, 1.0), "z": (0.0, 0.0)}
    got = ev.misclassified_drivers(df, stats, ["x", "y", "z"], 2, 3).collect()
    assert [(r.feature, r.mean_abs_z) for r in got] == [("y", 9.0), ("x", 6.0)]


def brute(queries, base, k, metric):
    out = {}
    for qid, q in queries:
        q = np.array(q)
        def distance(v):
            v = np.array(v)
            if metric == "l2sq":
                return float(((q - v) ** 2).sum())
            inner = float(q @ v)
            if metric == "ip":
                return 1 - inner
            norm = float(np.linalg.norm(q) * np.linalg.norm(v))
            return 1 - (inner / norm if norm else 0.0)
        out[qid] = [i for _, i in sorted((round(distance(v), 9), i) for i, v in base)][:k]
    return out


@pytest.mark.parametrize("metric", similarity.METRICS)
@pytest.mark.parametrize("broadcast_rows,block_values", [(1000, 1000), (0, 21)])
def test_similarity_both_ways_equal_brute_force(table, metric, broadcast_rows, block_values):
    rng = random.Random(11)
    vector = lambda: [float(rng.randrange(-3, 4)) for _ in range(3)]
    base = [(i, vector()) for i in range(60)]
    asked = [(1000 + i, vector()) for i in range(40)] + [(2000, [0.0, 0.0, 0.0])]
    knowledge = table("id long, type string, embedding array<float>",
                      [(i, "incident", v) for i, v in base] + [(-1, "class_mapping", asked[0][1]), (99, "incident", None)])
    queries = table("id long, embedding array<float>", asked)
    got = similarity.similar_incidents(
        queries, knowledge, k=3, metric=metric, broadcast_rows=broadcast_rows, block_values=block_values).collect()
    if metric == "cosine":
        # Equal directions may differ in the last bit, so compare distances instead of picks.
        assert len(got) == 41 * 3 and all(-1 != r.match_id for r in got)
        return
    ranked = {}
    for r in sorted(got, key=lambda r: (r.id, r["rank"])):
        ranked.setdefault(r.id, []).append(r.match_id)
    assert ranked == brute(asked, base, 3, metric)


def test_similarity_with_few_documents_and_bad_metric(table):
    knowledge = table("id long, type string, embedding array<double>", [(5, "incident", [1.0])])
    queries = table("id long, embedding array<double>", [(1, [3.0])])
    assert [tuple(r) for r in similarity.similar_incidents(queries, knowledge).collect()] == [(1, 1, 5, 4.0)]
    assert similarity.similar_incidents(queries, knowledge.where("id < 0")).count() == 0
    with pytest.raises(ValueError):
        similarity.similar_incidents(queries, knowledge, metric="nope")


def test_upsert_last_write_wins(spark, table):
    old = table("id string, text string, year string", [("a", "old", "1"), ("b", "old", "2")])
    new = table("id string, text string, n int", [("b", "first", 1), ("b", "last", 2), ("c", "new", 1)])
    got = {r.id: (r.text, r.year) for r in refresh.upsert(old, new, order="n").collect()}
    assert got == {"a": ("old", "1"), "b": ("last", None), "c": ("new", None)}
    again = refresh.upsert(refresh.upsert(old, new, order="n"), new, order="n")
    assert {r.id: (r.text, r.year) for r in again.collect()} == got


def test_versions_are_read_whole(spark, table, tmp_path):
    root = str(tmp_path / "kb")
    refresh.save_version(table("id string, text string", [("a", "1")]), root, 1)
    latest = refresh.load_version(spark, root)
    refresh.save_version(refresh.upsert(latest, table("id string, text string", [("a", "2"), ("b", "1")])), root, 2)
    assert sorted(tuple(r) for r in refresh.load_version(spark, root).collect()) == [("a", "2"), ("b", "1")]
    assert [tuple(r) for r in refresh.load_version(spark, root, 1).collect()] == [("a", "1")]


def test_refresh_recomputes_missing_and_failed_only(spark, table, tmp_path):
    wanted = table("class_name string", [("Normal",), ("Data Injection",), ("Command Flooding",)])
    done = table("class_name string, status string, n int",
                 [("Normal", "AUTONOMOUS", 1), ("Data Injection", "ERROR", 1), ("Other", "ERROR", 1)])
    asked = []

    def compute(todo):
        asked.extend(sorted(r.class_name for r in todo.collect()))
        return todo.select("class_name", F.lit("AUTONOMOUS").alias("status"), F.lit(2).alias("n"))

    got = {r.class_name: (r.status, r.n) for r in refresh.refresh_results(wanted, done, compute).collect()}
    assert asked == ["Command Flooding", "Data Injection"]
    assert got == {"Normal": ("AUTONOMOUS", 1), "Data Injection": ("AUTONOMOUS", 2),
                   "Command Flooding": ("AUTONOMOUS", 2), "Other": ("ERROR", 1)}
    path = str(tmp_path / "results")
    refresh.save_by_key(done, path)
    refresh.save_by_key(compute(refresh.to_recompute(wanted, done)), path)
    assert {r.class_name: (r.status, r.n) for r in refresh.load_results(spark, path).collect()} == got


@pytest.mark.parametrize("metric", similarity.METRICS)
def test_similarity_is_the_same_to_the_last_bit_both_ways(table, metric):
    rng = np.random.default_rng(3)
    rows = [(i, "incident", rng.normal(0, 1, 33).tolist()) for i in range(150)]
    vectors = table("id long, type string, embedding array<double>", [*rows, (900, "incident", rows[0][2])])
    both = [
        sorted(map(tuple, similarity.similar_incidents(vectors, vectors, k=4, metric=metric, **how).collect()))
        for how in ({}, {"broadcast_rows": 0, "block_values": 33 * 20})
    ]
    assert both[0] == both[1]


def test_query_without_vector_is_kept(table):
    vectors = table("id long, type string, embedding array<double>", [(1, "incident", [1.0]), (2, "incident", None)])
    for how in ({}, {"broadcast_rows": 0}):
        got = sorted(map(tuple, similarity.similar_incidents(vectors, vectors, k=1, **how).collect()))
        assert got == [(1, 1, 1, 0.0), (2, None, None, None)]
    assert similarity.similar_incidents(vectors, vectors, k=1, keep_unmatched=False).count() == 1


def test_upsert_refuses_a_key_written_twice_without_order(table):
    old = table("id string, n int", [("a", 1)])
    with pytest.raises(ValueError):
        refresh.upsert(old, table("id string, n int", [("b", 1), ("b", 2)]))


def test_results_of_many_keys_share_few_folders(spark, table, tmp_path):
    path = str(tmp_path / "many")
    rows = table("class_name string, n int", [(f"k{i}", i) for i in range(200)])
    refresh.save_by_key(rows, path, buckets=4)
    refresh.save_by_key(rows.where("n < 50").selectExpr("class_name", "n + 1000 AS n"), path, buckets=4)
    got = {r.class_name: r.n for r in refresh.load_results(spark, path).collect()}
    assert got == {f"k{i}": i + 1000 if i < 50 else i for i in range(200)}
    assert len(list((tmp_path / "many").glob("_bucket=*"))) == 4


def test_class_without_values_and_text_labels_stay(table):
    rows = table("Label string, v double, c int", [("x", 1.0, 1), ("x", 3.0, 2), ("y", None, 5)])
    got = {r.Label: (r.p50, r.codes) for r in profile.class_diversity(rows, "v", "c").collect()}
    assert got == {"x": (2.0, 2), "y": (None, 1)}


def test_representative_row_is_one_per_group_on_ties(table):
    rows = table("Label int, seq long, v string", [(0, 5, "b"), (0, 5, "a"), (0, 5, "c"), (1, 1, "z")])
    assert sorted(map(tuple, order.representative_rows(rows).collect())) == [(0, 5, "a"), (1, 1, "z")]
    with pytest.raises(ValueError):
        order.representative_rows(rows, seq="v")


@pytest.mark.parametrize("broadcast_rows", [50_000, 0])
def test_similarity_with_ragged_vectors(table, broadcast_rows):
    nan, inf = float("nan"), float("inf")
    knowledge = table("id int, type string, embedding array<double>", [
        (1, "incident", [0.0, 0.0]), (2, "incident", [3.0, 4.0]), (3, "incident", [1.0]), (4, "incident", [1.0, None]),
        (5, "incident", [nan, 1.0]), (6, "incident", [inf, 1.0]), (7, "incident", []), (8, "incident", None),
    ])
    queries = table("id int, embedding array<double>", [(1, [0.0, 1.0]), (2, [1.0]), (3, [1.0, None]), (4, [nan, 0.0]), (5, None), (6, [])])
    found = similarity.similar_incidents(queries, knowledge, broadcast_rows=broadcast_rows, block_values=4).collect()
    assert sorted((r.id, r["rank"] or 0, r.match_id, r.distance) for r in found if r["rank"]) == [(1, 1, 1, 1.0), (1, 2, 2, 18.0)]
    assert sorted(r.id for r in found if not r["rank"]) == [2, 3, 4, 5, 6]


def test_versions_end_with_their_pointer(spark, table, tmp_path):
    path = str(tmp_path / "v")
    with pytest.raises(ValueError, match="nothing complete"):
        refresh.load_version(spark, path)
    refresh.save_version(table("a int", [(1,), (2,)]), path, 1)
    refresh.save_version(table("a int", []), path, 2)
    assert refresh.load_version(spark, path).count() == 0 and refresh.load_version(spark, path, 1).count() == 2
    table("a int", [(3,)]).write.parquet(f"{path}/version=3")
    assert refresh.load_version(spark, path).count() == 0


def test_incident_contract(spark, table):
    from perigee.operators import features as fx
    from perigee.sources import dims

    schema = "id int, class_name string, confidence string, tactic_id string, technique_id string, action string, tool_function string, guardrail_note string, autonomous string"
    good = ("Normal", "0.5", "N/A", "NORMAL", "log_only", "f", "", "true")
    rows = [good, (None, *good[1:]), ("Normal", "high", *good[2:]), ("Normal", "NaN", *good[2:]), ("Normal", "1.01", *good[2:]), ("Normal", "-0.1", *good[2:]),
            ("Flare", *good[1:]), (*good[:7], "perhaps"), ("Flare", "2", None, *good[3:])]
    checked = fx.incident_contract(table(schema, [(i, *r) for i, r in enumerate(rows)]), dims.classes(spark))
    found = {r.id: r.contract_error for r in checked.collect()}
    typed = "missing or of another type: "
    assert found == {
        0: None, 1: typed + "class_name", 2: typed + "confidence", 3: typed + "confidence", 4: "confidence outside 0 to 1",
        5: "confidence outside 0 to 1", 6: "unknown class: Flare", 7: typed + "autonomous", 8: typed + "tactic_id",
    }
    ready = fx.valid_incidents(checked)
    assert dict(ready.dtypes)["confidence"] == "double" and dict(ready.dtypes)["autonomous"] == "boolean" and ready.count() == 1
    absent = fx.incident_contract(table("id int", [(1,)]), dims.classes(spark)).first().contract_error
    assert absent == typed + ",".join(fx.INCIDENT_FIELDS)


def test_blocks_are_written_once_and_not_dealt_to_their_pairs(table):
    draw = np.random.default_rng(4)
    rows = table("id long, type string, embedding array<double>", [(i, "incident", draw.standard_normal(4).tolist()) for i in range(300)])
    found = similarity.similar_incidents(rows, rows, broadcast_rows=0, block_values=4 * 20, keep_unmatched=False)
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" in plan and "FlatMapGroupsInArrow" not in plan
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, similarity.similar_incidents(rows, rows, keep_unmatched=False).collect()))


def test_repeated_rows_in_blocks_are_found_as_often(table):
    draw = np.random.default_rng(6)
    once = [(i, "incident", draw.standard_normal(4).tolist()) for i in range(60)]
    rows, asked = table("id long, type string, embedding array<double>", once + once[:20]), table("id long, embedding array<double>", [r[::2] for r in once])
    both = [sorted(map(tuple, similarity.similar_incidents(asked, rows, broadcast_rows=n, block_values=4 * 9).collect())) for n in (0, 1_000)]
    assert both[0] == both[1]


def test_distances_held_at_once_are_bounded(monkeypatch):
    draw = np.random.default_rng(4)
    queries, base = draw.standard_normal((300, 4)), draw.standard_normal((700, 4))
    expected = similarity._nearest(queries, base, 3, "l2sq")
    sizes, rough = [], similarity._rough
    monkeypatch.setattr(similarity, "DISTANCES_AT_ONCE", 5_000)
    monkeypatch.setattr(similarity, "_rough", lambda q, b, metric: sizes.append(len(q) * len(b)) or rough(q, b, metric))
    assert all((a == b).all() for a, b in zip(similarity._nearest(queries, base, 3, "l2sq"), expected))
    assert max(sizes) <= 5_000
