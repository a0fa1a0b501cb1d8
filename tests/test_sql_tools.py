"""SQL functions against the DataFrame plan, the scored forest and the exact search."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.functions import sql, sql_tools
from perigee.operators import models, similarity
from perigee.plans.triage import triage

NAMES = ["a", "b"]
STATS = {"a": (0.0, 1.0), "b": (1.5, 2.0)}


@pytest.fixture(scope="module")
def windows(spark):
    rows = [(i, f"2024-05-01 10:00:{i % 60:02d}", math.sin(i) * 4, math.cos(3 * i) * 9, i % 5) for i in range(300)]
    rows += [(900, "2024-05-01 11:00:00", None, 9.0, 0), (901, None, float("nan"), 30.0, 1), (902, "2024-05-01 11:00:00", None, None, 2)]
    return spark.createDataFrame(rows, "seq long, t string, a double, b double, Label int").withColumn("ts", F.to_timestamp("t")).drop("t")


@pytest.fixture(scope="module")
def forest(windows):
    return models.train_classifier(windows.where("seq < 900"), NAMES, trees=7, depth=4)


def test_classify_equals_the_scored_forest(spark, windows, forest):
    sql_tools.register_classifier(spark, forest, NAMES)
    windows.createOrReplaceTempView("sql_windows")
    got = {r.seq: tuple(r.c) for r in spark.sql("SELECT seq, classify(a, b) AS c FROM sql_windows").collect()}
    from perigee.sources import dims
    expected = {r.seq: (r.predicted_label, r.class_name, r.confidence) for r in models.score(windows, forest, dims.classes(spark)).collect()}
    assert got == expected and len(got) == 303


def test_one_statement_from_gate_to_record(spark, windows, forest):
    sql.register(spark, STATS, NAMES, 1.0, 1)
    sql_tools.register_classifier(spark, forest, NAMES)
    sql_tools.register_record(spark, STATS, NAMES)
    windows.createOrReplaceTempView("sql_windows")
    got = spark.sql(
        "SELECT seq, assemble_record(seq, ts, c.predicted_label, c.class_name, c.confidence, a, b) AS record "
        "FROM (SELECT *, classify(a, b) AS c FROM sql_windows WHERE check_escalation(a, b))"
    )
    plan = triage(windows, STATS, NAMES, forest, z_threshold=1.0, min_features=1)
    text = F.to_json("record", {"ignoreNullFields": "false"}).alias("record")
    mine = {r.seq: r.record for r in got.select("seq", text).collect()}
    assert mine == {r.seq: r.record for r in plan.select("seq", text).collect()}
    assert 100 < len(mine) < 303 and 901 in mine and 902 not in mine


@pytest.mark.parametrize("class_name", ["Normal", "Data Injection", "No Such Class", None])
@pytest.mark.parametrize("confidence", [0.3, 0.7, 0.84, 0.95, None])
def test_record_of_any_class_and_confidence(spark, class_name, confidence):
    from perigee.functions.incident import false_positive_risk
    sql.register(spark, STATS, NAMES)
    sql_tools.register_record(spark, STATS, NAMES)
    row = spark.createDataFrame([(class_name, confidence)], "class_name string, confidence double")
    row.createOrReplaceTempView("one_class")
    got = spark.sql("SELECT assemble_record('7', TIMESTAMP'2024-01-01', 1, class_name, confidence, 3D, 4D) AS r FROM one_class").first().r
    assert tuple(got.false_positive_risk) == tuple(row.select(false_positive_risk("class_name", "confidence").alias("r")).first().r)
    assert [d.feature_name for d in got.shap_drivers] == ["a", "b"]


def test_search_equals_the_exact_operator(spark, table):
    rows = [(i, "incident" if i % 3 else "note", [math.sin(i * j) for j in range(1, 5)]) for i in range(60)]
    rows += [(70, "incident", [1.0]), (71, "incident", None), (72, "incident", [float("nan")] * 4), (73, "incident", [0.0, None, 0.0, 0.0])]
    rows += [(80, "incident", rows[5][2])]
    docs = table("id long, type string, embedding array<double>", rows)
    sql_tools.register_search(spark, docs, k=3)
    for at in (4, 5, 9):
        vector = ", ".join(f"{x!r}D" for x in rows[at][2])
        got = [tuple(r) for r in spark.sql(f"SELECT * FROM search_incidents(array({vector})) ORDER BY rank").collect()]
        exact = similarity.similar_incidents(docs.where(f"id = {at}"), docs, k=3).orderBy("rank").collect()
        assert [(r, i) for r, i, _ in got] == [(r.rank, r.match_id) for r in exact]
        assert [d for _, _, d in got] == pytest.approx([r.distance for r in exact])
    assert spark.sql("SELECT * FROM search_incidents(CAST(NULL AS ARRAY<DOUBLE>))").count() == 0
    assert spark.sql("SELECT * FROM search_incidents(array(1D, 2D))").count() == 0


def test_all_rows_reach_their_leaves_in_as_many_steps_as_a_tree_is_deep(spark, forest):
    trees = sql_tools.forest_arrays(spark, forest)
    for (feature, threshold, children, shares, depth), tree in zip(trees, forest.stages[-1].trees, strict=True):
        assert depth == tree.depth <= 4 and len(children) == 2 * tree.numNodes
        leaves = [at for at in range(tree.numNodes) if children[2 * at] == at]
        assert len(leaves) == (tree.numNodes + 1) // 2 and all(children[2 * at + 1] == at for at in leaves)
    from pyspark.ml.linalg import Vectors
    rows = [[math.sin(i) * 4, math.cos(3 * i) * 9] for i in range(40)] + [[math.nan, 1.0], [math.inf, -math.inf], [0.0, math.nan]]
    got = sql_tools.forest_shares(trees, np.array(rows))
    expected = [forest.stages[-1].predictProbability(Vectors.dense(row)).toArray() for row in rows]
    assert np.allclose(got, expected, rtol=0, atol=1e-15) and sql_tools.forest_shares(trees, np.empty((0, 2))).shape == got[:0].shape
