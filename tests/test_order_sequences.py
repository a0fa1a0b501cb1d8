import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.operators import order, sequences


def test_dense_index_counts_in_order(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 100003).alias("k"))
    got = order.with_dense_index(df, ["k"], partitions=7).orderBy("k").collect()
    assert [r.idx for r in got] == list(range(5000))


def test_dense_index_with_most_rows_on_one_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id")
    got = order.with_dense_index(df, ["k", "id"], partitions=5).orderBy("idx").collect()
    assert [r.idx for r in got] == list(range(3000))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)


def test_replay_order(spark):
    df = spark.range(300).withColumnRenamed("id", "seq")
    first = {r.seq: r.position for r in order.replay_order(df, "shuffled", seed=1).collect()}
    again = {r.seq: r.position for r in order.replay_order(df.repartition(5), "shuffled", seed=1).collect()}
    other = {r.seq: r.position for r in order.replay_order(df, "shuffled", seed=2).collect()}
    assert sorted(first.values()) == list(range(300)) and first == again and first != other
    straight = order.replay_order(df.repartition(3), "sequential").collect()
    assert all(r.seq == r.position for r in straight)
    with pytest.raises(ValueError):
        order.replay_order(df, "backwards")


def shapes():
    rng = random.Random(3)
    yield "uniform", [rng.random() for _ in range(3000)]
    yield "heavy tail", [math.exp(rng.gauss(0, 30)) for _ in range(3000)]
    yield "third on one value", [7.0 if i % 3 == 0 else rng.gauss(7, 1) for i in range(3000)]
    yield "two ends", [0.0] * 1400 + [1.0] * 1400 + [rng.random() for _ in range(200)]
    yield "few values", [float(rng.randrange(3)) for _ in range(3000)]
    yield "signs", [rng.choice([-1, 1]) * rng.random() * 10 ** rng.randrange(-200, 200) for _ in range(3000)]


@pytest.mark.parametrize("name,values", list(shapes()), ids=[n for n, _ in shapes()])
def test_order_statistics_narrow_down_to_exact_values(table, name, values):
    df = table("g long, v double", [(1, v) for v in values] + [(2, v + 1) for v in values[:50]])
    ranks = [0, 1, 749, 1500, 2998, 2999]
    found = order.order_statistics(df, "v", {1: ranks, 2: [25]}, "g", rank_limit=20)
    expected = sorted(values)
    assert {r: found[(1, r)] for r in ranks} == {r: expected[r] for r in ranks}
    assert found[(2, 25)] == sorted(v + 1 for v in values[:50])[25]


def test_order_statistics_reject_a_rank_beyond_the_group(table):
    with pytest.raises(ValueError):
        order.order_statistics(table("g long, v double", [(1, 1.0)]), "v", {1: [1]}, "g")


def test_percentiles_interpolate(table):
    values = [1.0, 2.0, 3.0, 5.0, 8.0]
    df = table("g int, v double", [(0, v) for v in values] + [(1, math.nan), (1, 2.0), (2, None), (None, 3.0), (3, 4.0)])
    got = order.exact_percentiles(df, "v", [0.95, 0.5], "g")
    assert got[0] == [pytest.approx(float(np.percentile(values, 95))), 3.0]
    assert math.isnan(got[1][0]) and 2 not in got and got[3] == [4.0, 4.0]


def test_representative_row_at_a_third(table):
    rows = [(100 - i, 0) for i in range(10)] + [(i, 1) for i in range(200, 202)] + [(500, 2), (7, None)]
    df = table("seq long, Label int", rows)
    got = {r.Label: r.seq for r in order.representative_rows(df).collect()}
    assert got == {0: 94, 1: 200, 2: 500}
    assert {r.Label: r.seq for r in order.representative_rows(df, rank_limit=2).collect()} == got


def test_representative_rows_of_many_groups(spark):
    df = spark.range(1000).select(F.col("id").alias("seq"), (F.col("id") % 70).cast("string").alias("Label"))
    got = {r.Label: r.seq for r in order.representative_rows(df).collect()}
    expected = {str(g): list(range(g, 1000, 70)) for g in range(70)}
    assert got == {g: rows[len(rows) // 3] for g, rows in expected.items()}


def test_heads_and_tails(spark):
    df = spark.range(500).select(F.col("id").alias("seq"), (F.col("id") * 2.0).alias("MsgLength"))
    assert sorted(r.seq for r in order.last_rows(df, 200).collect()) == list(range(300, 500))
    newest = order.newest_first(df).orderBy("rank").collect()
    assert [r.seq for r in newest] == list(range(499, 479, -1))
    assert [r.seq for r in order.first_rows(df, 8).collect()] == list(range(8))
    assert order.last_rows(df.limit(5), 200).count() == 5


def test_history_has_one_point_per_step(spark):
    df = spark.range(2000).select(
        F.greatest(F.col("id") - 1000, F.lit(0)).alias("seq"), F.col("id").cast("double").alias("MsgLength"))
    got = order.metric_history(df, ["MsgLength", "absent"])
    assert got.columns == ["seq", "MsgLength"] and sorted(r.seq for r in got.collect()) == list(range(700, 1000))
    hot = spark.range(2000).select(
        F.least(F.col("id"), F.lit(400)).alias("seq"), F.col("id").cast("double").alias("MsgLength"))
    assert sorted(r.seq for r in order.metric_history(hot, ["MsgLength"]).collect()) == list(range(101, 401))
    assert order.metric_history(hot, ["MsgLength"]).where("seq = 400").first().MsgLength == 400.0
    assert order.metric_history(df.where("seq < 0"), ["MsgLength"]).count() == 0


def rows(spark, n):
    return spark.range(n).select(
        F.col("id").alias("idx"), (F.col("id") % 4).cast("int").alias("Label"),
        F.col("id").cast("double").alias("a"), (-F.col("id")).cast("double").alias("b"))


@pytest.mark.parametrize("n,labelled,unlabelled", [(9, 0, 0), (10, 0, 1), (11, 1, 2), (25, 15, 16)])
def test_sequence_counts(spark, n, labelled, unlabelled):
    df = rows(spark, n)
    assert sequences.labelled_sequences(df, ["a"], "idx").count() == labelled
    assert sequences.sequences(df, ["a"], "idx").count() == unlabelled


@pytest.mark.parametrize("bucket_rows", [10, 11, 64, 4096])
def test_sequences_across_bucket_edges(spark, bucket_rows):
    df = rows(spark, 137).repartition(6)
    got = {r.idx: (r.Label, r.steps) for r in
           sequences.labelled_sequences(df, ["a", "b"], "idx", bucket_rows=bucket_rows).collect()}
    assert got == {j: (j % 4, [[float(i), -float(i)] for i in range(j - 10, j)]) for j in range(10, 137)}
    plain = {r.idx: r.steps for r in sequences.sequences(df, ["a"], "idx", bucket_rows=bucket_rows).collect()}
    assert plain == {j: [[float(i)] for i in range(j - 9, j + 1)] for j in range(9, 137)}


def test_bucket_smaller_than_a_sequence_is_refused(spark):
    with pytest.raises(ValueError):
        sequences.sequences(rows(spark, 5), ["a"], "idx", bucket_rows=5)


def test_gaps_in_the_index_are_noticed(spark):
    sequences.require_dense(rows(spark, 5), "idx")
    sequences.require_dense(rows(spark, 0), "idx")
    with pytest.raises(ValueError):
        sequences.require_dense(rows(spark, 9).where("idx <> 4"), "idx")


def test_straddling_marks_label_changes(spark):
    df = spark.range(60).select(F.col("id").alias("idx"), F.floor(F.col("id") / 20).cast("int").alias("Label"))
    got = {r.idx: r.straddles for r in sequences.straddling(df, "idx", bucket_rows=16).collect()}
    assert got == {j: (j - 10) // 20 != (j - 1) // 20 for j in range(10, 60)}
