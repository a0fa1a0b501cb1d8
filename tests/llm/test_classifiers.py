"""Toxicity and quality on small labelled texts and, held out, on a given table."""

import random
import zlib

import numpy as np
import pytest
from conftest_llm import words
from pyspark.sql import functions as F

from perigee.llm import quality, toxicity
from perigee.llm.queries import _held_out, op7_toxicity, op8_quality

SF = "/root/testdata/sf0.01"


def auc(pairs):
    good = [s for s, y in pairs if y == 1]
    bad = [s for s, y in pairs if y == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def labelled(spark, documents, junk):
    rng = random.Random(1)
    texts, marks = [], []
    for i in range(240):
        mark = int(i % 4 == 0)
        base = words(rng, rng.randrange(5, 150)).split()
        texts.append(junk(base, rng) if mark else " ".join(base))
        marks.append(mark)
    docs = documents([*enumerate(texts), (900, None), (901, ""), (902, "x" * 300_000)])
    labels = spark.createDataFrame([*enumerate(marks), (900, 1), (5000, 1), (None, 1), (3, None)], "doc_id long, mark int")
    return docs, labels


def test_toxicity_learns_and_scores_every_row(spark, documents):
    docs, labels = labelled(spark, documents, lambda w, rng: " ".join([*w, rng.choice(["scumbag", "you IDIOT"]), *w[:3]]))
    model = toxicity.fit(docs, labels.withColumnRenamed("mark", "toxic").where("doc_id % 3 != 2 OR doc_id IS NULL"))
    rows = {r.doc_id: r.s for r in docs.select("doc_id", model.score(spark, F.col("text")).alias("s")).collect()}
    assert len(rows) == 243 and all(0 <= s <= 1 for s in rows.values())
    held = [(rows[i], int(i % 4 == 0)) for i in range(240) if i % 3 == 2]
    assert auc(held) > 0.95
    again = toxicity.fit(docs, labels.withColumnRenamed("mark", "toxic").where("doc_id % 3 != 2 OR doc_id IS NULL"))
    assert np.allclose(again.weights, model.weights)


@pytest.mark.parametrize("marks, share", [([], 0.5), ([1, 1], 1.0), ([0, 0], 0.0)])
def test_one_class_or_none(spark, documents, marks, share):
    docs = documents([(0, "a b"), (1, "c d")])
    labels = spark.createDataFrame(list(enumerate(marks)), "doc_id long, toxic int")
    scored = docs.select(toxicity.fit(docs, labels).score(spark, F.col("text")).alias("s")).collect()
    assert all(abs(r.s - share) < 1e-6 for r in scored)
    rows = docs.select("doc_id", quality.statistics(F.col("text")).alias("x"))
    model = quality.fit(rows.join(labels.withColumnRenamed("toxic", "label"), "doc_id"))
    assert all(abs(r.s - share) < 1e-6 for r in rows.select(model.score(F.col("x")).alias("s")).collect())


def test_labels_without_a_text_use_up_no_places(spark, documents):
    docs = documents([(i, "vile words here" if i % 2 else "kind words there") for i in range(20)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, max_per_class=10)
    assert np.count_nonzero(model.weights)
    scores = {r.doc_id: r.s for r in docs.select("doc_id", model.score(spark, F.col("text")).alias("s")).collect()}
    assert min(scores[i] for i in range(1, 20, 2)) > max(scores[i] for i in range(0, 20, 2))


def test_quality_learns_and_scores_every_row(spark, documents):
    docs, labels = labelled(spark, documents, lambda w, rng: rng.choice([" | ".join(w), "&&& ".join(w), " ".join(x for x in w for _ in "abc")]))
    rows = docs.select("doc_id", quality.statistics(F.col("text")).alias("x"))
    good = labels.select("doc_id", (1 - F.col("mark")).alias("label"))
    model = quality.fit(rows.join(good.where("doc_id % 3 != 2"), "doc_id"))
    scores = {r.doc_id: r.s for r in rows.select("doc_id", model.score(F.col("x")).alias("s")).collect()}
    assert len(scores) == 243 and all(0 <= s <= 1 for s in scores.values())
    assert auc([(scores[i], int(i % 4 != 0)) for i in range(240) if i % 3 == 2]) > 0.95


def test_quality_score_is_the_difference_of_normal_log_densities(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (80, 14)), rng.normal(1, 2, (120, 14))])
    y = [0] * 80 + [1] * 120
    table = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y)], "x array<double>, label int")
    model = quality.fit(table)
    logit = np.full(len(x), np.log(120 / 80))
    for c, sign in ((0, -1), (1, 1)):
        mean, inverse = model.classes[c]
        assert np.allclose(mean, x[np.array(y) == c].mean(0))
        cov = np.linalg.inv(inverse.T @ inverse)
        gap = x - mean
        logit += sign * (-0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", gap, np.linalg.inv(cov), gap))
    got = [r.s for r in table.select(model.score(F.col("x")).alias("s")).collect()]
    assert np.allclose(got, 1 / (1 + np.exp(-np.clip(logit, -30, 30))))


@pytest.mark.parametrize("query, label, least", [(op7_toxicity, "toxic", 0.75), (op8_quality, "quality", 0.9)])
def test_held_out_rows_of_a_given_table(spark, query, label, least):
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", label)
    found = query(spark, SF)
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = found.where("held_out").join(labels, "doc_id").collect()
    assert auc([(r.score, r[label]) for r in rows]) > least


def test_empty_tables(spark, documents):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(documents([]), labels)
    assert documents([]).select(model.score(spark, F.col("text"))).count() == 0
    assert documents([]).select(quality.statistics(F.col("text"))).count() == 0


def test_rows_without_id_are_not_held_out(spark):
    rows = spark.createDataFrame([(None,), (1,), (2,), (3,), (4,)], "doc_id long").select("doc_id", _held_out(4, 2))
    assert {r.doc_id: r.held_out for r in rows.collect()} == {None: False, **{i: zlib.crc32(str(i).encode()) % 4 == 2 for i in (1, 2, 3, 4)}}
