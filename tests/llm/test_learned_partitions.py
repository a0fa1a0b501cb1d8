"""Learned partitions against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from perigee.llm import learned_partitions as lp
from perigee.llm.queries import op1_learned_partitions

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, x string, part int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def brute(ids, vectors, query, k):
    exact = np.array([float((np.float64(v) * np.float64(query[1])).sum()) for v in vectors])
    order = sorted((-s, i) for i, s in zip(ids, exact) if i != query[0])[:k]
    return [(i, -s) for s, i in order]


def test_the_number_of_partitions_follows_the_data():
    assert [lp.partitions_for(n) for n in (0, 1, 63, 64, 500, 2000, 51_282, 10**6, 10**9)] == [1, 1, 1, 2, 8, 8, 12, 244, 256]


def test_recall_on_the_given_table(spark, monkeypatch):
    fitted = []
    fit = lp.fit
    monkeypatch.setattr(lp, "fit", lambda *given: fitted.append(fit(*given)) or fitted[-1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    ids, vectors = zip(*rows)
    found = {}
    for r in op1_learned_partitions(spark, SF).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    for q in rows:
        if q[0] % 20 == 0:
            want = brute(ids, vectors, q, 20)
            got = sorted(found[q[0]])
            assert [g[0] for g in got] == list(range(1, 21))
            hit += len({w[0] for w in want} & {g[1] for g in got})
            total += 20
    print("probes", fitted[0].probes, "of", len(fitted[0].bias), "recall", hit / total)
    assert hit / total >= 0.9 and len(fitted[0].bias) == 8


def test_several_partitions_and_blocks(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(0, 1, (12, 16))
    vectors = (centres[rng.integers(0, 12, 3000)] + rng.normal(0, 0.15, (3000, 16))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    found = lp.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, 10, sample_rows=800, part_rows=150, block_rows=64).collect()
    by = {}
    for r in found:
        by.setdefault(r.query_id, {})[r.vec_id] = r.score
    hit = 0
    for q in range(0, 3000, 50):
        want = brute(range(3000), vectors, (q, vectors[q]), 10)
        assert len(by[q]) == 10
        hit += sum(i in by[q] and by[q][i] == pytest.approx(s, abs=1e-12) for i, s in want)
    assert hit / 600 >= 0.9


def test_small_partitions_are_searched_on(spark, monkeypatch):
    # One probe, and the partitions hold 3, 4 and 90 vectors: a query in a small one goes on until there are 20 others.
    monkeypatch.setattr(lp, "fit", lambda sampled, parts, recall: lp.Router(np.eye(3), np.zeros(3), 1.0, 1))
    at = [0] * 3 + [1] * 4 + [2] * 90
    rows = [(i, [float(a == p) + 0.001 * i * (a != p) for a in range(3)]) for i, p in enumerate(at)]
    found = lp.nearest(table(spark, rows), F.col("vec_id").isin(0, 5, 50), 20).collect()
    for q in (0, 5, 50):
        assert sorted(r["rank"] for r in found if r.query_id == q) == list(range(1, 21))


def test_router_is_balanced_and_uses_few_probes_on_clusters():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (8, 12))
    x = centres[rng.integers(0, 8, 1600)] + rng.normal(0, 0.1, (1600, 12))
    near = lp._nearest(x, 10)
    labels = lp.balanced_partition(near, lp._bisected(x, 8), 8)
    sizes = np.bincount(labels, minlength=8)
    assert sizes.max() <= 1.06 * 200 and sizes.min() >= 0.9 * 200
    assert lp.fit(x, 8).probes <= 4


def test_odd_vectors_take_no_part_and_ties_go_to_smaller_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.0]), (40, None), (60, [0.0, 0.0]), (80, [nan, 1.0]),
            (100, [inf, 1.0]), (120, [None, 1.0]), (140, [1.0]), (None, [9.0, 9.0]), (20, [1.0, 0.0])]
    found = lp.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, 20).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(20, 1, 1.0), (20, 2, 1.0), (20, 3, 0.5)]


def test_a_crowd_of_equal_vectors(spark):
    rows = [(i, [3.0, 4.0]) for i in range(500)] + [(1000 + i, [4.0, float(i)]) for i in range(5)]
    found = lp.nearest(table(spark, rows), F.col("vec_id") % 100 == 0, 5, block_rows=8).collect()
    for q in (0, 100, 400):
        got = [r.vec_id for r in sorted(found, key=lambda r: r["rank"]) if r.query_id == q]
        want = [i for i, _ in brute([r[0] for r in rows], [r[1] for r in rows], (q, [3.0, 4.0]), 5)]
        assert got == want


def test_empty_table(spark):
    assert lp.nearest(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert lp.nearest(table(spark, [(20, [1.0])]), F.col("vec_id") % 20 == 0).count() == 0
