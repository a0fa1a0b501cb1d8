"""Approximate nearest neighbours by learned partitions.

On a sample of 4,096 rows, or 32 a partition if that is more (8,192 at most), the graph of nearest neighbours is cut into balanced partitions; a softmax
classifier then learns from a vector to which partitions its neighbours belong.  Every row is stored in its most
probable partition.  A query goes to the most probable ones, as many as reached ``recall`` on the
sample and more until these hold ``k`` vectors besides itself, and is ranked there by exact inner products.

Equal vectors are one class with its smallest ids, so a vector that a third of all rows share is
compared once.  A partition is searched in blocks of at most about ``block_rows`` vectors and as
many queries, whatever its size; a task holds one block, and each hands on its best ids only.

Defined results: vectors that are NULL, zero, or hold NULL or non-finite components take no part,
nor do rows without id or of another length than most vectors.  Rows with the query's own id are not
its candidates.  Equal scores rank by smaller id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.llm import arrays as ar
from perigee.session import materialize

SAMPLE_ROWS = 4096
PART_ROWS = 4096
LEAST_PARTS = 8
MOST_PARTS = 256
# Rows of the sample for each partition, and vectors that a small table has for each.
SAMPLE_PER_PART = 32
RECALL = 0.95
BLOCK_ROWS = 8192
NEIGHBOURS = 20
QUERY_CHUNK = 256


# --- model, from a bounded sample -------------------------------------------------


def _nearest(vectors: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest others of each row."""
    out = []
    for at in range(0, len(vectors), 128):
        scores = vectors[at : at + 128] @ vectors.T
        scores[np.arange(len(scores)), np.arange(at, at + len(scores))] = -np.inf
        out.append(np.argpartition(-scores, k - 1, axis=1)[:, :k])
    return np.concatenate(out)


def _bisected(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Balanced start: halves along the direction of largest spread, again and again."""
    labels = np.zeros(len(vectors), np.int64)
    todo = [(np.arange(len(vectors)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        if n == 1:
            labels[rows] = first
            continue
        centred = vectors[rows] - vectors[rows].mean(0)
        along = np.linalg.eigh(centred.T @ centred)[1][:, -1]
        order = rows[np.argsort(centred @ along, kind="stable")]
        left = n // 2
        cut = len(rows) * left // n
        todo += [(order[:cut], first, left), (order[cut:], first + left, n - left)]
    return labels


def balanced_partition(neighbours: np.ndarray, labels: np.ndarray, parts: int, rounds: int = 8, slack: float = 1.05) -> np.ndarray:
    """Moves vertices to where most of their neighbours are, while sizes stay within ``slack`` of the mean."""
    labels = labels.copy()
    n = len(labels)
    most, least = int(np.ceil(n / parts * slack)), int(n / parts / slack)
    sizes = np.bincount(labels, minlength=parts)
    for _ in range(rounds):
        votes = np.zeros((n, parts))
        np.add.at(votes, (np.repeat(np.arange(n), neighbours.shape[1]), labels[neighbours].ravel()), 1)
        wish = votes.argmax(1)
        gain = votes[np.arange(n), wish] - votes[np.arange(n), labels]
        moved = 0
        for v in np.argsort(-gain, kind="stable").tolist():
            if gain[v] <= 0:
                break
            a, b = labels[v], wish[v]
            if sizes[b] < most and sizes[a] > least:
                labels[v] = b
                sizes[a] -= 1
                sizes[b] += 1
                moved += 1
        if moved < n // 1000 + 1:
            break
    return labels


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class Router:
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    probes: int

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        return vectors * self.scale @ self.weights + self.bias

    def part(self, vector: Column) -> Column:
        """The most probable partition."""
        return self.route(vector, np.full(len(self.bias), 1), 1, 1)[0]

    def route(self, vector: Column, held: np.ndarray, need: int, least: int) -> Column:
        """The most probable partitions, best first: ``least`` of them, or as many as it takes to hold ``need`` vectors."""
        router = self

        def of(column: pa.Array) -> pa.Array:
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            if not len(x):
                return pa.array([], pa.list_(pa.int32()))
            best = np.argsort(-router.logits(x), axis=1, kind="stable").astype(np.int32)
            short = np.cumsum(held[best], axis=1) < need
            many = np.minimum(np.maximum(short.sum(1) + 1, least), best.shape[1])
            return ar.list_array(best[np.arange(best.shape[1]) < many[:, None]], many, pa.int32())

        return F.arrow_udf(of, "array<int>")(vector)


def fit(sample: np.ndarray, parts: int, recall: float = RECALL, steps: int = 150) -> Router:
    """Partitions the sample's neighbour graph and learns to predict the partitions of a vector's neighbours."""
    n, width = sample.shape
    scale = float(1 / max(np.sqrt((sample * sample).sum(1).mean()), 1e-300))
    k = min(NEIGHBOURS, n - 1)
    if parts < 2 or k < 1:
        return Router(np.zeros((width, 1)), np.zeros(1), scale, 1)
    near = _nearest(sample, k)
    labels = balanced_partition(near, _bisected(sample, parts), parts)
    wanted = np.zeros((n, parts))
    np.add.at(wanted, (np.repeat(np.arange(n), k), labels[near].ravel()), 0.5 / k)
    wanted[np.arange(n), labels] += 0.5
    x = sample * scale
    w, b = np.zeros((width, parts)), np.zeros(parts)
    for c in range(parts):
        if (labels == c).any():
            w[:, c] = x[labels == c].mean(0)
    rate = 4.0
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(steps):
        error = (_softmax(x @ w + b) - wanted) / n
        vw, vb = 0.9 * vw - rate * (x.T @ error + 1e-5 * w), 0.9 * vb - rate * error.sum(0)
        w, b = w + vw, b + vb
    router = Router(w, b, scale, parts)
    # A stored row lies where the classifier puts it: the probes must reach the true neighbours there.
    order = np.argsort(-router.logits(sample), axis=1, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :].repeat(n, 0), 1)
    needed = np.take_along_axis(rank, order[:, 0][near], 1)
    reached = np.cumsum(np.bincount(needed.ravel(), minlength=parts)) / needed.size
    router.probes = int(np.searchsorted(reached, recall) + 1)
    return router


# --- index and search ------------------------------------------------------------------


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, x) of the rows that take part, x in double precision; repeated rows once."""
    x = F.col(embedding).cast("array<double>")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(finite & F.exists("x", lambda v: v != 0))
    width = rows.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("x") == (width[0] if width else 0)).dropDuplicates(["vec_id", "x"])


def _search(table: pa.Table, keep: int) -> pa.Table:
    """Best ids of each query of one block, with exact scores."""
    asked = table["asked"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
    x = table["x"].combine_chunks()
    x = x.flatten().to_numpy().reshape(len(x), -1)
    cls = table["cls"].to_numpy()
    stored = np.flatnonzero(~asked)
    base, ids = x[stored], table["ids"].combine_chunks().take(pa.array(stored))
    flat, bounds = ids.flatten().to_numpy(), np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy())])
    out = [[], [], []]
    queries = np.flatnonzero(asked)
    for at in range(0, len(queries) if len(base) else 0, QUERY_CHUNK):
        rows = queries[at : at + QUERY_CHUNK]
        scores = x[rows] @ base.T
        k = min(keep, len(base))
        worst = np.partition(scores, len(base) - k, axis=1)[:, len(base) - k]
        # The product may differ in its last bits between equal pairs: rank a little more, exactly.
        slack = 1e-9 * np.maximum(1.0, np.abs(scores).max(1))
        q, c = np.nonzero(scores >= (worst - slack)[:, None])
        exact = (x[rows][q] * base[c]).sum(1)
        n = bounds[c + 1] - bounds[c]
        q, exact = np.repeat(q, n), np.repeat(exact, n)
        member = flat[np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[c], n)]
        order = np.lexsort((member, -exact, q))
        q, exact, member = q[order], exact[order], member[order]
        first = np.searchsorted(q, q)
        best = np.arange(len(q)) - first < keep
        out[0].append(cls[rows][q[best]])
        out[1].append(member[best])
        out[2].append(exact[best])
    columns = [np.concatenate(o) if o else np.zeros(0, kind) for o, kind in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table(dict(zip(("cls", "vec_id", "score"), columns)))


def partitions_for(n: int, part_rows: int = PART_ROWS) -> int:
    """One partition for ``part_rows`` of ``n`` vectors, at least LEAST_PARTS where each gets SAMPLE_PER_PART, at most MOST_PARTS."""
    return max(1, min(MOST_PARTS, max(n // part_rows, min(LEAST_PARTS, n // SAMPLE_PER_PART))))


def nearest(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, vec_id: str = "vec_id", embedding: str = "embedding",
    sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, block_rows: int = BLOCK_ROWS, recall: float = RECALL,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row with ``is_query``, a condition on ``vec_id``."""
    rows = materialize(usable(vectors, vec_id, embedding), "vectors")
    keep = k + 1
    smallest = F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))
    ids = rows.withColumn("place", smallest).where(F.col("place") <= keep).groupBy("x").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    classes = materialize(ids.withColumn("cls", F.col("ids")[0]), "vector-classes")
    queries = materialize(rows.where(is_query).join(classes, "x").select(F.col("vec_id").alias("query_id"), "cls"), "queries")

    n = classes.count()
    parts = partitions_for(n, part_rows)
    sample_rows = max(sample_rows, SAMPLE_PER_PART * parts)
    sample = classes.select("cls", "x").orderBy(F.xxhash64("cls"), "cls").limit(sample_rows).toArrow()
    if not n:
        return queries.select("query_id", F.lit(0).alias("rank"), F.col("cls").alias("vec_id"), F.lit(0.0).alias("score"))
    flat = sample["x"].combine_chunks()
    sampled = flat.flatten().to_numpy().reshape(len(flat), -1)
    router = fit(sampled, parts, recall)

    stored = materialize(classes.withColumn("part", router.part(F.col("x"))), "vector-parts")
    # At most MOST_PARTS numbers; a class counts with the ids that it hands on.
    held = np.zeros(len(router.bias), np.int64)
    for part, vectors_held in stored.groupBy("part").agg(F.sum(F.size("ids"))).collect():
        held[part] = vectors_held
    asking = queries.select("cls").distinct()
    asked = materialize(
        classes.join(asking, "cls", "left_semi").select(
            "cls", "x", F.explode(router.route(F.col("x"), held, keep, router.probes)).alias("part")), "routed-queries"
    )
    # Blocks of a partition by count: rows meet queries in a grid of bounded blocks.
    sizes = stored.groupBy("part").agg(F.count("*").alias("n")).withColumn("row_blocks", F.ceil(F.col("n") / block_rows))
    loads = asked.groupBy("part").agg(F.count("*").alias("m")).withColumn("query_blocks", F.ceil(F.col("m") / block_rows))
    grid = materialize(sizes.join(loads, "part").select("part", "row_blocks", "query_blocks"), "vector-grid")
    own = lambda blocks: F.pmod(F.xxhash64("cls"), F.col(blocks))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("long"), F.col(blocks) - 1))
    left = stored.join(grid, "part").select(
        "part", own("row_blocks").alias("i"), every("query_blocks").alias("j"), "cls", "x", "ids", F.lit(False).alias("asked"))
    right = asked.join(grid, "part").select(
        "part", every("row_blocks").alias("i"), own("query_blocks").alias("j"), "cls", "x",
        F.array().cast("array<bigint>").alias("ids"), F.lit(True).alias("asked"))
    found = left.unionByName(right).groupBy("part", "i", "j").applyInArrow(
        lambda t: _search(t, keep), "cls long, vec_id long, score double"
    )
    order = [F.desc("score"), F.asc("vec_id")]
    best = found.withColumn("place", F.row_number().over(Window.partitionBy("cls").orderBy(*order))).where(F.col("place") <= keep)
    hits = queries.join(best.drop("place"), "cls").where("vec_id != query_id")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
