"""Nearest incidents of many query vectors.

The distance is squared L2 by default; inner product and cosine distances may be asked for.  A
knowledge base below a checked size is sent to every task.  A larger one meets the queries in a
grid of blocks of bounded size: each side is written once in blocks, every pair of blocks is
searched, and a task hands on the k best over all its pairs.  Both ways
rank by one kernel whose sums do not depend on how rows were cut, so they give equal results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee import fixed_values as fv
from perigee.session import materialize

BROADCAST_ROWS = 50_000
BROADCAST_VALUES = 8_000_000
# Values of one side of a block: 8 MB of doubles.
BLOCK_VALUES = 1_000_000
METRICS = ("l2sq", "ip", "cosine")
QUERIES_AT_ONCE = 256
# Distances held at once: 8 MB of doubles, of which the kernel holds a handful.
DISTANCES_AT_ONCE = 1_000_000
# Candidates that a task gathers for a block of queries before it keeps the best.
CANDIDATES_AT_ONCE = 1_000_000


def _exact(queries: np.ndarray, base: np.ndarray, metric: str) -> np.ndarray:
    """Distance of each row pair, summed along the row in one fixed order."""
    if metric == "l2sq":
        return ((queries - base) ** 2).sum(axis=1)
    products = (queries * base).sum(axis=1)
    if metric == "ip":
        return 1.0 - products
    norms = np.sqrt((queries * queries).sum(axis=1)) * np.sqrt((base * base).sum(axis=1))
    return 1.0 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0)


def _rough(queries: np.ndarray, base: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Distances by one matrix product, and how far each may be from the exact one."""
    products = queries @ base.T
    a, b = (queries * queries).sum(1)[:, None], (base * base).sum(1)[None, :]
    if metric == "l2sq":
        return a + b - 2 * products, 1e-9 * (a + b)
    if metric == "ip":
        return 1.0 - products, 1e-9 * (1.0 + np.sqrt(a * b))
    norms = np.sqrt(a * b)
    return 1.0 - np.divide(products, norms, out=np.zeros_like(products), where=norms > 0), np.full_like(products, 1e-9)


def _nearest(queries: np.ndarray, base: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, base row, distance) of the k nearest of each query, nearest first; earlier base rows win ties.

    A matrix product picks a few rows more than k, exact sums rank them.
    """
    found = [], [], []
    k = min(k, len(base))
    step = max(1, min(QUERIES_AT_ONCE, DISTANCES_AT_ONCE // max(1, len(base))))
    for at in range(0, len(queries) if k else 0, step):
        part = queries[at : at + step]
        rough, slack = _rough(part, base, metric)
        bound = np.partition(rough + slack, k - 1, axis=1)[:, k - 1 : k]
        q, b = np.nonzero(rough - slack <= bound)
        exact = _exact(part[q], base[b], metric)
        order = np.lexsort((b, exact, q))
        q, b, exact = q[order], b[order], exact[order]
        best = np.arange(len(q)) - np.searchsorted(q, q) < k
        for out, values in zip(found, (q[best] + at, b[best], exact[best])):
            out.append(values)
    kinds = (np.int64, np.int64, np.float64)
    return tuple(np.concatenate(out) if out else np.zeros(0, kind) for out, kind in zip(found, kinds))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _finite(vector: str) -> Column:
    """Whether a vector is there and holds finite numbers only."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(whole & (F.size(vector) > 0), F.lit(False))


def _prepared(df: DataFrame, id_column: str, vector: str, name: str) -> DataFrame:
    return df.select(F.col(id_column).alias(name), F.col(vector).cast("array<double>").alias("v"))


def commonest_width(base: DataFrame) -> tuple[int, int]:
    """Length of the most vectors (the longer one of a tie) and their number."""
    # One row at most, whatever lengths there are.
    size = base.groupBy(F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("width")).limit(1).collect()
    return (size[0]["width"], size[0]["rows"]) if size else (0, 0)


def similar_incidents(
    queries: DataFrame,
    knowledge: DataFrame,
    query_id: str = "id",
    query_vector: str = "embedding",
    base_id: str = "id",
    base_vector: str = "embedding",
    doc_type: str | None = "incident",
    k: int = fv.SIMILAR_INCIDENTS,
    metric: str = "l2sq",
    broadcast_rows: int = BROADCAST_ROWS,
    block_values: int = BLOCK_VALUES,
    keep_unmatched: bool = True,
) -> DataFrame:
    """``(query_id, rank, match_id, distance)``: the k nearest documents of each query.

    Only whole vectors meet: those with the commonest length among the documents (the longer one of a tie), without NULL or non-finite
    values.  Other documents are never found; a query without such a vector comes out once with NULLs, unless ``keep_unmatched`` is off.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    base = knowledge.where(F.col("type") == doc_type) if doc_type is not None else knowledge
    base = _prepared(base, base_id, base_vector, "b").where(_finite("v"))
    asked = _prepared(queries, query_id, query_vector, "q")
    width, rows = commonest_width(base)
    fits = rows <= broadcast_rows and rows * width <= BROADCAST_VALUES
    base = base.where(F.size("v") == width)
    whole = _finite("v") & (F.size("v") == width)
    with_vector = asked.where(whole)
    if fits:
        found = _by_broadcast(with_vector, base, k, metric)
    else:
        found = _by_blocks(with_vector, base, k, metric, max(1, block_values // max(1, width)))
    found = found.select(F.col("q").alias(query_id), "rank", F.col("b").alias("match_id"), "distance")
    if not keep_unmatched:
        return found
    unmatched = asked.where(~F.coalesce(whole, F.lit(False)) if rows else F.col("v").isNull()).select(F.col("q").alias(query_id))
    return found.unionByName(unmatched, allowMissingColumns=True)


def _by_broadcast(asked: DataFrame, base: DataFrame, k: int, metric: str) -> DataFrame:
    """``base`` is below a checked size."""
    rows = base.orderBy("b").toArrow()
    shared = asked.sparkSession.sparkContext.broadcast((rows["b"].combine_chunks(), _matrix(rows["v"])))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = shared.value
        for batch in batches:
            q, b, distance = _nearest(_matrix(batch.column("v")), vectors, k, metric)
            rank = (np.arange(len(q)) - np.searchsorted(q, q) + 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("q").take(pa.array(q)), pa.array(rank), ids.take(pa.array(b)), pa.array(distance)],
                ["q", "rank", "b", "distance"],
            )

    schema = T.StructType([
        T.StructField("q", asked.schema["q"].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField("b", base.schema["b"].dataType), T.StructField("distance", T.DoubleType()),
    ])
    return asked.mapInArrow(nearest, schema)


def _numbered(count: int | Column) -> Column:
    """One row per number below ``count``."""
    count = F.lit(count) if isinstance(count, int) else count
    return F.explode(F.sequence(F.lit(0).cast("long"), (count - 1).cast("long")))


def in_blocks(df: DataFrame, name: str, blocks: int, *within: str, by: Column | None = None) -> DataFrame:
    """``df`` dealt by the hash of ``name``, or by ``by``, into ``blocks`` rows, ``(block, rows)``; written, so that many tasks read it and none shuffles it again.

    ``rows`` holds (within..., name, v) in that order.
    """
    pieces = max(1, min(blocks, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = df.withColumn("block", F.pmod(F.xxhash64(name) if by is None else by, F.lit(blocks))).repartition(pieces, "block")
    return materialize(dealt.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*within, name, "v"))).alias("rows")), "blocks")


def crossed(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """Every block of questions beside every block of documents: (j, questions, documents), the pairs of a j in a row in each task."""
    right = documents.select(F.col("rows").alias("documents")).hint("shuffle_replicate_nl")
    return questions.select(F.col("block").alias("j"), F.col("rows").alias("questions")).crossJoin(right)


def best_of_pairs(batches: Iterator[pa.RecordBatch], k: int, near: Callable, once: bool = False) -> Iterator[pa.RecordBatch]:
    """The ``k`` best (q, b, distance) of each question over all pairs of a task; ties to the smaller b.

    ``near(j, questions, documents)`` gives (question row, document row, distance) of one pair.  With ``once`` a document found
    twice by a question counts once.
    """
    held, now, ids = [], None, None

    def best() -> pa.Table:
        table = pa.concat_tables(held).sort_by([("at", "ascending"), ("distance", "ascending"), ("b", "ascending")])
        if once and table.num_rows > 1:
            here, before = table.slice(1), table.slice(0, table.num_rows - 1)
            same = [pa.compute.equal(here[name], before[name]).to_numpy() for name in ("at", "b", "distance")]
            table = table.filter(pa.array(np.append(True, ~np.logical_and.reduce(same))))
        at = table["at"].to_numpy()
        return table.filter(pa.array(np.arange(len(at)) - np.searchsorted(at, at) < k))

    def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from pa.table({"q": ids.take(table["at"]), "b": table["b"], "distance": table["distance"]}).to_batches()

    for batch in batches:
        for j, questions, documents in zip(batch.column("j").to_pylist(), batch.column("questions"), batch.column("documents")):
            if held and j != now:
                yield from told(best())
                held = []
            questions, documents = questions.values, documents.values
            now, ids = j, questions.field("q")
            q, b, distance = near(j, questions, documents)
            held.append(pa.table({"at": pa.array(q), "b": documents.field("b").take(pa.array(b)), "distance": pa.array(distance)}))
            if sum(len(part) for part in held) > CANDIDATES_AT_ONCE:
                held = [best()]
    if held:
        yield from told(best())


def found_schema(q: T.DataType, b: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("q", q), T.StructField("b", b), T.StructField("distance", T.DoubleType())])


def _by_blocks(asked: DataFrame, base: DataFrame, k: int, metric: str, block_rows: int) -> DataFrame:
    """Every block of queries meets every block of documents.

    A task takes some blocks of either side as they were written and hands on ``k`` rows a query, whatever the number of its pairs.
    """
    questions = in_blocks(asked, "q", max(1, -(-asked.count() // block_rows)))
    documents = in_blocks(base, "b", max(1, -(-base.count() // block_rows)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return best_of_pairs(batches, k, lambda j, q, b: _nearest(_matrix(q.field("v")), _matrix(b.field("v")), k, metric))

    found = crossed(questions, documents).mapInArrow(search, found_schema(asked.schema["q"].dataType, base.schema["b"].dataType))
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "b"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("q", "rank", "b", "distance")
