"""An index for nearest incidents where the knowledge base is too large to compare everything.

Each table of the index cuts space by signs of random projections, shifted so that each halves a sample.  A query visits
its own cell and those across the planes nearest to it.  Number of tables, planes and visited cells are the cheapest that reach a recall
asked for on a sample of documents whose true neighbours are searched by the exact operator; with no planes all is one cell and the search is
exact, so the recall can always be met.  What is found is ranked by the exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from perigee import fixed_values as fv
from perigee.operators.similarity import (
    BLOCK_VALUES, METRICS, _finite, _matrix, _nearest, _numbered, _prepared, best_of_pairs, commonest_width, crossed, found_schema, in_blocks,
    similar_incidents,
)
from perigee.session import materialize

SAMPLE = 256
CELL_ROWS = 64
MOST_TABLES = 8
MOST_PLANES = 20
# A query may cross its nearest planes in any combination: 2^10 cells a table at most.
CROSSED = 10
RECALL = 0.95
# Copies of a query over all tables; more visits than these are worked out where the cells are searched.
MOST_COPIES = 16
# Queries whose visits a task holds at once: 1,024 cells a query and table at most.
PASSING_QUERIES = 1_024


@dataclass
class Index:
    """Planes of all tables, and the written documents in their cells."""

    rows: DataFrame
    base: DataFrame
    directions: np.ndarray
    offsets: np.ndarray
    visits: int
    count: int
    sample_recall: float
    metric: str

    @property
    def planes(self) -> int:
        return self.directions.shape[1]

    @property
    def share(self) -> float:
        """Expected share of all pairs that a search compares."""
        return min(1.0, len(self.directions) * self.visits / 2.0**self.planes)


def _margins(vectors: np.ndarray, directions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return vectors @ directions.T - offsets


def _codes(margins: np.ndarray) -> np.ndarray:
    return (margins > 0).astype(np.int64) @ (np.int64(1) << np.arange(margins.shape[1], dtype=np.int64))


def _visited(margins: np.ndarray, visits: int) -> np.ndarray:
    """(row, visit) cells: the row's own first, then those whose crossed planes are nearest by the sum of squared margins."""
    planes = margins.shape[1]
    own = _codes(margins)
    crossed = min(CROSSED, planes)
    nearest = np.argsort(np.abs(margins), axis=1, kind="stable")[:, :crossed]
    squared = np.take_along_axis(margins, nearest, 1) ** 2
    subsets = (np.arange(1 << crossed)[:, None] >> np.arange(crossed)) & 1
    order = np.argsort(squared @ subsets.T, axis=1, kind="stable")[:, :visits]
    flips = (np.int64(1) << nearest.astype(np.int64)) @ subsets.T.astype(np.int64)
    return own[:, None] ^ np.take_along_axis(flips, order, 1)


def _plan(sample: np.ndarray, near: list[np.ndarray], directions: np.ndarray, offsets: np.ndarray, most: int, recall: float):
    """(tables, planes, visits, recall) that reach ``recall`` on the sample at the smallest share of pairs.

    ``near`` holds the vectors of each sample row's true neighbours.
    """
    owner = np.repeat(np.arange(len(near)), [len(v) for v in near])
    best = (1.0, 1, 0, 1, 1.0)
    if not len(owner):
        return best[1:]
    found = np.concatenate([v for v in near if len(v)])
    for planes in range(1, most + 1):
        all_cells = 1 << min(CROSSED, planes)
        first = np.full((len(owner), len(directions)), all_cells, np.int64)
        for t in range(len(directions)):
            cells = _visited(_margins(sample, directions[t, :planes], offsets[t, :planes]), all_cells)
            same = cells[owner] == _codes(_margins(found, directions[t, :planes], offsets[t, :planes]))[:, None]
            first[:, t] = np.where(same.any(axis=1), same.argmax(axis=1), all_cells)
        reached = np.minimum.accumulate(first, axis=1)
        for tables in range(1, len(directions) + 1):
            needed = np.sort(reached[:, tables - 1])[int(np.ceil(recall * len(owner))) - 1]
            share = tables * (needed + 1) / 2.0**planes
            if needed < all_cells and share < best[0]:
                best = (share, tables, planes, int(needed) + 1, float((reached[:, tables - 1] <= needed).mean()))
    return best[1:]


def build_index(
    knowledge: DataFrame, base_id: str = "id", base_vector: str = "embedding", doc_type: str | None = "incident",
    k: int = fv.SIMILAR_INCIDENTS, metric: str = "l2sq", recall: float = RECALL, sample: int = SAMPLE, cell_rows: int = CELL_ROWS,
    tables: int = MOST_TABLES, seed: int = fv.SEED,
) -> Index:
    """Fits the planes on at most ``sample`` documents, drawn by the hash of their id, and writes every document into its cells.

    Only whole vectors of the commonest length take part, as in the exact search.  A document is written once a table.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    base = knowledge.where(F.col("type") == doc_type) if doc_type is not None else knowledge
    base = _prepared(base, base_id, base_vector, "b").where(_finite("v"))
    width, count = commonest_width(base)
    base = materialize(base.where(F.size("v") == width), "index-documents")
    chosen = base.orderBy(F.xxhash64("b", F.lit(seed)), "b").limit(sample).withColumn("s", F.monotonically_increasing_id())
    chosen = materialize(chosen, "index-sample")
    held = chosen.orderBy("s").toArrow()
    vectors = _matrix(held["v"])
    draw = np.random.default_rng(seed)
    most = max(0, min(MOST_PLANES, int(np.log2(max(1, count // cell_rows)))))
    directions = draw.standard_normal((tables, most, max(1, width))) / np.sqrt(max(1, width))
    offsets = np.median(vectors @ directions.transpose(0, 2, 1), axis=1) if len(vectors) else np.zeros((tables, most))
    used, planes, visits, reached = 1, 0, 1, 1.0
    if most:
        # One more than k: the row itself is among its neighbours.
        true = similar_incidents(chosen, base, "s", "v", "b", "v", None, k + 1, metric, keep_unmatched=False)
        true = true.join(chosen.select("s", F.col("b").alias("own")), "s").where("match_id <> own")
        true = true.join(base.select(F.col("b").alias("match_id"), "v"), "match_id").orderBy("s", "rank").toArrow()
        numbers, place = true["s"].to_numpy(), held["s"].to_numpy()
        matched = _matrix(true["v"]) if len(numbers) else np.zeros((0, width))
        used, planes, visits, reached = _plan(vectors, [matched[numbers == s] for s in place], directions, offsets, most, recall)
    directions, offsets = directions[:used, :planes], offsets[:used, :planes]
    rows = materialize(_placed(base, directions, offsets, 1, "b"), "index-cells")
    return Index(rows, base, directions, offsets, visits, count, reached, metric)


def _placed(df: DataFrame, directions: np.ndarray, offsets: np.ndarray, visits: int, name: str) -> DataFrame:
    """Each row once for every cell it lies in or visits: (table, cell, id, v)."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _matrix(batch.column("v"))
            for t in range(len(directions)):
                cells = _visited(_margins(vectors, directions[t], offsets[t]), visits)
                at = pa.array(np.repeat(np.arange(len(cells)), cells.shape[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(cells.size, t, np.int32)), pa.array(cells.ravel()), batch.column(name).take(at), batch.column("v").take(at)],
                    ["table", "cell", name, "v"],
                )

    schema = T.StructType([
        T.StructField("table", T.IntegerType()), T.StructField("cell", T.LongType()),
        T.StructField(name, df.schema[name].dataType), T.StructField("v", T.ArrayType(T.DoubleType())),
    ])
    return df.select(name, "v").mapInArrow(place, schema)


def search_index(
    index: Index, queries: DataFrame, query_id: str = "id", query_vector: str = "embedding", k: int = fv.SIMILAR_INCIDENTS,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """``(query_id, rank, match_id, distance)`` of the nearest documents found, exact distances, ties to the smaller id.

    Cells meet their queries in blocks of bounded size, however full a cell is, and a query is written ``MOST_COPIES`` times at most.  A query whose cells hold fewer than ``k``
    documents is searched exactly.  Queries without a whole vector are left out; ``query_id`` is unique.
    """
    width = index.directions.shape[2]
    asked = _prepared(queries, query_id, query_vector, "q").where(_finite("v") & (F.size("v") == width))
    asked = materialize(asked, "index-queries")
    block = max(1, block_values // max(1, width))
    # A query is written once for each visit; where visits are many, blocks of queries go past the cells instead.
    if index.planes and len(index.directions) * index.visits <= MOST_COPIES:
        visiting = materialize(_placed(asked, index.directions, index.offsets, index.visits, "q"), "index-visits")
        met = _met(index, visiting, k, block)
    else:
        met = _passed(index, asked, k, block)
    found = materialize(met, "index-found")
    place = F.row_number().over(Window.partitionBy("q").orderBy("distance", "b"))
    found = found.dropDuplicates(["q", "b"]).withColumn("rank", place).where(F.col("rank") <= k)
    found = materialize(found.select("q", "rank", "b", "distance"), "index-ranked")
    enough = found.where(F.col("rank") == min(k, index.count)).select("q")
    short = asked.join(enough, "q", "left_anti")
    again = similar_incidents(short, index.base, "q", "v", "b", "v", None, k, index.metric, keep_unmatched=False)
    again = again.select("q", "rank", F.col("match_id").alias("b"), "distance")
    whole = found.join(enough, "q", "left_semi").unionByName(again)
    return whole.select(F.col("q").alias(query_id), "rank", F.col("b").alias("match_id"), "distance")


def _full(df: DataFrame, block: int, name: str) -> DataFrame:
    """One row per cell with more rows than a block, and its number of blocks: few beside the rows."""
    return df.groupBy("table", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias(name)).where(F.col(name) > 1)


def _met(index: Index, visiting: DataFrame, k: int, block: int) -> DataFrame:
    """The ``k`` nearest of each query in every block of every cell that it visits."""
    cells = _full(index.rows, block, "down").join(_full(visiting, block, "across"), ["table", "cell"], "full")
    cells = materialize(cells.na.fill(1, ["down", "across"]), "index-full-cells")

    def sized(df: DataFrame) -> DataFrame:
        return df.join(cells, ["table", "cell"], "left").na.fill(1, ["down", "across"])

    metric, at = index.metric, ["table", "cell"]
    left = sized(visiting).select(
        *at, _numbered(F.col("down")).alias("i"), F.pmod(F.xxhash64("q"), "across").alias("j"), "q",
        F.lit(None).cast(index.rows.schema["b"].dataType).alias("b"), "v",
    )
    right = sized(index.rows).select(
        *at, F.pmod(F.xxhash64("b"), "down").alias("i"), _numbered(F.col("across")).alias("j"),
        F.lit(None).cast(visiting.schema["q"].dataType).alias("q"), "b", "v",
    )
    both = left.withColumn("asked", F.lit(True)).unionByName(right.withColumn("asked", F.lit(False)))

    def search(table: pa.Table) -> pa.Table:
        mine = table["asked"]
        questions, documents = table.filter(mine), table.filter(pa.compute.invert(mine)).sort_by("b")
        q, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        distance = np.zeros(0)
        if len(questions) and len(documents):
            q, b, distance = _nearest(_matrix(questions["v"]), _matrix(documents["v"]), k, metric)
        return pa.table({"q": questions["q"].take(pa.array(q)), "b": documents["b"].take(pa.array(b)), "distance": pa.array(distance)})

    schema = T.StructType([
        T.StructField("q", visiting.schema["q"].dataType), T.StructField("b", index.rows.schema["b"].dataType),
        T.StructField("distance", T.DoubleType()),
    ])
    return both.groupBy("table", "cell", "i", "j").applyInArrow(search, schema)


def _passed(index: Index, asked: DataFrame, k: int, block: int) -> DataFrame:
    """The same ``k`` nearest in the cells that a query visits, without a copy of it for each: a task works out the visits of a block of
    queries and searches the cells of the blocks of documents that go past it."""
    metric, visits, directions, offsets = index.metric, index.visits, index.directions, index.offsets
    questions = in_blocks(asked, "q", max(1, -(-asked.count() // min(block, PASSING_QUERIES))))
    # Cells stay whole unless they are larger than a block.
    sized = index.rows.join(_full(index.rows, block, "down"), ["table", "cell"], "left").na.fill(1, ["down"])
    part = F.xxhash64("table", "cell", F.pmod(F.xxhash64("b"), "down"))
    documents = in_blocks(sized, "b", max(1, -(-index.rows.count() // block)), "table", "cell", by=part)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, object] = {"j": None}

        def visitors(table: int, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Cells that the block of queries visits in a table, sorted, and the query of each."""
            if table not in known:
                cells = _visited(_margins(vectors, directions[table], offsets[table]), visits)
                order = np.argsort(cells, axis=None, kind="stable")
                known[table] = cells.ravel()[order], (order // cells.shape[1]).astype(np.int32)
            return known[table]

        def near(j: int, questions: pa.StructArray, documents: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            if known["j"] != j:
                known.clear()
                known.update(j=j, vectors=_matrix(questions.field("v")))
            asking, held = known["vectors"], _matrix(documents.field("v"))
            tables, cells = documents.field("table").to_numpy(), documents.field("cell").to_numpy()
            # Documents are sorted by (table, cell, b).
            edges = np.flatnonzero(np.diff(tables, prepend=-1, append=-1) | np.diff(cells, prepend=-1, append=-1))
            found = [], [], []
            for a, z in zip(edges[:-1], edges[1:]):
                visited, by = visitors(int(tables[a]), asking)
                mine = by[np.searchsorted(visited, cells[a], "left") : np.searchsorted(visited, cells[a], "right")]
                if len(mine):
                    q, b, distance = _nearest(asking[mine], held[a:z], k, metric)
                    for out, values in zip(found, (mine[q].astype(np.int64), b + a, distance)):
                        out.append(values)
            kinds = (np.int64, np.int64, np.float64)
            return tuple(np.concatenate(out) if out else np.zeros(0, kind) for out, kind in zip(found, kinds))

        return best_of_pairs(batches, k, near, once=True)

    return crossed(questions, documents).mapInArrow(search, found_schema(asked.schema["q"].dataType, index.rows.schema["b"].dataType))


def measured_recall(found: DataFrame, exact: DataFrame, query_id: str = "id") -> float:
    """Share of the exact result's pairs that were found; 1 where there are none."""
    pairs = exact.select(query_id, "match_id").join(found.select(query_id, "match_id").withColumn("hit", F.lit(1)), [query_id, "match_id"], "left")
    row = pairs.agg(F.count("hit").alias("hit"), F.count(F.lit(1)).alias("all")).first()
    return row["hit"] / row["all"] if row["all"] else 1.0
