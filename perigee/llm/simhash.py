"""SimHash near-duplicates by a self-join of a binary trie.

The distinct fingerprints form a binary trie.  Pairs of its nodes are walked together from
(root, root): their children are paired, differing bits add up, and a pair is dropped once it
exceeds the budget.  There are ``budget + 1`` tries, each over the fingerprints turned by another
share of their bits: of so many shares one is free of errors in any link, so a trie allows none in
its first ``exact`` bits.  Up there a node meets itself only, and a fingerprint is copied once per trie however
deep the walk goes.

The upper part of the walk is a join per ``STEP`` bits over counted nodes; a pair whose nodes hold
at most ``leaf_rows`` fingerprints is finished in one task, where the walk goes on over sorted
arrays.  Fingerprints are distinct, so any crowded node splits further down and no task gets
more than two bounded nodes.  A task reports a forest of its links, not the pairs; components of
the forests are those of all links.

Defined results: texts without words have fingerprint 0, fewer words than a shingle are one
shingle.  Rows without id take part but name no component; a component of such rows alone is
NULL.  Repeated rows are linked like any equal texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm.components import components
from perigee.session import materialize

WORDS = 3
BITS = 64
BUDGET = 2
SEED = 42
STEP = 4
LEAF_ROWS = 8192
FRONT = 1 << 18
SHINGLES = 1 << 16


def _fingerprint(text: bytes, words: int) -> int:
    parts = text.lower().split()
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), SEED)
    line = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = len(parts) - words + 1
    set_bits = np.zeros(BITS, np.int64)
    for at in range(0, n, SHINGLES):
        first, last = starts[at : min(at + SHINGLES, n)].tolist(), ends[at + words - 1 : min(at + SHINGLES, n) + words - 1].tolist()
        h = np.array([digest(line[a:b], SEED) for a, b in zip(first, last)], np.uint64)
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n, bitorder="little").tobytes(), "little")


def fingerprint(text: Column, words: int = WORDS) -> Column:
    """Bit by bit the majority of the XXH64 values of all word shingles, as a long."""

    @F.arrow_udf("bigint")
    def of(column: pa.Array) -> pa.Array:
        values = np.fromiter(
            (_fingerprint((t.as_py() or "").encode("utf-8", "surrogatepass"), words) for t in column), np.uint64, len(column)
        )
        return pa.array(values.view(np.int64))

    return of(text)


def _prefix(value: Column, depth: int) -> Column:
    return F.shiftrightunsigned(value, BITS - depth) if depth else F.lit(0).cast("long")


def _exact_bits(budget: int) -> int:
    """Bits of a turned fingerprint in which a link has no error: a share of them, in whole steps."""
    return BITS // (budget + 1) // STEP * STEP


def _turned(prints: DataFrame, budget: int) -> DataFrame:
    """(turn, f): each fingerprint turned left by ``turn`` bits, once for each share."""
    turns = [BITS * i // (budget + 1) for i in range(budget + 1)]
    shifted = [
        F.struct(F.lit(t).alias("turn"), (
            F.shiftleft("f", t).bitwiseOR(F.shiftrightunsigned("f", BITS - t)) if t else F.col("f")).alias("f"))
        for t in turns
    ]
    return prints.select(F.inline(F.array(*shifted)))


def _pairs_to_walk(turned: DataFrame, leaf_rows: int, budget: int) -> list[tuple[int, DataFrame]]:
    """(depth, pairs of nodes (turn, x, y, spent)) small enough for one task each."""
    root = turned.groupBy("turn").agg(F.count("*").alias("nx"))
    zero = F.lit(0).cast("long")
    front = materialize(root.select("turn", zero.alias("x"), zero.alias("y"), "nx", F.col("nx").alias("ny"), F.lit(0).alias("spent")), "trie-pairs")
    done, depth = [], 0
    while depth < BITS and not front.isEmpty():
        crowded = F.col("nx") + F.when(F.col("x") == F.col("y"), 0).otherwise(F.col("ny")) > leaf_rows
        done.append((depth, front.where(~crowded).select("turn", "x", "y", "spent")))
        open_ = front.where(crowded)
        depth += STEP
        nodes = turned.groupBy("turn", _prefix(F.col("f"), depth).alias("c")).agg(F.count("*").alias("n"))
        nodes = materialize(nodes.withColumn("p", F.shiftrightunsigned("c", STEP)), "trie-nodes")
        left = nodes.select("turn", F.col("p").alias("x"), F.col("c").alias("cx"), F.col("n").alias("kx"))
        right = nodes.select("turn", F.col("p").alias("y"), F.col("c").alias("cy"), F.col("n").alias("ky"))
        spent = F.col("spent") + F.bit_count(F.col("cx").bitwiseXOR(F.col("cy")).bitwiseAND(F.lit((1 << STEP) - 1)))
        children = open_.join(left, ["turn", "x"]).join(right, ["turn", "y"]).withColumn("spent", spent)
        allowed = budget if depth > _exact_bits(budget) else 0
        children = children.where((F.col("spent") <= allowed) & ((F.col("x") != F.col("y")) | (F.col("cx") <= F.col("cy"))))
        front = materialize(children.select(
            "turn", F.col("cx").alias("x"), F.col("cy").alias("y"), F.col("kx").alias("nx"), F.col("ky").alias("ny"), "spent"
        ), "trie-pairs")
    # At full depth a node is one fingerprint.
    return [*done, (depth, front.select("turn", "x", "y", "spent"))]


def _walk(a: np.ndarray, b: np.ndarray, same: bool, depth: int, spent: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of linked fingerprints of two trie nodes, given as sorted arrays."""
    stack = [(depth, *(np.array([v]) for v in (0, len(a), 0, len(b), spent)))]
    while stack:
        depth, a0, a1, b0, b1, e = stack.pop()
        if len(a0) > FRONT:
            half = len(a0) // 2
            stack += [(depth, *(v[s] for v in (a0, a1, b0, b1, e))) for s in (slice(half), slice(half, None))]
            continue
        # Pairs with one fingerprint on each side are compared at once.
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        i, j = a0[single], b0[single]
        near = np.bitwise_count(a[i] ^ b[j]) <= budget
        if same:
            near &= i < j
        if near.any():
            yield i[near], j[near]
        if depth == BITS:
            continue
        a0, a1, b0, b1, e = (v[~single] for v in (a0, a1, b0, b1, e))
        if not len(a0):
            continue
        bit = np.uint64(1 << (BITS - 1 - depth))
        am, bm = _split(a, a0, a1, bit), _split(b, b0, b1, bit)
        allowed = budget if depth >= _exact_bits(budget) else 0
        parts = []
        for x0, x1, y0, y1, more in ((a0, am, b0, bm, 0), (am, a1, bm, b1, 0), (a0, am, bm, b1, 1), (am, a1, b0, bm, 1)):
            keep = (x0 < x1) & (y0 < y1) & (e + more <= allowed)
            if same:
                keep &= x0 < y1
            parts.append((x0[keep], x1[keep], y0[keep], y1[keep], e[keep] + more))
        stack.append((depth + 1, *(np.concatenate(p) for p in zip(*parts))))


def _split(values: np.ndarray, start: np.ndarray, end: np.ndarray, bit: np.uint64) -> np.ndarray:
    """Where the bit becomes 1 within each sorted range whose members agree above it."""
    ones = np.concatenate([[0], np.cumsum((values & bit) != 0)])
    return end - (ones[end] - ones[start])


class _Forest:
    """Smallest index reachable, from links that come in portions."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def _roots(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[i]
            if np.array_equal(up, i):
                return i
            i = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self._roots(i), self._roots(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.root, np.maximum(i, j), np.minimum(i, j))

    def star(self) -> np.ndarray:
        return self._roots(self.root)


def _link_nodes(table: pa.Table, budget: int) -> pa.Table:
    """Forest of the links between two nodes: rows (turn, f, second, depth, spent, same) of one pair."""
    f = table["f"].to_numpy().view(np.uint64)
    second = table["second"].to_numpy(zero_copy_only=False).astype(bool)
    turn, depth, spent, same = (table[name][0].as_py() for name in ("turn", "depth", "spent", "same"))
    a, b = np.sort(f[~second]), np.sort(f[second])
    if same:
        b, shift = a, 0
    else:
        shift = len(a)
    forest = _Forest(len(a) + (0 if same else len(b)))
    for i, j in _walk(a, b, same, depth, spent, budget):
        forest.link(i, j + shift)
    members = a if same else np.concatenate([a, b])
    root = forest.star()
    if turn:
        members = (members >> np.uint64(turn)) | (members << np.uint64(BITS - turn))
    moved = root != np.arange(len(root))
    return pa.table({"a": members[moved].view(np.int64), "b": members[root[moved]].view(np.int64)})


def links(prints: DataFrame, leaf_rows: int = LEAF_ROWS, budget: int = BUDGET) -> DataFrame:
    """Forest (a, b) that joins all distinct fingerprints ``f`` within ``budget`` differing bits."""
    turned = materialize(_turned(prints, budget), "simhash-turned")
    sides = []
    for depth, pairs in _pairs_to_walk(turned, leaf_rows, budget):
        pairs = pairs.withColumns({"depth": F.lit(depth), "same": F.col("x") == F.col("y")})
        held = turned.withColumn("node", _prefix(F.col("f"), depth))
        for second, side in ((False, pairs), (True, pairs.where("NOT same"))):
            own = F.col("y" if second else "x")
            sides.append(side.withColumn("node", own).join(held, ["turn", "node"]).select(
                "turn", "x", "y", "depth", "spent", "same", F.lit(second).alias("second"), "f"))
    rows = sides[0]
    for more in sides[1:]:
        rows = rows.unionAll(more)
    return rows.groupBy("turn", "depth", "x", "y").applyInArrow(lambda t: _link_nodes(t, budget), "a long, b long")


def _by_component(docs: DataFrame, words: int, budget: int, leaf_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_key, f), and (f, least, component) for each fingerprint; a component is one of its fingerprints."""
    rows = materialize(docs.select(
        "doc_id", F.xxhash64("text").alias("text_key"), fingerprint(F.col("text"), words).alias("f")
    ), "simhash")
    classes = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("least")), "simhash-classes")
    joined = materialize(components(links(classes.select("f"), leaf_rows, budget)), "simhash-components")
    return rows, classes.join(joined, F.col("f") == F.col("node"), "left").withColumn("component", F.coalesce("component", "f"))


def near_duplicates(docs: DataFrame, words: int = WORDS, budget: int = BUDGET, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """(doc_id, text_key, f, component_id) for each row of (doc_id, text)."""
    rows, named = _by_component(docs, words, budget, leaf_rows)
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = materialize(named.join(heads, "component").select("f", "component_id"), "simhash-heads")
    return rows.join(by_print, "f").select("doc_id", "text_key", "f", "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, budget: int = BUDGET) -> DataFrame:
    """Rows of ``docs`` that stay: of each component the one with the smallest id, with or without ids in it.

    Of rows that share this id the smallest hash of the text stays, of rows that repeat both the one whose columns come
    first as JSON text.
    """
    rows, named = _by_component(docs, words, budget, LEAF_ROWS)
    found = rows.join(materialize(named.select("f", "component"), "simhash-heads"), "f")
    alike = found.groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    kept = alike.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "text_key", "n")).alias("k"))
    kept = materialize(kept.select("k.doc_id", "k.text_key", "k.n"), "simhash-kept")

    def rows_of(chosen: DataFrame) -> DataFrame:
        return docs.alias("d").join(
            chosen.alias("k"), F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.xxhash64("d.text") == F.col("k.text_key")), "left_semi"
        )

    repeated = kept.where("n > 1")
    if repeated.isEmpty():
        return rows_of(kept)
    row = F.struct(*(F.col(f"d.`{c}`") for c in docs.columns))
    first = rows_of(repeated).select(F.col("d.doc_id").alias("id"), F.xxhash64("d.text").alias("key"), row.alias("row")).groupBy(
        "id", "key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return rows_of(kept.where("n = 1")).unionAll(first.select(*(F.col(f"row.`{c}`") for c in docs.columns)))
