"""Shards of equal bytes by histogram sort.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together.  For the boundary
between two shards, exact bytes below candidate keys are counted over all partitions, and the
candidates are refined between the two that enclose the wanted size until one is within the
tolerance.  Candidates between hashes come first, so a group of equal texts stays whole where
the tolerance allows; only a group that must be cut is refined by doc_id.  Once few rows are left around a
boundary, their keys are fetched and later candidates counted on them, without another pass.  Rows that agree in both and
are too many for the tolerance are written once with a number of their own as third part of the key, and
boundaries are searched again.  Then rows are exchanged once.

A shard is dealt in pieces of about ``piece_rows`` rows, each numbered in a task of its own;
the counts of the pieces turn these numbers into gapless slots.

Defined results: a NULL text has 0 bytes, a NULL checksum and counts ``row_bytes``.  Rows that agree in text and
doc_id stay together within the tolerance and are dealt by their written numbers beyond it.  An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from perigee.session import materialize

SHARDS = 40
ROW_BYTES = 16
TOLERANCE = 0.005
PROBES = 64
PIECE_ROWS = 1000
# Rows whose keys the driver holds at most, all boundaries together.
HELD_ROWS = 40_000
LOW, HIGH = -(1 << 63), 1 << 63


def size_of(text: Column, row_bytes: int = ROW_BYTES) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + row_bytes


def sort_key(text: Column, doc_id: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.coalesce(doc_id.cast("long"), F.lit(LOW))


def _below(boundaries: list[tuple[int, ...]]):
    """UDF: the number of boundaries at or below a key of as many parts."""
    levels = np.array(boundaries, np.int64).T

    @F.arrow_udf("int")
    def below(*parts: pa.Array) -> pa.Array:
        start, end = np.zeros(len(parts[0]), np.int64), np.full(len(parts[0]), len(boundaries), np.int64)
        for part, level in zip(parts, levels):
            values = part.to_numpy(zero_copy_only=False)
            open_ = np.flatnonzero(start < end)
            ranges, which = np.unique(np.stack([start[open_], end[open_]], 1), axis=0, return_inverse=True)
            for k, (a, b) in enumerate(ranges.tolist()):
                mine = open_[which.ravel() == k]
                start[mine] = a + np.searchsorted(level[a:b], values[mine], "left")
                end[mine] = a + np.searchsorted(level[a:b], values[mine], "right")
        return pa.array(end, pa.int32())

    return below


def _probes(lo: tuple[int, ...], hi: tuple[int, ...], n: int) -> list[tuple[int, ...]]:
    """Up to ``n`` keys between two: between their first parts while there are any, then between the next parts of one."""
    a, b, rest = lo[0], hi[0], len(lo) - 1
    if b - a > 1:
        return [(v, *[LOW] * rest) for v in _between(a, b, n)]
    if not rest:
        return []
    if b > a and hi[1:] > (LOW,) * rest:
        return [(b, *[LOW] * rest)]
    upper = hi[1:] if a == b else (HIGH, *[LOW] * (rest - 1))
    return [(a, *p) for p in _probes(lo[1:], upper, n)]


class _Boundary:
    """The search for one boundary: a lower and an upper key with exact bytes and rows below each."""

    def __init__(self, wanted: float, total: int, rows: int, parts: int):
        self.wanted = wanted
        rest = [LOW] * (parts - 1)
        self.lo, self.hi = ((LOW, *rest), 0, 0), ((HIGH, *rest), total, rows)
        self.found = self.crowd = None
        # The keys between both, once they are few.
        self.held: _Held | None = None

    def probes(self, n: int) -> list[tuple[int, ...]]:
        return _probes(self.lo[0], self.hi[0], n)

    def narrow(self, known: list[tuple[tuple[int, ...], int, int]], tolerance: float) -> None:
        for at in known:
            if self.lo[0] < at[0] < self.hi[0]:
                if at[1] <= self.wanted:
                    self.lo = max(self.lo, at)
                else:
                    self.hi = min(self.hi, at)
        nearest = min(self.lo, self.hi, key=lambda at: abs(at[1] - self.wanted))
        near, single = abs(nearest[1] - self.wanted) <= tolerance, self.hi[2] - self.lo[2] <= 1
        if near or single or not self.probes(1):
            self.found = nearest[0]
            # Many rows of one key lie across the boundary.
            self.crowd = None if near or single else self.lo[0]


def _between(a: int, b: int, n: int) -> list[int]:
    """Up to ``n`` whole numbers strictly between a and b, evenly spread."""
    n = min(n, b - a - 1)
    return sorted({a + (b - a) * i // (n + 1) for i in range(1, n + 1)} - {a, b})


class _Held:
    """The keys of a range from ``lo`` on, with exact bytes and rows below each."""

    def __init__(self, lo: tuple[tuple[int, ...], int, int], found: list[tuple[tuple[int, ...], int, int]]):
        found = sorted(found)
        self.keys = [key for key, _, _ in found]
        self.bytes = list(accumulate((size for _, size, _ in found), initial=lo[1]))
        self.rows = list(accumulate((n for _, _, n in found), initial=lo[2]))

    def below(self, key: tuple[int, ...]) -> tuple[tuple[int, ...], int, int]:
        at = bisect_left(self.keys, key)
        return key, self.bytes[at], self.rows[at]


def _held(keys: DataFrame, parts: list[str], ranges: set[tuple]) -> dict[tuple[int, ...], _Held]:
    """The keys of ``ranges``, pairs of the lower and upper end of a boundary, by lower key and in one pass."""
    # An end above every key cannot be written as a long: what follows the last of these is below it.
    ends = sorted({at[0] for pair in ranges for at in pair if at[0][0] < HIGH})
    number = _below(ends)(*parts).alias("at")
    rows: dict[int, list] = {bisect_right(ends, lo[0]): [] for lo, _ in ranges}
    chosen = keys.select(number, *parts, "size").where(F.col("at").isin(list(rows)))
    for row in chosen.groupBy("at", *parts).agg(F.sum("size"), F.count("*")).collect():
        rows[row[0]].append((tuple(row[1:-2]), row[-2], row[-1]))
    return {lo[0]: _Held(lo, rows[bisect_right(ends, lo[0])]) for lo, _ in ranges}


def _counted(keys: DataFrame, parts: list[str], asked: list[tuple[int, ...]]) -> list[tuple[tuple[int, ...], int, int]]:
    """Exact bytes and rows below each of ``asked``, in one pass."""
    if not asked:
        return []
    counts = {
        r[0]: (r[1], r[2])
        for r in keys.groupBy(_below(asked)(*parts).alias("at")).agg(F.sum("size"), F.count("*")).collect()
    }
    known, bytes_, n = [], 0, 0
    for i, p in enumerate(asked):
        more = counts.get(i, (0, 0))
        bytes_, n = bytes_ + more[0], n + more[1]
        known.append((p, bytes_, n))
    return known


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, probes: int = PROBES) -> tuple[list, set]:
    """Keys at which shards 1, 2, ... begin, and the keys whose many rows lie across one; ``tolerance`` in shares of a shard.

    ``keys`` has ``size`` and the parts of a key, first parts first.
    """
    parts = [c for c in keys.columns if c != "size"]
    total, rows = keys.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    bounds = [_Boundary(total * i / shards, total, rows, len(parts)) for i in range(1, shards)]
    allowed = tolerance * total / shards
    for b in bounds:
        b.narrow([], allowed)
    while open_ := [b for b in bounds if b.found is None]:
        # Boundaries have one range or ranges apart, as each sees all candidates that were counted.
        few = [b for b in open_ if b.held is None and b.hi[2] - b.lo[2] <= HELD_ROWS // shards]
        if few:
            held = _held(keys, parts, {(b.lo, b.hi) for b in few})
            for b in few:
                b.held = held[b.lo[0]]
        known, far = {}, set()
        for b in open_:
            for p in b.probes(probes):
                if b.held is None:
                    far.add(p)
                else:
                    known[p] = b.held.below(p)
        known.update((at[0], at) for at in _counted(keys, parts, sorted(far)))
        first = sorted(known)
        for b in open_:
            own = first[bisect_right(first, b.lo[0]) : bisect_right(first, b.hi[0])]
            b.narrow([known[p] for p in own], allowed)
    found = [b.found for b in bounds]
    # A boundary above every key cannot be written as a long: nothing lies at or above it.
    return [p for p in found if p[0] < HIGH], {b.crowd for b in bounds if b.crowd is not None}


def _told_apart(docs: DataFrame, keys: DataFrame, crowds: set[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """``docs`` and ``keys`` with a third part ``r`` of the key: a number of its own for each row of the crowds (at most one a boundary)."""
    crowded = F.lit(False)
    for h, d in sorted(crowds):
        crowded = crowded | ((F.col("h") == h) & (F.col("d") == d))
    own = F.xxhash64(F.monotonically_increasing_id())
    held = materialize(docs.where(crowded).withColumn("r", own), "shard-crowds")
    sizes = keys.where(crowded).groupBy("h", "d").agg(F.max("size").alias("size"))
    apart = held.select("h", "d", "r").join(sizes, ["h", "d"])
    others = F.lit(0).cast("long")
    return docs.where(~crowded).withColumn("r", others).unionByName(held), keys.where(~crowded).select(
        "h", "d", others.alias("r"), "size").unionByName(apart)


def shard(docs: DataFrame, keys: DataFrame, shards: int = SHARDS, piece_rows: int = PIECE_ROWS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; ``docs`` has h and d, ``keys`` (h, d, size) of the same rows, written once."""
    key = ["h", "d"]
    bounds, crowds = splitters(keys.select(*key, "size"), shards)
    if crowds:
        docs, keys = _told_apart(docs, keys, crowds)
        key = ["h", "d", "r"]
        bounds, _ = splitters(keys.select(*key, "size"), shards)
    at = _below(bounds) if bounds else None
    number = (lambda: at(*key)) if at else (lambda: F.lit(0))
    pieces = max(1, -(-keys.count() // (shards * piece_rows)))
    piece = F.pmod(F.xxhash64(*key), F.lit(pieces)).cast("int")
    counts = keys.select(number().alias("shard"), piece.alias("piece")).groupBy("shard", "piece").agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "piece", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("start"))
    placed = docs.withColumns({"shard": number(), "piece": piece})
    inside = F.row_number().over(Window.partitionBy("shard", "piece").orderBy(*key))
    numbered = placed.withColumn("slot", inside.cast("long") - 1)
    joined = numbered.join(starts, ["shard", "piece"])
    return joined.withColumn("slot", F.col("slot") + F.col("start")).drop("start", "piece")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with ``shard`` and ``slot`` after its own columns, which they replace if it has such columns."""
    h, d = sort_key(F.col("text"), F.col("doc_id"))
    keys = materialize(docs.select(h.alias("h"), d.alias("d"), size_of(F.col("text")).alias("size")), "shard-keys")
    # The rows travel as one struct, so that no column of theirs meets one of ours.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), h.alias("h"), d.alias("d"))
    placed = shard(packed, keys, shards)
    own = [c for c in docs.columns if c not in ("shard", "slot")]
    return placed.select(*(F.col(f"row.`{c}`").alias(c) for c in own), "shard", "slot")
