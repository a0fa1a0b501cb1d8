"""Long repeated byte strings by a logarithmic family of suffix arrays.

Any string of ``LENGTH`` bytes holds at least one anchor: the start of its gram with the smallest hash
(leftmost on ties), which depends on its bytes alone.  Only suffixes that start at anchors are
indexed, so an array is about a hundredth of its text.  An entry is ordered by the hash of the
first ``GRAM`` bytes of its suffix and then by the hash of its reach: all bytes that belong to some
window with this anchor.  Neighbours in that order share a gram, or the whole reach.

Documents come in batches.  A batch is sorted into arrays, one per bucket of hashes, and each is
merge-scanned against the arrays of the existing levels; then levels of equal rank merge, so there
are at most log2(batches) of them.  An array keeps one entry per reach: more can only tell what
this one tells, and a passage that a third of all texts share stays one entry.

The scan settles anchors whose whole reach occurs elsewhere.  Where only the gram does, the reach is
taken apart: blocks of ``BLOCK`` windows are compared as a whole, then the windows of those blocks
whose common core is repeated.  Nothing is ever compared in pairs.

Defined results: NULL is an empty text; texts below ``LENGTH`` bytes lose nothing.  Repeated rows are
documents of their own and repeat each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar
from perigee.llm.repeats import BUCKET_BYTES, _by_row, buckets_of, repeats, runs
from perigee.session import materialize

LENGTH = 400
GRAM = 128
BLOCK = 32
BATCHES = 4
# Of the bytes of a text about one in a hundred is an anchor; blocks and windows are counted apart.
ANCHOR_STEP = 16
# What an entry knows, as bits: its gram stands in other reaches too and it speaks for its own; its reach is repeated.
PART, WHOLE = 1, 2
ENTRY = ("outer", "inner", "row", "pos", "state")
KINDS = (np.uint64, np.uint64, np.int64, np.int64, np.uint8)
ARRAY = "bucket int, outer binary, inner binary, row binary, pos binary, state binary"


# --- anchors of a stretch of texts --------------------------------------------


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, from block-wise running minima."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    full = -(-len(values) // width) * width
    padded = np.full(full, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(grams: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first, last): each anchor with the windows (by start) that choose it."""
    width = length - gram + 1
    least = _sliding_min(grams, width)
    none = np.zeros(0, np.int64)
    if not len(least):
        return none, none, none
    sizes = np.diff(bounds)
    n = len(least)
    begins, ends = bounds[:-1][sizes >= length], bounds[1:][sizes >= length] - length + 1
    mark = np.zeros(n + 1, np.int8)
    mark[begins] += 1
    np.add.at(mark, ends, -1)
    valid = np.cumsum(mark[:n], dtype=np.int8) > 0
    # A gram is the least of some window if it equals the largest minimum of the windows around it.
    top = np.full(n + 2 * (width - 1), np.uint64(0))
    top[width - 1 : width - 1 + n] = np.where(valid, least, np.uint64(0))
    around = ~_sliding_min(~top, width)
    candidates = np.flatnonzero(grams == around[: len(grams)])
    # Runs of windows of one text with one minimum, and the candidates that may be theirs.
    new = np.zeros(n, bool)
    new[1:] = least[1:] != least[:-1]
    new[begins] = True
    new[0] = True
    first = np.flatnonzero(new & valid)
    cut = np.append(np.flatnonzero(new | ~valid), n)
    last = cut[np.searchsorted(cut, first, "right")] - 1
    lo, hi = np.searchsorted(candidates, first), np.searchsorted(candidates, last + width)
    run = np.repeat(np.arange(len(first)), hi - lo)
    at = candidates[np.arange(len(run)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[run]]
    own = grams[at] == least[first[run]]
    run, at = run[own], at[own]
    start = first[run].copy()
    same = run[1:] == run[:-1]
    start[1:][same] = np.maximum(start[1:][same], at[:-1][same] + 1)
    end = np.minimum(last[run], at)
    good = start <= end
    return at[good], start[good], end[good]


def _stretches(column: pa.Array, length: int, gram: int):
    """(first row, bounds, hashes of spans, text of each anchor, anchor, first and last window)."""
    for row, _, data, bounds in ar.stretches(column):
        hashes = ar.SpanHash(ar.BYTE_VALUES[data])
        at, first, last = anchors(hashes.rolling(gram), bounds, length, gram)
        yield row, bounds, hashes, np.searchsorted(bounds, at, "right") - 1, at, first, last


# --- levels ---------------------------------------------------------------------


def _sorted_entries(columns):
    """Reports of what the neighbours of each entry show, and the sorted entries, one for each inner hash.

    An inner hash (of a reach) that repeats makes its places WHOLE.  Where one outer hash (of a gram)
    has several inner ones, one place of each is PART: these are compared more closely.
    """
    outer, inner, row, pos, state = columns
    order = np.lexsort((pos, row, inner, outer))
    outer, inner, row, pos, state = (c[order] for c in (outer, inner, row, pos, state))
    edges = runs(outer, inner)
    head = edges[:-1]
    now = state | np.where(np.repeat(np.diff(edges) > 1, np.diff(edges)), WHOLE, 0).astype(np.uint8)
    groups = runs(outer[head])
    mixed = np.repeat(np.diff(groups) > 1, np.diff(groups))
    now[head[mixed]] |= PART
    changed = now != state
    return (row[changed], pos[changed], now[changed]), [c[head] for c in (outer, inner, row, pos, now)]


def _read_entries(table: pa.Table):
    return [np.frombuffer(b"".join(table[name].to_pylist()), kind) for name, kind in zip(ENTRY, KINDS)]


def _write_entries(buckets: list, parts: list) -> pa.RecordBatch:
    arrays = [pa.array(buckets, pa.int32())]
    arrays += [pa.array([p[i].tobytes() for p in parts], pa.binary()) for i in range(len(ENTRY))]
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *ENTRY])


def _as_columns(report) -> list:
    """Reports as an array of their own: rows and positions, and what was found there as state."""
    row, pos, now = report
    order = np.lexsort((pos, row))
    none = np.zeros(0, np.uint64)
    return [none, none, row[order], pos[order], now[order]]


def _dealt(numbers: np.ndarray, columns: list, sign: int):
    """Columns cut by bucket number; buckets count from 1, those of reports are negative."""
    order = np.argsort(numbers, kind="stable")
    edges = runs(numbers[order])
    pieces = list(zip(edges[:-1], edges[1:]))
    if pieces:
        yield _write_entries(
            [sign * (int(numbers[order[a]]) + 1) for a, _ in pieces], [[c[order[a:b]] for c in columns] for a, b in pieces]
        )


def _entries(df: DataFrame, places, buckets: int) -> DataFrame:
    """Entries of (row, ...) rows, each task's share sorted and thinned; reports carry negative buckets.

    ``places`` turns a batch into (outer, inner, row of the batch, pos) arrays.
    """

    def pack(batches):
        for batch in batches:
            rows = batch.column("row").to_numpy(zero_copy_only=False)
            found = [
                (outer, inner, rows[at], pos.astype(np.int64), np.zeros(len(at), np.uint8)) for outer, inner, at, pos in places(batch)
            ]
            if not found:
                continue
            report, kept = _sorted_entries([np.concatenate(part) for part in zip(*found)])
            home = ((kept[0] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            yield from _dealt(home, kept, 1)
            told = ((ar.mix(report[0].view(np.uint64)) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            none = np.zeros(len(told), np.uint64)
            yield from _dealt(told, [none, none, *report], -1)

    return df.mapInArrow(pack, ARRAY)


def _merge_scan(entries: DataFrame) -> DataFrame:
    """Per bucket one sorted array, and what its merge shows as reports in the negative bucket."""

    def merge(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        columns = _read_entries(table)
        if bucket < 0:
            return pa.Table.from_batches([_write_entries([bucket], [columns])])
        report, kept = _sorted_entries(columns)
        return pa.Table.from_batches([
            _write_entries([bucket], [kept]), _write_entries([-bucket], [_as_columns(report)]),
        ])

    return entries.groupBy("bucket").applyInArrow(merge, ARRAY)


def _reports(arrays: list[DataFrame]) -> DataFrame:
    """(row, codes): for each row its reported positions, times 4, plus the state."""

    def list_them(batches):
        for batch in batches:
            _, _, row, pos, state = _read_entries(pa.Table.from_batches([batch]))
            rows, flat, counts = _by_row(row, pos * 4 + state)
            yield pa.RecordBatch.from_arrays([pa.array(rows), ar.list_array(flat, counts, pa.int64())], ["row", "codes"])

    told = arrays[0]
    for more in arrays[1:]:
        told = told.unionAll(more)
    listed = told.where("bucket < 0").mapInArrow(list_them, "row long, codes array<long>")
    return listed.groupBy("row").agg(F.flatten(F.collect_list("codes")).alias("codes"))


class SuffixLevels:
    """The family of arrays: ``add`` scans a batch against all levels, then merges equal ones.

    All its arrays are cut into the same ``buckets``, each loaded by one task: choose them for all that will be added.
    """

    def __init__(self, buckets: int, length: int = LENGTH, gram: int = GRAM):
        self.buckets, self.length, self.gram = buckets, length, gram
        self.levels: dict[int, DataFrame] = {}
        self.scans: list[DataFrame] = []

    def _written(self, arrays: DataFrame) -> DataFrame:
        """Writes sorted arrays with their reports and returns the arrays."""
        self.scans.append(materialize(arrays, "suffixes"))
        return self.scans[-1].where("bucket > 0")

    def add(self, docs: DataFrame) -> None:
        """Takes (row, text) of new documents."""
        length, gram = self.length, self.gram
        new = self._written(_merge_scan(_entries(docs.select("row", "text"), lambda b: _anchor_places(b, length, gram), self.buckets)))
        equal = []
        while len(equal) in self.levels:
            equal.append(self.levels.pop(len(equal)))
        for level in self.levels.values():
            self.scans.append(materialize(_merge_scan(new.unionAll(level)).where("bucket < 0"), "suffix-scan"))
        for level in equal:
            new = new.unionAll(level)
        self.levels[len(equal)] = self._written(_merge_scan(new)) if equal else new

    def matches(self) -> DataFrame:
        """(row, codes): the anchors found in several places so far."""
        return _reports(self.scans)


# --- exact extents --------------------------------------------------------------------


def _anchor_places(batch: pa.RecordBatch, length: int, gram: int):
    for row, bounds, hashes, text, at, first, last in _stretches(batch.column("text"), length, gram):
        yield hashes(at, at + gram), hashes(first, last + length), text + row, at - bounds[text]


def _with_state(column: pa.Array, bit: int, row: int, bounds: np.ndarray) -> np.ndarray:
    """Positions in the stretch that are reported with this bit for the texts from ``row`` on."""
    out = [np.zeros(0, np.int64)]
    for t in range(len(bounds) - 1):
        codes = np.array(column[row + t].as_py() or [], np.int64)
        out.append(codes[codes & bit > 0] // 4 + bounds[t])
    return np.concatenate(out)


def _blocks(at, first, last):
    """(first window, last window, anchor, block number) of the blocks of each reach, counted back from its anchor."""
    lo, hi = (at - last) // BLOCK, (at - first) // BLOCK
    n = hi - lo + 1
    which = np.repeat(np.arange(len(at)), n)
    number = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + lo[which]
    start = np.maximum(first[which], at[which] - number * BLOCK - BLOCK + 1)
    end = np.minimum(last[which], at[which] - number * BLOCK)
    return start, end, at[which], number


def _reach_blocks(batch: pa.RecordBatch, length: int, gram: int):
    """Per stretch: first row, bounds, hashes; text, first and last window of repeated reaches; blocks of the reaches to compare."""
    for row, bounds, hashes, text, at, first, last in _stretches(batch.column("text"), length, gram):
        whole = np.isin(at, _with_state(batch.column("codes"), WHOLE, row, bounds))
        part = np.isin(at, _with_state(batch.column("codes"), PART, row, bounds))
        yield row, bounds, hashes, (text[whole], first[whole], last[whole]), (text[part], *_blocks(at[part], first[part], last[part]))


def _block_places(batch: pa.RecordBatch, length: int, gram: int):
    """Blocks with what all windows of a full block have in common; a block cut short lies around it as well."""
    for row, bounds, hashes, _, (_, start, end, anchor, number) in _reach_blocks(batch, length, gram):
        core = anchor - number * BLOCK
        outer = ar.mix(hashes(core, core - BLOCK + 1 + length) + number.astype(np.uint64))
        t = np.searchsorted(bounds, start, "right") - 1
        yield outer, hashes(start, end + length), t + row, start - bounds[t]


def _settled_and_open(batch: pa.RecordBatch, length: int, gram: int):
    """Per stretch: first row, bounds, hashes; text, first and last of repeated windows; text and start of windows to compare."""
    for row, bounds, hashes, whole, (_, start, end, _, _) in _reach_blocks(batch, length, gram):
        t = np.searchsorted(bounds, start, "right") - 1
        settled = np.isin(start, _with_state(batch.column("blocks"), WHOLE, row, bounds))
        open_ = np.isin(start, _with_state(batch.column("blocks"), PART, row, bounds))
        n = (end - start + 1)[open_]
        which = np.repeat(np.flatnonzero(open_), n)
        single = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n) + start[which]
        repeated = tuple(np.concatenate([a, b[settled]]) for a, b in zip(whole, (t, start, end)))
        yield row, bounds, hashes, repeated, (t[which], single)


def _single_places(batch: pa.RecordBatch, length: int, gram: int):
    for row, bounds, hashes, _, (text, start) in _settled_and_open(batch, length, gram):
        yield hashes(start, start + length), text + row, start - bounds[text]


def _settled_spans(batch: pa.RecordBatch, length: int, gram: int) -> list[np.ndarray]:
    """Start and end bytes, in turn, of what is removed without looking at single windows."""
    out = []
    for _, bounds, _, (text, first, last), _ in _settled_and_open(batch, length, gram):
        for t in range(len(bounds) - 1):
            mine = text == t
            a, b = ar.union_of_spans(first[mine] - bounds[t], last[mine] - bounds[t] + length)
            out.append(np.stack([a, b], 1).ravel())
    return out


def _cut(batches, length: int, gram: int):
    """Rows of (row, n_removed, spans, sha256) from texts, settled and single windows."""
    for batch in batches:
        spans_before = _settled_spans(batch, length, gram)
        removed, spans, digests = [], [], []
        for text, before, singles in zip(batch.column("text"), spans_before, batch.column("singles")):
            data = (text.as_py() or "").encode("utf-8", "surrogatepass")
            more = np.array(singles.as_py() or [], np.int64)
            pairs = before.reshape(-1, 2)
            a, b = ar.union_of_spans(np.concatenate([pairs[:, 0], more]), np.concatenate([pairs[:, 1], more + length]))
            digest, at = hashlib.sha256(), 0
            for start, end in zip(a.tolist(), b.tolist()):
                digest.update(data[at:start])
                at = end
            digest.update(data[at:])
            removed.append(int((b - a).sum()))
            spans.append(np.stack([a, b], 1).ravel().tolist())
            digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([
            batch.column("row"), pa.array(removed, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(digests, pa.string())
        ], ["row", "n_removed", "spans", "sha256"])


def removed_bytes(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept_sha256) for each row of (doc_id, text); spans are start and end bytes in turn.

    ``bucket_bytes`` is the text behind a bucket of windows; anchors and blocks are fewer, so their buckets stand for ``ANCHOR_STEP`` times as much.
    """
    base = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row"))
    levels = SuffixLevels(buckets_of(docs, ANCHOR_STEP * bucket_bytes), length, gram)
    for k in range(batches):
        levels.add(base.where(F.pmod("row", F.lit(batches)) == k))
    held = materialize(base.join(levels.matches(), "row").select("row", "text", "codes"), "suffix-held")
    blocks = _reports([_merge_scan(_entries(held, lambda b: _block_places(b, length, gram), buckets_of(held, ANCHOR_STEP * bucket_bytes)))]).withColumnRenamed("codes", "blocks")
    parted = held.join(blocks, "row", "left")
    singles = repeats(parted, lambda b: _single_places(b, length, gram), buckets_of(held, bucket_bytes)).select("row", F.col("pos").alias("singles"))
    cut = parted.join(singles, "row", "left").mapInArrow(
        lambda it: _cut(it, length, gram), "row long, n_removed long, spans array<long>, sha256 string"
    ).dropDuplicates(["row"])
    whole = base.select("doc_id", "row", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                        F.sha2(F.coalesce("text", F.lit("")), 256).alias("whole"))
    return whole.join(cut, "row", "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"),
        F.coalesce("sha256", "whole").alias("kept_sha256"),
    )
