"""Which of very many hashed places hold a hash that occurs more than once.

Places are (row, pos) with a 64-bit hash.  They travel as packed arrays, one row per bucket of
hashes and task batch.  Before that a batch settles its own repeats and sends each hash once, so
a hash that a third of all rows hold costs every bucket one entry per batch, not per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar

# An entry competes, competes but is reported already, or is only passed on to its row.
OPEN, KNOWN, SETTLED = 0, 1, 2
# Entries in the order of (row, pos): each row once with its number of entries, positions as steps.
PACKED = "bucket int, hash binary, state binary, row binary, ord binary, n binary, step binary"
# Text behind a bucket: entries take 33 bytes each, so a task holds some 300 MB where every byte starts one (rare) and far less of words.
BUCKET_BYTES = 8 << 20
Places = Callable[[pa.RecordBatch], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def buckets_of(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """As many as the bytes of ``text`` need, counted, and at least one for each shuffle partition.

    Hashes spread entries evenly, and there is at most one for each byte: a bucket holds about ``bucket_bytes`` of them or fewer.
    """
    total = df.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))


def runs(*sorted_keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal keys, and the end."""
    n = len(sorted_keys[0])
    if n == 0:
        return np.zeros(1, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.append(np.flatnonzero(new), n)


def _settle_all(hash_, ord_, row, pos, state):
    """Every place whose hash occurs at least twice is reported."""
    order = np.argsort(hash_, kind="stable")
    edges = runs(hash_[order])
    many = np.repeat(np.diff(edges) > 1, np.diff(edges))
    head = np.zeros(len(order), bool)
    head[edges[:-1]] = True
    report = order[many & (state[order] == OPEN)]
    rest, now = order[head], np.where(many[head], KNOWN, state[order[head]]).astype(np.uint8)
    return report, rest, now


def _settle_later(hash_, ord_, row, pos, state):
    """Every place is reported but the first of its hash in the order (ord, row, pos)."""
    order = np.lexsort((pos, row, ord_, hash_))
    edges = runs(hash_[order])
    first = np.repeat(order[edges[:-1]], np.diff(edges))
    same = (ord_[order] == ord_[first]) & (row[order] == row[first]) & (pos[order] == pos[first])
    return order[~same], order[edges[:-1]], state[order[edges[:-1]]]


def _packed(bucket: np.ndarray, hash_, ord_, row, pos, state) -> pa.RecordBatch:
    order = np.lexsort((pos, row, bucket))
    bucket, hash_, ord_, row, pos, state = (c[order] for c in (bucket, hash_, ord_, row, pos, state))
    codec = pa.Codec("zstd", 1)
    parts = [[] for _ in range(7)]
    edges = runs(bucket)
    for a, b in zip(edges[:-1], edges[1:]):
        per_row = runs(row[a:b])
        step = np.diff(pos[a:b], prepend=0)
        step[per_row[:-1]] = pos[a:b][per_row[:-1]]
        found = (
            int(bucket[a]), hash_[a:b].tobytes(), state[a:b].tobytes(), row[a:b][per_row[:-1]].tobytes(),
            ord_[a:b][per_row[:-1]].tobytes(), np.diff(per_row).astype(np.int32).tobytes(),
            codec.compress(step.astype(np.int32).tobytes(), asbytes=True),
        )
        for part, value in zip(parts, found):
            part.append(value)
    names = ["bucket", "hash", "state", "row", "ord", "n", "step"]
    return pa.RecordBatch.from_arrays([pa.array(parts[0], pa.int32()), *(pa.array(p, pa.binary()) for p in parts[1:])], names)


def _unpacked(table: pa.Table):
    """(hash, ord, row, pos, state) of all entries of a bucket."""
    codec = pa.Codec("zstd", 1)
    out = [[] for _ in range(5)]
    for hash_, state, row, ord_, n, step in zip(*(table[c].to_pylist() for c in ("hash", "state", "row", "ord", "n", "step"))):
        n = np.frombuffer(n, np.int32)
        hash_ = np.frombuffer(hash_, np.uint64)
        walked = np.cumsum(np.frombuffer(codec.decompress(step, 4 * len(hash_), asbytes=True), np.int32), dtype=np.int64)
        first = np.cumsum(n) - n
        before = np.where(first > 0, walked[first - 1], 0)
        for part, values in zip(out, (
            hash_, np.repeat(np.frombuffer(ord_, np.int64), n), np.repeat(np.frombuffer(row, np.int64), n),
            walked - np.repeat(before, n), np.frombuffer(state, np.uint8),
        )):
            part.append(values)
    return [np.concatenate(part) for part in out]


def _by_row(row, pos):
    order = np.lexsort((pos, row))
    row, pos = row[order], pos[order]
    edges = runs(row)
    return row[edges[:-1]], pos, np.diff(edges)


def repeats(df: DataFrame, places: Places, buckets: int, later: bool = False) -> DataFrame:
    """(row, pos array): places with repeated hashes; with ``later`` all but the first place of each hash.

    ``places`` turns a batch of ``df`` into (hash, row of the batch, pos) arrays.  ``df`` has the key ``row`` and, for the
    order of places, ``ord``, both long.  Hashes, and then reports, are dealt into ``buckets``, each loaded by one task.
    """
    settle = _settle_later if later else _settle_all
    n = buckets

    def pack(batches):
        for batch in batches:
            found = list(places(batch))
            if not found:
                continue
            hash_, at, pos = (np.concatenate(part) for part in zip(*found))
            if not len(hash_):
                continue
            row = batch.column("row").to_numpy(zero_copy_only=False)[at]
            ord_ = batch.column("ord").to_numpy(zero_copy_only=False)[at] if later else np.zeros(len(at), np.int64)
            pos, state = pos.astype(np.int64), np.zeros(len(at), np.uint8)
            report, rest, now = settle(hash_, ord_, row, pos, state)
            zero = np.zeros(len(report), np.uint64)
            # Packing keeps one ``ord`` for all entries of a row in a bucket, so reports carry theirs too.
            columns = [
                np.concatenate(part) for part in (
                    (hash_[rest], zero), (ord_[rest], ord_[report]), (row[rest], row[report]), (pos[rest], pos[report]),
                    (now, np.full(len(report), SETTLED, np.uint8)),
                )
            ]
            spread = np.concatenate([hash_[rest], ar.mix(row[report].view(np.uint64))])
            bucket = (spread >> np.uint64(32)) % np.uint64(n)
            yield _packed(bucket.astype(np.int32), *columns)

    def unpack(table: pa.Table) -> pa.Table:
        hash_, ord_, row, pos, state = _unpacked(table)
        settled = state == SETTLED
        rest = ~settled
        report, _, _ = settle(hash_[rest], ord_[rest], row[rest], pos[rest], state[rest])
        row, pos = np.concatenate([row[settled], row[rest][report]]), np.concatenate([pos[settled], pos[rest][report]])
        # Reports travel packed as well, to the bucket of their row.
        home = ((ar.mix(row.view(np.uint64)) >> np.uint64(32)) % np.uint64(n)).astype(np.int32)
        none = np.zeros(len(row), np.uint64)
        return pa.Table.from_batches([_packed(home, none, none.view(np.int64), row, pos, none.astype(np.uint8))])

    def gather(table: pa.Table) -> pa.Table:
        _, _, row, pos, _ = _unpacked(table)
        rows, flat, counts = _by_row(row, pos)
        return pa.table({"row": rows, "pos": ar.list_array(flat, counts, pa.int64())})

    reports = df.mapInArrow(pack, PACKED).groupBy("bucket").applyInArrow(unpack, PACKED)
    return reports.groupBy("bucket").applyInArrow(gather, "row long, pos array<long>")
