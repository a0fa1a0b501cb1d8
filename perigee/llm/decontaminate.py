"""Benchmark decontamination by winnowing.

Every window of ``window`` words holds ``window - gram + 1`` grams of ``gram`` words; the one with
the smallest hash is its fingerprint.  Equal windows choose the same gram, so a text that shares
a window with an item shares that fingerprint.  Fingerprints of the texts meet those of the
benchmark, and each meeting is extended by comparing the windows around it: only windows that
occur in an item count, every one of them is found.

The windows of a benchmark are counted first.  Up to ``shared_windows`` of them are sent to the tasks, and the texts are
never shuffled.  A larger benchmark stays a table: the distinct fingerprints of the texts are joined with its own, only the
windows behind a fingerprint that was met are made again, and these are joined with the windows of the items.
No task or driver holds more of the benchmark than its share.

Defined results: NULL and empty texts and items have no words.  An item with fewer words than the
window is one window of its own length, found by comparing all grams of that length.  Repeated
items count once by id; an item without id marks words but is not listed.  An empty benchmark
contaminates nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from perigee.llm import arrays as ar
from perigee.session import materialize

# Words: digits and letters after lower-casing A-Z, and everything beyond ASCII.
ITEM_WORD = ~ar.byte_set(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
WINDOW = 10
GRAM = 5
SHARED_WINDOWS = 1_000_000
SPANS_TYPE = "n_words BIGINT, spans ARRAY<INT>"


def _words(data: np.ndarray, bounds: np.ndarray) -> tuple[ar.SpanHash, np.ndarray]:
    """Hashes of spans of words, and the first word of each text."""
    data = ar.LOWER[data]
    starts, ends, first = ar.word_spans(data, bounds, ITEM_WORD)
    return ar.SpanHash(ar.word_hashes(data, starts, ends)), first


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out = values[: len(values) - width + 1].copy()
    for shift in range(1, width):
        np.minimum(out, values[shift : shift + len(out)], out=out)
    return out


def benchmark_windows(benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(item_id, width, win, gram): the windows of all items with their fingerprints."""
    kind = "array<struct<width: int, win: bigint, gram: bigint>>"

    @F.arrow_udf(kind)
    def windows(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, bounds in ar.stretches(column):
            hashes, first = _words(data, bounds)
            for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
                width = min(window, b - a)
                if width == 0:
                    out.append([])
                    continue
                at = np.arange(a, b - width + 1)
                wins = hashes(at, at + width).view(np.int64)
                if width < window:
                    grams = wins
                else:
                    at = np.arange(a, b - gram + 1)
                    grams = _sliding_min(hashes(at, at + gram), window - gram + 1).view(np.int64)
                out.append([{"width": width, "win": w, "gram": g} for w, g in zip(wins.tolist(), grams.tolist())])
        return pa.array(out, pa.list_(pa.struct({"width": pa.int32(), "win": pa.int64(), "gram": pa.int64()})))

    found = benchmark.select("item_id", F.explode(windows(F.col("text"))).alias("w"))
    return found.select("item_id", "w.width", "w.win", "w.gram").distinct()


def _pack(rows: pa.Table, window: int) -> dict:
    """Sorted windows with the numbers of their items, per width, the items' ids and the fingerprints of whole windows."""
    width, win, gram = (rows[name].to_numpy() for name in ("width", "win", "gram"))
    item = rows["item_id"].combine_chunks().dictionary_encode()
    known = item.indices.is_valid().to_numpy(zero_copy_only=False)
    names, item = item.dictionary, item.indices.fill_null(0).to_numpy(zero_copy_only=False)
    packed = {"grams": np.unique(gram[width == window].view(ar.U64)), "wins": {}, "names": names}
    for w in np.unique(width).tolist():
        chosen = width == w
        values, ids, named = win[chosen].view(ar.U64), item[chosen], known[chosen]
        order = np.argsort(values, kind="stable")
        keys, at = np.unique(values[order], return_index=True)
        packed["wins"][w] = (keys, np.append(at, len(order)), ids[order], named[order])
    return packed


def _lookup(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Position of each value in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(keys, values), len(keys) - 1)
    return np.where(keys[at] == values, at, -1)


def _hits(hashes: ar.SpanHash, first: np.ndarray, packed: dict, window: int, gram: int):
    """(start word, end word, width, index of the window) of all occurrences in a stretch of texts."""
    out = []
    for width, (keys, *_) in packed["wins"].items():
        good = np.flatnonzero(ar.fits(first, width))
        if not len(good):
            continue
        if width == window:
            grams = hashes.rolling(gram)
            chosen = _sliding_min(grams, window - gram + 1)[good]
            good = good[_lookup(packed["grams"], chosen) >= 0]
        at = _lookup(keys, hashes(good, good + width))
        found = at >= 0
        out.append((good[found], good[found] + width, np.full(found.sum(), width), at[found]))
    return [np.concatenate(part) for part in zip(*out)] if out else [np.zeros(0, np.int64)] * 4


def _annotate(packed_value, id_type: str, window: int, gram: int):
    @F.arrow_udf(f"{SPANS_TYPE}, items ARRAY<{id_type}>")
    def annotate(column: pa.Array) -> pa.Array:
        packed = packed_value.value
        words, spans, items = [], [], []
        for _, _, data, bounds in ar.stretches(column):
            hashes, first = _words(data, bounds)
            words.append(np.diff(first))
            start, end, width, index = _hits(hashes, first, packed, window, gram)
            text = np.searchsorted(first, start, "right") - 1
            order = np.argsort(text, kind="stable")
            edges = np.searchsorted(text[order], np.arange(len(first)))
            for t in range(len(first) - 1):
                mine = order[edges[t] : edges[t + 1]]
                if not len(mine):
                    spans.append([])
                    items.append([])
                    continue
                a, b = ar.union_of_spans(start[mine] - first[t], end[mine] - first[t])
                spans.append(np.stack([a, b], 1).ravel().tolist())
                ids = []
                for w in np.unique(width[mine]).tolist():
                    _, bound, item, named = packed["wins"][w]
                    for k in np.unique(index[mine][width[mine] == w]).tolist():
                        ids.append(item[bound[k] : bound[k + 1]][named[bound[k] : bound[k + 1]]])
                items.append(np.unique(np.concatenate(ids)).tolist())
        names = packed["names"]
        numbers = pa.array(items, pa.list_(pa.int64()))
        return pa.StructArray.from_arrays(
            [pa.array(np.concatenate(words) if words else [], pa.int64()), pa.array(spans, pa.list_(pa.int32())),
             pa.ListArray.from_arrays(numbers.offsets, names.take(numbers.flatten()))], ["n_words", "spans", "items"],
        )

    return annotate


def _prints(hashes: ar.SpanHash, first: np.ndarray, width: int, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and fingerprint of all windows of one width in a stretch of texts."""
    good = np.flatnonzero(ar.fits(first, width))
    if width < window or not len(good):
        return good, hashes(good, good + width)
    return good, _sliding_min(hashes.rolling(gram), window - gram + 1)[good]


def _of_each_text(first: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Positions of the starts that lie in each text; starts ascend."""
    return np.split(np.arange(len(start)), np.searchsorted(start, first[1:-1]))


def _fingerprints(text: Column, widths: list[int], window: int, gram: int) -> Column:
    """The distinct (width, gram) of a text."""

    @F.arrow_udf("array<struct<width: int, gram: bigint>>")
    def of(column: pa.Array) -> pa.Array:
        out = []
        for _, _, data, bounds in ar.stretches(column):
            hashes, first = _words(data, bounds)
            texts = [[] for _ in range(len(first) - 1)]
            for width in widths:
                start, prints = _prints(hashes, first, width, window, gram)
                for found, mine in zip(texts, _of_each_text(first, start)):
                    found += [{"width": width, "gram": g} for g in np.unique(prints[mine].view(np.int64)).tolist()]
            out += texts
        return pa.array(out, pa.list_(pa.struct({"width": pa.int32(), "gram": pa.int64()})))

    return of(text)


def _windows_at(text: Column, met: Column, window: int, gram: int) -> Column:
    """(start, width, win) of the windows of a text whose fingerprint is among those ``met``."""

    @F.arrow_udf("array<struct<start: int, width: int, win: bigint>>")
    def of(column: pa.Array, met: pa.Array) -> pa.Array:
        out = []
        for one, wanted in zip(column, met):
            _, _, data, bounds = next(ar.stretches(pa.array([one.as_py()], pa.string())))
            hashes, first = _words(data, bounds)
            pairs = wanted.values
            widths, grams = (pairs.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            found = []
            for width in np.unique(widths).tolist():
                start, prints = _prints(hashes, first, width, window, gram)
                start = start[np.isin(prints.view(np.int64), grams[widths == width])]
                wins = hashes(start, start + width).view(np.int64)
                found += [{"start": a, "width": width, "win": w} for a, w in zip(start.tolist(), wins.tolist())]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct({"start": pa.int32(), "width": pa.int32(), "win": pa.int64()})))

    return of(text, met)


def _merged(column: pa.Array) -> pa.Array:
    """Flat disjoint spans from structs (start, width) of a text."""
    out = []
    for hits in column:
        start, width = (hits.values.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        out.append(np.stack(ar.union_of_spans(start, start + width), 1).ravel().tolist())
    return pa.array(out, pa.list_(pa.int32()))


def _count_words(column: pa.Array) -> pa.Array:
    counts = [np.diff(_words(data, bounds)[1]) for _, _, data, bounds in ar.stretches(column)]
    return pa.array(np.concatenate(counts) if counts else [], pa.int64())


def _hits_by_join(rows: DataFrame, docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(key, spans, items) of each distinct text of ``docs`` that shares a window with an item; ``key`` is a hash of the text."""
    key = F.xxhash64("text").alias("key")
    widths = sorted(r.width for r in rows.select("width").distinct().collect())
    prints = docs.where("text IS NOT NULL").select(key, F.explode(_fingerprints(F.col("text"), widths, window, gram)).alias("p"))
    prints = prints.select("key", "p.*").join(rows.select("width", "gram").distinct(), ["width", "gram"], "left_semi").distinct()
    met = materialize(prints.groupBy("key").agg(F.collect_list(F.struct("width", "gram")).alias("met")), "windows-met")
    found = docs.where("text IS NOT NULL").select(key, "text").join(met, "key")
    found = found.select("key", F.explode(_windows_at(F.col("text"), F.col("met"), window, gram)).alias("w")).select("key", "w.*").distinct()
    known = rows.select("width", "win").distinct()
    hits = materialize(found.join(known, ["width", "win"], "left_semi"), "windows-hit")
    spans = hits.groupBy("key").agg(F.collect_list(F.struct("start", "width")).alias("hits")).select("key", F.arrow_udf(_merged, "array<int>")("hits").alias("spans"))
    items = hits.select("key", "width", "win").distinct().join(rows.select("width", "win", "item_id"), ["width", "win"])
    return spans.join(items.groupBy("key").agg(F.collect_set("item_id").alias("items")), "key")


def contamination(
    benchmark: DataFrame, docs: DataFrame, window: int = WINDOW, gram: int = GRAM, shared_windows: int = SHARED_WINDOWS
) -> DataFrame:
    """Rows of ``docs`` as one struct ``row`` beside the struct ``found``.

    It holds ``n_words``, ``spans`` (start and end word of each hit run in turn) and ``items`` (ids, of the type that they have).
    """
    if not 1 <= gram <= window:
        raise ValueError("a gram is at most as long as the window")
    spark = benchmark.sparkSession
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    id_type = benchmark.schema["item_id"].dataType.simpleString()
    rows = materialize(benchmark_windows(benchmark, window, gram), "benchmark-windows")
    if rows.count() <= shared_windows:
        packed = spark.sparkContext.broadcast(_pack(rows.toArrow(), window))
        return docs.select(row, _annotate(packed, id_type, window, gram)(F.col("text")).alias("found"))
    hits = materialize(_hits_by_join(rows, docs.select("text"), window, gram), "windows-found")
    found = F.struct(
        F.arrow_udf(_count_words, "bigint")("d.row.text").alias("n_words"), F.coalesce("h.spans", F.array().cast("array<int>")).alias("spans"),
        F.coalesce("h.items", F.array().cast(f"array<{id_type}>")).alias("items"),
    )
    joined = docs.select(row).alias("d").join(hits.alias("h"), F.xxhash64("d.row.text") == F.col("h.key"), "left")
    return joined.select("row", found.alias("found"))


def words_in(spans: Column) -> Column:
    """Number of words that the spans cover."""
    signed = F.transform(spans, lambda v, i: F.when(i % 2 == 1, v).otherwise(-v).cast("long"))
    return F.aggregate(signed, F.lit(0).cast("long"), lambda a, b: a + b)
