"""Texts of an Arrow column as numpy arrays: bytes, words, and hashes of any span.

A column arrives in a task as one run of UTF-8 bytes with offsets.  Everything here works on
that run, a bounded stretch of whole texts at a time, so memory follows the longest text and
no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 19
# Any odd base and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that any of their bits can serve for ranking or bucketing."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U64(27))
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(BASE))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the bounds of its texts; NULL is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, bounds, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(bounds, np.int64)[column.offset : column.offset + n + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def stretches(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end text, bytes, bounds from 0) for runs of whole texts of about ``limit`` bytes."""
    data, offsets = utf8(column)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class _Powers:
    def __init__(self):
        self.up = self.down = np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << int(n - 1).bit_length()
            for name, base in (("up", BASE), ("down", INVERSE)):
                steps = np.full(size, base, U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


powers = _Powers()


class SpanHash:
    """64-bit hash of any span of a sequence of 64-bit values, by prefix sums modulo 2**64."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, down = powers(n + 1)
        self.prefix = np.zeros(n + 1, U64)
        np.cumsum(values * down[:n], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of values[start:end], the same wherever equal values stand."""
        return mix((self.prefix[end] - self.prefix[start]) * self.up[start])

    def rolling(self, width: int) -> np.ndarray:
        """Hash of each run of ``width`` values."""
        n = len(self.prefix) - width
        return mix((self.prefix[width:] - self.prefix[:-width]) * self.up[:n]) if n > 0 else np.zeros(0, U64)


def byte_set(pattern: bytes) -> np.ndarray:
    """Table of 256 flags, set for the given bytes."""
    table = np.zeros(256, bool)
    table[np.frombuffer(pattern, np.uint8)] = True
    return table


# Words between blanks: everything but space, tab, newline, vertical tab, form feed, return.
NO_BLANK = ~byte_set(b" \t\n\v\f\r")
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_spans(data: np.ndarray, bounds: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all texts, and for each text the index of its first word."""
    held = inside[data]
    starts, ends = held.copy(), held.copy()
    starts[1:] &= ~held[:-1]
    ends[:-1] &= ~held[1:]
    inner = bounds[1:-1]
    cut = inner[inner < len(data)]
    starts[cut] = held[cut]
    cut = inner[inner > 0] - 1
    ends[cut] = held[cut]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return SpanHash(BYTE_VALUES[data])(starts, ends)


def fits(first: np.ndarray, width: int) -> np.ndarray:
    """Whether ``width`` words from each word on belong to one text; ``first`` as of word_spans."""
    n = int(first[-1])
    good = np.zeros(max(n - width + 1, 0), bool)
    if len(good):
        text_end = np.repeat(first[1:], np.diff(first))
        good = np.arange(len(good)) + width <= text_end[: len(good)]
    return good


def union_of_spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Disjoint, sorted spans that cover the same positions; touching spans become one."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(starts), bool)
    new[1:] = starts[1:] > ends[:-1]
    last = np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)
    return starts[new], ends[last]


def list_array(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """One list per text from flat values and the number of values of each text."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))
