"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

Words are counted first.  One inserted or deleted letter changes the vector of letter counts at one place by one; one replaced
letter raises one place and lowers another, so near words lie within an L1 distance of two.  For each length of words there is a
k-d tree over these vectors.  A word searches the tree of its own length (at most one count more and one less on its way to a box)
and the tree of the next length (one count more); a box that needs more than that is pruned.  So each pair is met from
one side only.

The upper part of each tree is fitted on a bounded sample (``SAMPLE`` words of smallest hash) and cuts the vocabulary into cells;
every word is a resident of one cell and a visitor of the cells its search reaches, and (length, cell) is the key of one exchange.
The sample decides how evenly cells are filled and nothing else: a pair meets wherever the cuts lie.  Inside a cell the tree goes on
over the distinct vectors, with all visitors of a node walking down together.

Near vectors are no near words yet: their words are compared by what is left around the letter that differs, in a join over those
places, so that even large classes of words with equal counts are never paired one by one; letters are compared last.

A word's form is its near word of largest count, if that is ``RATIO`` times its own.  Counts grow by that ratio along a chain of forms,
so chains have at most log_RATIO(largest count) steps and roots are found by that many doublings.

Defined results: NULL and empty texts hold no words; a NULL doc_id counts as empty text in the key of the deleted letters; repeated rows
count as often as they stand there; ties of forms go to the word that is smaller in code point order; runs of any length are
words; other columns are not looked at.  An empty table, or one without words, gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from perigee.session import materialize

LEAST_LETTERS, LEAST_COUNT, RATIO, DELETE_EVERY = 6, 5, 5, 199
SAMPLE, CELL, LEAST_SAMPLED, LEAF = 1 << 16, 1024, 16, 16
FLUSH = 100_000
BLOCK = 1 << 21
# ASCII letters and the two bytes of U+00C0 to U+00FF, after lower-casing ASCII.
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
POINT = re.compile(rb"[a-z]|\xc3[\x80-\xbf]")
LETTERS = 26 + 64
WORD_ROWS = "word string, n long"


def _points(run: bytes) -> int:
    return len(run) - run.count(b"\xc3")


def words_of(doc_id: int | str | None, text: str, delete_every: int = DELETE_EVERY) -> Counter:
    """Counts of the words of one text, with a letter deleted from those runs that the checksum picks."""
    seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    found = Counter()
    for run, n in Counter(RUN.findall(text.encode().lower())).items():
        h = zlib.crc32(run, seed)
        if h % delete_every == 0:
            points = POINT.findall(run)
            del points[h % len(points)]
            run = b"".join(points)
        found[run] += n
    return found


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"word": pa.array([w.decode() for w in counts], pa.string()), "n": pa.array(counts.values(), pa.int64())})

    seen = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            for word, n in words_of(doc_id, text.as_py() or "").items():
                if _points(word) >= LEAST_LETTERS:
                    seen[word] += n
            if len(seen) >= FLUSH:
                yield rows(seen)
                seen = Counter()
    if seen:
        yield rows(seen)


def vocabulary(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words of all texts that occur at least ``least`` times."""
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text").where("text IS NOT NULL").mapInArrow(_count, WORD_ROWS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as rows of letter numbers: a to z, then U+00C0 to U+00FF."""
    points = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).reshape(len(words), -1)
    return np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.uint8)


def _vectors(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row."""
    place = np.arange(len(codes))[:, None] * LETTERS + codes
    return np.bincount(place.ravel(), minlength=len(codes) * LETTERS).reshape(len(codes), LETTERS).astype(np.int32)


def _cut(vectors: np.ndarray) -> tuple[int, int] | None:
    """The (letter, count) that halves these vectors best: counts up to it go left.  None if all are equal."""
    best, cut, n = 0, None, len(vectors)
    for t in range(int(vectors.max(initial=0))):
        left = (vectors <= t).sum(axis=0)
        smaller = np.minimum(left, n - left)
        letter = int(smaller.argmax())
        if smaller[letter] > best:
            best, cut = int(smaller[letter]), (letter, t)
    return cut


class Tree:
    """Cuts of one length's vectors, as nested (letter, count, left, right); a leaf is the number of a cell."""

    def __init__(self, vectors: np.ndarray, words_each: float, cell: int):
        self.cells = 0
        self.top = self._grow(vectors, words_each, cell)

    def _grow(self, vectors, words_each, cell):
        cut = _cut(vectors) if len(vectors) * words_each > cell and len(vectors) >= 2 * LEAST_SAMPLED else None
        if cut is None:
            self.cells += 1
            return self.cells - 1
        left = vectors[:, cut[0]] <= cut[1]
        return (*cut, self._grow(vectors[left], words_each, cell), self._grow(vectors[~left], words_each, cell))

    def reached(self, vectors: np.ndarray, more: int, less: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that hold a vector with at most ``more`` counts more and ``less`` fewer than the row's."""
        rows, cells = [], []
        for idx, leaf in _walk(self.top, vectors, more, less):
            rows.append(idx)
            cells.append(np.full(len(idx), leaf))
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int64), *cells])


def _turns(vectors, idx, more, less, letter, t):
    """Who goes left and right at a cut, with what is left of their allowance."""
    count = vectors[idx, letter]
    left, right = (count <= t) | ((count == t + 1) & (less > 0)), (count > t) | ((count == t) & (more > 0))
    return (idx[left], more[left], less[left] - (count[left] > t)), (idx[right], more[right] - (count[right] <= t), less[right])


def _walk(top, vectors, more, less):
    """(rows, leaf) of each leaf that rows reach."""
    start = np.arange(len(vectors))
    stack = [(top, start, np.full(len(start), more), np.full(len(start), less))]
    while stack:
        node, idx, up, down = stack.pop()
        if not len(idx):
            continue
        if not isinstance(node, tuple):
            yield idx, node
            continue
        letter, t, left, right = node
        to_left, to_right = _turns(vectors, idx, up, down, letter, t)
        stack += [(left, *to_left), (right, *to_right)]


def fit_trees(vocab: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> dict[int, Tree]:
    """A tree for each length in the sample; at most sample / LEAST_SAMPLED cells in all, so the trees stay small."""
    total = vocab.count()
    words = [r[0] for r in vocab.select("word").orderBy(F.xxhash64("word"), "word").limit(sample).collect()]
    by_length: dict[int, list[str]] = {}
    for word in words:
        by_length.setdefault(len(word), []).append(word)
    each = total / max(len(words), 1)
    return {length: Tree(_vectors(_codes(found)), each, cell) for length, found in by_length.items()}


HOME, SAME, SHORTER = 0, 1, 2
ROUTED = "length int, cell int, role int, word string, n long"


def _route(trees: dict[int, Tree]):
    """Sends each word home and to the cells where near words may live."""

    def route(batches):
        for batch in batches:
            words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            lengths = np.array([len(w) for w in words])
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                vectors = _vectors(_codes([words[i] for i in at]))
                if length in trees:
                    row, home = trees[length].reached(vectors, 0, 0)
                    home = home[np.argsort(row)]
                    row, cell = trees[length].reached(vectors, 1, 1)
                    # Of two cells the words of the first visit the second.
                    row, cell = row[cell > home[row]], cell[cell > home[row]]
                else:
                    home, row, cell = np.zeros(len(at), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                longer, far = trees[length + 1].reached(vectors, 1, 0) if length + 1 in trees else (np.arange(len(at)), np.zeros(len(at), np.int64))
                who = np.concatenate([np.arange(len(at)), row, longer])
                role = np.repeat([HOME, SAME, SHORTER], [len(at), len(row), len(longer)])
                yield pa.RecordBatch.from_pydict({
                    "length": pa.array(length + (role == SHORTER), pa.int32()), "cell": pa.array(np.concatenate([home, cell, far]), pa.int32()),
                    "role": pa.array(role, pa.int32()), "word": pa.array([words[i] for i in at[who]], pa.string()), "n": pa.array(n[at[who]], pa.int64()),
                })

    return route


class _Words:
    """Words of one length with their distinct vectors; words stand in the order of their vectors."""

    def __init__(self, words: list[str], n: np.ndarray):
        codes = _codes(words)
        vectors = _vectors(codes)
        self.vectors, of = np.unique(vectors, axis=0, return_inverse=True)
        order = np.argsort(of.ravel(), kind="stable")
        self.codes, self.n = codes[order], n[order]
        self.words = np.array(words, object)[order]
        self.size = np.bincount(of.ravel(), minlength=len(self.vectors))
        self.first = np.cumsum(self.size) - self.size

    def of(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``vector``, word) for all words of these vectors."""
        size = self.size[vector]
        at = np.repeat(np.arange(len(vector)), size)
        return at, np.repeat(self.first[vector] - (np.cumsum(size) - size), size) + np.arange(len(at))


def _near_vectors(residents: np.ndarray, visitors: np.ndarray, more: int, less: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(visitor, resident) pairs of vectors that differ by exactly ``more`` counts more and ``less`` fewer, by a tree over the residents."""
    start = np.arange(len(visitors))
    stack = [(np.arange(len(residents)), start, np.full(len(start), more), np.full(len(start), less))]
    while stack:
        held, idx, up, down = stack.pop()
        if not len(idx) or not len(held):
            continue
        cut = _cut(residents[held]) if len(held) > LEAF else None
        if cut:
            left = residents[held, cut[0]] <= cut[1]
            to_left, to_right = _turns(visitors, idx, up, down, *cut)
            stack += [(held[left], *to_left), (held[~left], *to_right)]
            continue
        step = max(1, BLOCK // (len(held) * LETTERS))
        for a in range(0, len(idx), step):
            apart = residents[held][None, :, :] - visitors[idx[a : a + step]][:, None, :]
            v, r = np.nonzero((np.abs(apart).sum(axis=2) == more + less) & (np.maximum(apart, 0).sum(axis=2) == more))
            if len(v):
                yield idx[a : a + step][v], held[r]


def _weights(length: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(length, 0x9E3779B97F4A7C15, np.uint64))


def _around(codes: np.ndarray, letter: np.ndarray, closed: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, hash of the rest) for each place of ``letter`` in a row; ``closed``: letters behind it move up by one."""
    row, place = np.nonzero(codes == letter[:, None])
    weights = _weights(codes.shape[1])
    value = (codes.astype(np.uint64) + np.uint64(1)) * weights
    if not closed:
        return row, place, value.sum(axis=1, dtype=np.uint64)[row] - value[row, place]
    moved = (codes[:, 1:].astype(np.uint64) + np.uint64(1)) * weights[:-1]
    before = np.cumsum(value, axis=1, dtype=np.uint64) - value
    behind = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
    behind = np.concatenate([behind, np.zeros((len(codes), 1), np.uint64)], axis=1)
    return row, place, before[row, place] + behind[row, place]


def _join(left: list[np.ndarray], right: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows of both sides that agree in all keys."""
    import pandas as pd

    keys = [f"k{i}" for i in range(len(left))]
    a = pd.DataFrame(dict(zip(keys, left))).assign(a=np.arange(len(left[0])))
    b = pd.DataFrame(dict(zip(keys, right))).assign(b=np.arange(len(right[0])))
    both = a.merge(b, on=keys)
    return both["a"].to_numpy(), both["b"].to_numpy()


def _near_words(visitors: _Words, residents: _Words, v: np.ndarray, r: np.ndarray, same_length: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of near vectors the pairs of words (visitor, resident) that differ by one letter."""
    apart = residents.vectors[r] - visitors.vectors[v]
    pair_r, word_r = residents.of(r)
    pair_v, word_v = visitors.of(v)
    gained = apart.argmax(axis=1)
    row, place, rest = _around(residents.codes[word_r], gained[pair_r], not same_length)
    if same_length:
        lost = apart.argmin(axis=1)
        own, own_place, own_rest = _around(visitors.codes[word_v], lost[pair_v], False)
        a, b = _join([pair_v[own], own_place, own_rest], [pair_r[row], place, rest])
        x, y = word_v[own[a]], word_r[row[b]]
        right = (visitors.codes[x] != residents.codes[y]).sum(axis=1) == 1
    else:
        weights = _weights(visitors.codes.shape[1])
        whole = ((visitors.codes[word_v].astype(np.uint64) + np.uint64(1)) * weights).sum(axis=1, dtype=np.uint64)
        a, b = _join([pair_v, whole], [pair_r[row], rest])
        x, y, gap = word_v[a], word_r[row[b]], place[b]
        codes = residents.codes[y]
        shut = np.where(np.arange(codes.shape[1] - 1) < gap[:, None], codes[:, :-1], codes[:, 1:])
        right = (visitors.codes[x] == shut).all(axis=1)
    # A doubled letter can be taken out at two places.
    found = np.unique(np.stack([x[right], y[right]], axis=1), axis=0)
    return found[:, 0], found[:, 1]


EDGES = "word string, n long, near string, near_n long"


def _search(table: pa.Table) -> pa.Table:
    """Near pairs of one cell, in both directions."""
    role, n = table["role"].to_numpy(), table["n"].to_numpy()
    words = table["word"].to_pylist()

    def of(kind: int) -> _Words | None:
        at = np.flatnonzero(role == kind)
        return _Words([words[i] for i in at], n[at]) if len(at) else None

    residents = of(HOME)
    found: list[tuple] = []
    for kind, visitors in ((HOME, residents), (SAME, of(SAME)), (SHORTER, of(SHORTER))):
        if residents is None or visitors is None:
            continue
        same = kind != SHORTER
        each = residents.codes.shape[1]
        for v, r in _near_vectors(residents.vectors, visitors.vectors, 1, int(same)):
            if kind == HOME:
                v, r = v[v < r], r[v < r]
            # Pairs in blocks of bounded numbers of letters.
            held = np.cumsum((visitors.size[v] + residents.size[r]) * each)
            edges = np.unique(np.searchsorted(held, np.arange(0, int(held[-1]) if len(held) else 0, BLOCK)))
            for a, b in zip(edges, [*edges[1:], len(v)]):
                x, y = _near_words(visitors, residents, v[a:b], r[a:b], same)
                found.append((visitors.words[x], visitors.n[x], residents.words[y], residents.n[y]))
    a, an, b, bn = (np.concatenate(part) for part in zip(*found)) if found else ([], [], [], [])
    return pa.table({
        "word": pa.array([*a, *b], pa.string()), "n": pa.array([*an, *bn], pa.int64()),
        "near": pa.array([*b, *a], pa.string()), "near_n": pa.array([*bn, *an], pa.int64()),
    })


def near_words(vocab: DataFrame, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, n, near, near_n): all pairs of words (word, n) one edit apart, once in each direction."""
    trees = fit_trees(vocab, sample, cell)
    return vocab.mapInArrow(_route(trees), ROUTED).groupBy("length", "cell").applyInArrow(_search, EDGES)


def variants(vocab: DataFrame, ratio: int = RATIO, sample: int = SAMPLE, cell: int = CELL) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the words (word, n); ``vocab`` is read several times, so write it first."""
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near")))
    near = near_words(vocab, sample, cell).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    known = vocab.join(near, "word", "left").withColumn("takes", -F.col("best.minus") >= ratio * F.col("n"))
    formed = materialize(known.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("takes"), F.col("best.near")).alias("form"), F.when(F.col("takes"), -F.col("best.minus")).alias("form_n"),
    ), "variants-formed")
    links = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = formed.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(1 + math.log(most, ratio))) if most > 1 else 0):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "variants-roots")
    return formed.join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def variants_of(docs: DataFrame) -> DataFrame:
    """The variants among the words of all texts of ``docs`` (doc_id, text)."""
    return variants(materialize(vocabulary(docs), "variants-words"))
