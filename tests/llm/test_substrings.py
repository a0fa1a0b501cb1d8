"""Substring dedup over bytes and words against plain counting."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from conftest_llm import texts_with_repeats
from pyspark.sql import functions as F

from perigee.llm import cover_dedup, repeats, suffix_levels


def bytes_expected(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i:i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i:i + length]] > 1:
                gone[i:i + length] = True
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone) if not g)
        out.append((len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length, gram, batches", [(60, 20, 3), (60, 20, 1), (200, 70, 4)])
def test_bytes_agree_with_counting(documents, length, gram, batches):
    texts = texts_with_repeats(length + batches)
    found = suffix_levels.removed_bytes(documents(list(enumerate(texts))), length, gram, batches)
    rows = {r.doc_id: r for r in found.collect()}
    for i, expected in enumerate(bytes_expected(texts, length)):
        r = rows[i]
        assert (r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) == expected


def test_bytes_of_repeated_rows_and_shared_ids(documents):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(300))
    rows = [(1, text), (1, text), (2, "other " * 3), (2, None), (None, "x" * 50)]
    found = suffix_levels.removed_bytes(documents(rows), 60, 20, 2).collect()
    assert len(found) == len(rows)
    assert [r.n_removed for r in found if r.doc_id == 1] == [len(text)] * 2
    assert {(r.n_bytes, r.n_removed) for r in found if r.doc_id == 2} == {(18, 0), (0, 0)}
    alone = suffix_levels.removed_bytes(documents([(1, text)]), 60, 20, 2).first()
    assert alone.n_removed == 0 and alone.spans == []


def test_empty_tables(documents):
    assert suffix_levels.removed_bytes(documents([]), 60, 20, 2).count() == 0
    assert cover_dedup.removed_words(documents([])).count() == 0


def test_levels_merge_geometrically(documents):
    docs = documents(list(enumerate(texts_with_repeats(5)))).select(F.xxhash64("doc_id").alias("row"), "text")
    levels = suffix_levels.SuffixLevels(3, 60, 20)
    shapes = []
    for k in range(4):
        levels.add(docs.where(F.pmod("row", F.lit(4)) == k))
        shapes.append(sorted(levels.levels))
    assert shapes == [[0], [1], [0, 1], [2]]


def words_expected(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            window = tuple(w[i:i + 20])
            if window in seen:
                gone[i:i + 20] = [True] * 20
            seen.add(window)
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_words_agree_with_a_scan_in_order(documents):
    rows = list(enumerate(texts_with_repeats(11, 90)))
    found = cover_dedup.removed_words(documents(rows[::-1]))
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found.collect()} == words_expected(rows)


def test_words_of_repeated_rows_are_one_document(documents):
    text = " ".join(f"v{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")]
    found = cover_dedup.removed_words(documents(rows)).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id or 0, r.n_removed) for r in found) == [(0, 40), (1, 0), (1, 0), (2, 40), (3, 0), (4, 0)]


def test_cover_brings_any_two_positions_together():
    cover, period = set(cover_dedup.COVER), cover_dedup.PERIOD
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_buckets_follow_the_bytes_of_the_texts(spark, documents):
    rows = list(enumerate(texts_with_repeats(13, 60)))
    docs = documents(rows)
    total = sum(len((t or "").encode()) for _, t in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert repeats.buckets_of(docs) == 1
        assert repeats.buckets_of(docs, 500) == -(-total // 500) > 10
        assert repeats.buckets_of(documents([]), 500) == repeats.buckets_of(documents([(1, None)]), 500) == 1
        words = cover_dedup.removed_words(docs, 500).collect()
        found = suffix_levels.removed_bytes(docs, 60, 20, 3, 100).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in words} == words_expected(rows)
    expected = bytes_expected([t for _, t in rows], 60)
    assert [(r.n_bytes, r.n_removed, len(r.spans) // 2, r.kept_sha256) for r in sorted(found, key=lambda r: r.doc_id)] == expected


def test_first_windows_over_several_tasks(documents):
    """Rows whose repeats are settled in their own batch keep their place in the order of documents."""
    draw = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(40)]
    passages = [list(draw.choice(vocabulary, draw.integers(15, 60))) for _ in range(15)]
    rows = []
    for doc_id in draw.choice(np.arange(-500, 3000), 300, replace=False).tolist():
        words = []
        for _ in range(draw.integers(0, 9)):
            words += passages[draw.integers(15)] if draw.random() < 0.5 else list(draw.choice(vocabulary, draw.integers(1, 30)))
        rows.append((doc_id, " ".join(words)))
    found = cover_dedup.removed_words(documents(rows).repartition(6)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == words_expected(sorted(rows))
