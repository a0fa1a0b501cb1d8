"""Benchmark decontamination against plain search."""

import re

import pytest
from conftest_llm import texts_with_repeats, words
from pyspark.sql import functions as F
import random

from perigee.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(texts, items, window=10):
    wins = {}
    for item, text in items:
        w = split(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[k:k + n]), set()).add(item)
    out = []
    for text in texts:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in wins:
                    hit.update(range(k, k + n))
                    found |= wins[tuple(w[k:k + n])]
        out.append((len(w), len(hit), sorted(i for i in found if i is not None)))
    return out


@pytest.mark.parametrize("shared", [1_000_000, 7])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_agrees_with_search(spark, documents, shared, kind):
    rng = random.Random(3)
    texts = texts_with_repeats(21)
    items = [(1, texts[-1]), (2, "Ünïcode, SS"), (3, None), (4, ""), (5, "... !"), (6, words(rng, 12)), (1, texts[-1]),
             (7, "w1"), (None, words(rng, 30)), (8, texts[-2][500:700])]
    texts += [f"before {items[5][1].upper()} after", items[8][1], words(rng, 5) + "; ünïcode -- ss, " + words(rng, 5)]
    texts += texts[-3:] * 20
    if kind == "string":
        items = [(None if i is None else f"item-{i}", t) for i, t in items]
    table = spark.createDataFrame(items, f"item_id {kind}, text string")
    rows = decontaminate.contamination(table, documents(list(enumerate(texts))), shared_windows=shared).select(
        "row.doc_id", "found.*", decontaminate.words_in(F.col("found.spans")).alias("n_hit")).collect()
    assert len(rows) == len(texts)
    for r, e in zip(sorted(rows), expected(texts, items)):
        assert (r.n_words, r.n_hit, sorted(r["items"])) == e


@pytest.mark.parametrize("shared", [1_000_000, 0])
def test_empty_tables(spark, documents, shared):
    nothing = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.contamination(nothing, documents([(1, "a b"), (2, None)]), shared_windows=shared - 1)
    assert [r[0] for r in found.select(F.size("found.spans")).collect()] == [0, 0]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontaminate.contamination(some, documents([]), shared_windows=shared).count() == 0
