"""SimHash near-duplicates and components against comparison of all pairs."""

import random

import numpy as np
import pytest
import xxhash
from conftest_llm import texts_with_repeats, words
from pyspark.sql import functions as F

from perigee.llm import simhash
from perigee.llm.components import components


def print_of(text):
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i:i + 3]) for i in range(max(1, len(parts) - 2))]
    values = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))


def groups(n, links):
    root = list(range(n))
    for a, b in links:
        ra, rb = a, b
        while root[ra] != ra:
            ra = root[ra]
        while root[rb] != rb:
            rb = root[rb]
        root[max(ra, rb)] = min(ra, rb)
    out = []
    for i in range(n):
        while root[i] != i:
            i = root[i]
        out.append(i)
    return out


def test_agrees_with_all_pairs(documents):
    rng = random.Random(4)
    texts = texts_with_repeats(31, 40)
    base = [words(rng, 400) for _ in range(4)]
    texts += [" ".join(w if rng.random() > 0.004 else "zz" for w in b.split()) for b in base for _ in range(8)]
    prints = [print_of(t) for t in texts]
    pairs = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert any(prints[i] != prints[j] for i, j in pairs)
    rows = simhash.near_duplicates(documents(list(enumerate(texts))), leaf_rows=4).collect()
    got = {r.doc_id: (r.f % (1 << 64), r.component_id) for r in rows}
    assert got == {i: (p, g) for i, (p, g) in enumerate(zip(prints, groups(len(prints), pairs)))}


@pytest.mark.parametrize("leaf_rows", [2, 16, 10_000])
def test_links_of_crowded_and_spread_fingerprints(spark, leaf_rows):
    rng = np.random.default_rng(leaf_rows)
    f = rng.integers(0, 1 << 64, 60, dtype=np.uint64)
    near = [int(v) ^ (1 << int(a)) ^ (1 << int(b)) for v in f[:30] for a, b in rng.integers(0, 64, (4, 2))]
    crowd = [0xABCDEF << 40 | i for i in range(40)]
    values = sorted(set(f.tolist()) | set(near) | set(crowd))
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    table = spark.createDataFrame([(int(np.uint64(v).view(np.int64)),) for v in values], "f long")
    at = {int(np.uint64(v).view(np.int64)): i for i, v in enumerate(values)}
    found = [(at[r.a], at[r.b]) for r in simhash.links(table, leaf_rows).collect()]
    assert all((values[a] ^ values[b]).bit_count() >= 0 for a, b in found)
    assert groups(len(values), found) == groups(len(values), pairs)


def test_one_of_each_keeps_the_smallest_id_once(documents):
    rng = random.Random(9)
    a, b = words(rng, 300), words(rng, 300)
    near = a.replace(a.split()[7], "other", 1)
    rows = [(5, a), (3, a), (3, a), (9, near), (4, b), (None, b), (7, None), (8, "")]
    kept = simhash.one_of_each(documents(rows))
    assert kept.columns == documents(rows).columns
    linked = (print_of(a) ^ print_of(near)).bit_count() <= 2
    assert sorted(r.doc_id for r in kept.collect()) == ([3, 4, 7] if linked else [3, 4, 7, 9])


def test_rows_without_id_name_no_component(documents):
    rows = simhash.near_duplicates(documents([(None, "a b c d"), (None, "a b c d"), (1, "x y z")])).collect()
    assert sorted((r.component_id or 0) for r in rows) == [0, 0, 1]


def test_different_texts_without_id_all_stay(documents):
    texts = ["a b c d", "k l m n", "k l m n", "x y z"]
    kept = simhash.one_of_each(documents([(None, t) for t in texts] + [(1, "x y z")]))
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "a b c d"), (0, "k l m n"), (1, "x y z")]


def test_empty_table(documents):
    assert simhash.near_duplicates(documents([])).count() == 0
    assert simhash.one_of_each(documents([])).count() == 0


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(200)] + [(500, 501), (501, 502), (502, 500), (7, 7)]
    found = components(spark.createDataFrame(chain, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {**{i: 0 for i in range(1, 201)}, 501: 500, 502: 500}


def test_of_repeated_rows_the_least_stays(spark):
    rows = [(1, "a b c", "z", {"k": 2}), (1, "a b c", "y", {"k": 1}), (None, "d e f", "q", None), (None, "d e f", "p", None), (3, "g h i", "x", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, row string, n map<string,int>")
    for order in (table, table.orderBy(F.desc("row"))):
        kept = simhash.one_of_each(order)
        assert kept.columns == table.columns
        assert sorted((r.text, r.row) for r in kept.collect()) == [("a b c", "y"), ("d e f", "p"), ("g h i", "x")]
