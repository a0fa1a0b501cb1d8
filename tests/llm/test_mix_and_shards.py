"""Mixing and sharding against plain arithmetic."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
from conftest_llm import words
from pyspark.sql import functions as F

from perigee.llm import mixing, sharding


def mix_expected(rows):
    size = defaultdict(int)
    for _, text, source in rows:
        size[source] += len((text or "").encode().split())
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        rest = sum(size.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[o] for o in open_) for s in open_}
        over = [s for s in open_ if share[s] > 3 * size[s]]
        if not over:
            return size, {**target, **share}
        for s in over:
            target[s] = 3 * size[s]
            open_.discard(s)


@pytest.fixture
def mixed_rows():
    rng = random.Random(2)
    sizes = {"a": 200, "b": 5, "c": 40, "É": 30, None: 20, "empty": 0}
    rows = [(None if i == 3 else i, words(rng, rng.randrange(60)), s) for s, n in sizes.items() for i in range(n)]
    return [(i if r[0] is not None else None, *r[1:]) for i, r in enumerate(rows)] + [(9000, None, "empty"), (9001, "", "empty")]


def test_targets_and_taken_words(documents, mixed_rows):
    size, target = mix_expected(mixed_rows)
    docs = documents(mixed_rows)
    rows = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), mixing.seeded_key(F.col("doc_id"), F.col("text")).alias("key"))
    planned = {r.source: r for r in mixing.plan(rows.select("source", "size", "key")).collect()}
    assert {s: r.source_size for s, r in planned.items()} == dict(size)
    for s, r in planned.items():
        assert r.target == pytest.approx(target[s])
    taken = defaultdict(int)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        taken[r.source] += len((r.text or "").split())
        times[(r.doc_id, r.text)] += 1
    for s in size:
        assert abs(taken[s] - target[s]) <= 60, s
    assert max(times.values()) <= 3
    assert sorted(map(str, mixing.mix(docs).collect())) == sorted(map(str, out.collect()))


def test_mix_of_an_empty_table(documents):
    assert mixing.mix(documents([])).count() == 0
    assert mixing.mix(documents([(1, None, "a"), (2, "", None)])).count() == 0


def test_cut_follows_the_seeded_order(documents, mixed_rows):
    rows = documents(mixed_rows).select("source", mixing.word_count(F.col("text")).alias("size"), mixing.seeded_key(F.col("doc_id"), F.col("text")).alias("key"))
    for p in mixing.plan(rows).collect():
        own = sorted((hashlib.md5(f"mix-1:{'' if d is None else d}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest(), len((t or "").split()))
                     for d, t, s in mixed_rows if s == p.source)
        rest, before, extra = p.target - p.whole * p.source_size, 0, 0
        for key, n in own:
            if before + n / 2 <= rest and p.source_size:
                extra += n
            before += n
        assert sum(n for key, n in own if p.cut is not None and key < p.cut) == extra


def placed(docs, shards, **more):
    h, d = sharding.sort_key(F.col("text"), F.col("doc_id"))
    rows = docs.select("doc_id", "text", sharding.size_of(F.col("text")).alias("size"), h.alias("h"), d.alias("d")).persist()
    return sharding.shard(rows, rows.select("h", "d", "size"), shards, **more).collect()


def slots_are_gapless(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.shard].append(r.slot)
    return all(sorted(s) == list(range(len(s))) for s in by.values())


@pytest.mark.parametrize("piece_rows", [1000, 5])
def test_bytes_are_near_equal_and_slots_gapless(documents, piece_rows):
    rng = random.Random(8)
    hot = words(rng, 30)
    rows = [(i, hot if i % 3 == 0 else words(rng, rng.randrange(1, 80))) for i in range(1500)] + [(-1, None), (-2, ""), (None, "x")]
    found = placed(documents(rows), 7, piece_rows=piece_rows)
    assert len(found) == len(rows) and slots_are_gapless(found)
    load = defaultdict(int)
    for r in found:
        load[r.shard] += r.size
    assert set(load) == set(range(7))
    mean = sum(load.values()) / 7
    assert max(abs(v - mean) for v in load.values()) <= 2 * (sharding.TOLERANCE * mean + 600)
    # Equal texts stand together unless they are too many for that.
    where = defaultdict(set)
    for r in found:
        where[r.text].add(r.shard)
    assert sum(len(s) > 1 for t, s in where.items() if t != hot) == 0


def test_repeated_rows_and_tiny_tables(documents):
    same = placed(documents([(1, "a b c")] * 50), 4)
    assert len(same) == 50 and slots_are_gapless(same)
    assert sorted(Counter(r.shard for r in same).values()) == [12, 12, 13, 13]
    assert placed(documents([]), 4) == []
    assert len(placed(documents([(1, "a")]), 4)) == 1


def test_shard_documents_keeps_all_columns(documents):
    docs = documents([(i, f"text {i}") for i in range(30)])
    out = sharding.shard_documents(docs, 3)
    assert out.columns == [c for c in docs.columns if c != "shard"] + ["shard", "slot"]
    assert out.count() == 30 and slots_are_gapless(out.collect())


def test_rows_equal_in_text_and_id_are_dealt_over_shards(documents):
    rng = random.Random(12)
    table = documents([(None, "one text")] * 1000 + [(i, f"other {i} " + words(rng, 3)) for i in range(2000)])
    for out in (placed(table, 40), sharding.shard_documents(table, 40).withColumn("size", sharding.size_of(F.col("text"))).collect()):
        assert len(out) == 3000 and slots_are_gapless(out)
        load = Counter()
        for r in out:
            load[r.shard] += r.size
        mean = sum(load.values()) / 40
        assert set(load) == set(range(40))
        assert max(abs(v - mean) for v in load.values()) <= 2 * (sharding.TOLERANCE * mean + 60)


def test_rows_without_id_reach_the_target(documents):
    rng = random.Random(13)
    # A third of all rows agree in source, id and text; others of that source have no id either.
    rows = [(None, "a b c d e", "hot")] * 500 + [(None, f"n{i} " + words(rng, 4), "hot") for i in range(400)]
    rows += [(i, words(rng, 20), s) for i in range(300) for s in ("b", "c")]
    docs = documents(rows)
    size, target = mix_expected(rows)
    once = [sorted((r.source, r.text) for r in mixing.mix(docs).collect()) for _ in range(2)]
    assert once[0] == once[1]
    taken = Counter()
    for source, text in once[0]:
        taken[source] += len(text.split())
    for s in size:
        assert abs(taken[s] - target[s]) <= 10, s
    only = documents([(None, "a b c d e", "x")] * 301 + [(None, "a b c d e", None)] * 40)
    size, target = mix_expected([(None, "a b c d e", "x")] * 301 + [(None, "a b c d e", None)] * 40)
    taken = Counter(r.source for r in mixing.mix(only).collect())
    for s in size:
        assert abs(5 * taken[s] - target[s]) <= 2.5, s


def test_few_rows_around_a_boundary_are_fetched_once(documents, monkeypatch):
    rng = random.Random(14)
    # Rows up to three times, as the mix repeats them, and one text under many ids.
    rows = [row for i in range(400) for row in [(i, words(rng, rng.randrange(1, 80)))] * rng.randrange(1, 4)] + [(i, "hot") for i in range(900, 1200)]
    docs = documents(rows)
    keys = docs.select(*(c.alias(n) for c, n in zip(sharding.sort_key(F.col("text"), F.col("doc_id")), "hd")), sharding.size_of(F.col("text")).alias("size")).persist()
    passes, below = [], sharding._below
    monkeypatch.setattr(sharding, "_below", lambda bounds: passes.append(len(bounds)) or below(bounds))
    found = {}
    for held in (0, 7 * 100, sharding.HELD_ROWS):
        monkeypatch.setattr(sharding, "HELD_ROWS", held)
        del passes[:]
        found[held] = sharding.splitters(keys, 7)
        counted = len(passes)
    # The same boundaries however many keys are held; all of them in a single pass.
    assert found[0] == found[700] == found[held] and len(found[0][0]) == 6
    assert counted == 1
