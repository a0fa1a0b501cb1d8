"""Spelling variants against all pairs of words."""

import random
import zlib

import numpy as np
import pytest

from perigee.llm import variants as va


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def by_all_pairs(n):
    out = []
    for word in n:
        near = [other for other in n if one_edit(word, other)]
        best = min(near, key=lambda o: (-n[o], o), default=None)
        out.append([word, best if best and n[best] >= 5 * n[word] else None, None, n[word], len(near)])
    forms = {row[0]: row[1] for row in out}
    for row in out:
        root = row[0]
        while forms[root]:
            root = forms[root]
        row[2] = root
        row.append(n[row[1]] if row[1] else None)
    return sorted(map(tuple, out), key=repr)


def vocabulary_by_hand(rows):
    counts = {}
    for doc_id, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                if h % 199 == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                counts[run] = counts.get(run, 0) + 1
                run = ""
    return {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}


def changed(rng, word, letters):
    at, kind = rng.randrange(len(word)), rng.randrange(4)
    if kind == 0:
        return word[:at] + rng.choice(letters) + word[at:]
    if kind == 1:
        return word[:at] + word[at + 1 :]
    if kind == 2:
        return word[:at] + rng.choice(letters) + word[at + 1 :]
    return "".join(rng.sample(word, len(word)))


def words_with_edits(seed, n, letters="abcdeé÷"):
    rng = random.Random(seed)
    out = {"aaaaaa": 900, "aaaaaaa": 30, "aaaaaaaa": 6}
    while len(out) < n:
        word = "".join(rng.choice(letters) for _ in range(rng.randrange(6, 10)))
        for _ in range(rng.randrange(1, 6)):
            if len(word) >= 6:
                out[word] = rng.choice([5, 6, 24, 25, 30, 124, 125, 700, 4000])
            word = changed(rng, word, letters)
    return out


@pytest.mark.parametrize("cell, sample", [(1 << 20, 1 << 16), (16, 1 << 16), (16, 60)])
def test_variants_equal_all_pairs(spark, cell, sample):
    n = words_with_edits(cell + sample, 700)
    vocab = spark.createDataFrame(list(n.items()), va.WORD_ROWS)
    found = va.variants(vocab, sample=sample, cell=cell)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(map(tuple, found.collect()), key=repr) == by_all_pairs(n)


def test_large_classes_of_equal_counts(spark):
    rng = random.Random(3)
    n = {"".join(rng.sample("abcdefgh", 8)): 5 for _ in range(400)} | {"".join(rng.sample("abcdefgx", 8)): 30 for _ in range(400)}
    found = va.variants(spark.createDataFrame(list(n.items()), va.WORD_ROWS), cell=8)
    assert sorted(map(tuple, found.collect()), key=repr) == by_all_pairs(n)


def test_search_prunes_boxes():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefghijklm") for _ in range(8)) for _ in range(4000)]
    vectors = va._vectors(va._codes(words))
    tree = va.Tree(vectors, 1, 64)
    _, home = tree.reached(vectors, 0, 0)
    row, cell = tree.reached(vectors, 1, 1)
    assert len(home) == len(words) and np.bincount(home).max() <= 400
    assert tree.cells > 30 and len(row) < 0.5 * tree.cells * len(words)
    far, _ = tree.reached(vectors, 1, 0)
    assert len(home) < len(far) < len(row)


def test_words_of_texts(spark, documents):
    rng = random.Random(2)
    pool = ["Éclairs", "éclair", "HOUSES", "housés", "x" * 3000, "house÷s", "naïveté", "straße"] + list(words_with_edits(9, 60))
    rows = [(i % 190, " ".join(rng.choice(pool) + rng.choice([".", "-", "1", "\n", "日"]) for _ in range(120))) for i in range(250)]
    rows += [(None, "Houses " * 7), (None, None), (3, None), (4, ""), rows[0], rows[0]]
    found = {r.word: r.n for r in va.vocabulary(documents(rows)).collect()}
    assert found == vocabulary_by_hand(rows)
    assert len(found) > 60 and any(len(w) > 2000 for w in found)
    out = va.variants_of(documents(rows)).collect()
    assert sorted(map(tuple, out), key=repr) == by_all_pairs(found)


def test_empty_tables(spark, documents):
    for rows in ([], [(1, None), (2, ""), (3, "a b c")]):
        assert va.variants_of(documents(rows)).collect() == []


def test_tasks_flush_what_they_count(spark, documents, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(va, "FLUSH", 3)
    batch = pa.RecordBatch.from_pydict({"doc_id": ["1", "2"], "text": ["abcdef abcdeg abcdeh", "abcdef"]})
    parts = [dict(zip(b["word"].to_pylist(), b["n"].to_pylist())) for b in va._count([batch])]
    assert len(parts) == 2 and sum(p.get("abcdef", 0) for p in parts) == 2
