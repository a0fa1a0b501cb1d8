"""The streaming encoder and decoder against the public library, and its lookahead against all continuations."""

import hashlib
import itertools
import json
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer as Public

from perigee.llm import bpe_stream as bs

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "a", "e", " ", "  ", "\n", "'", "s", "'ll", "'r", "1", "23", "!", "=", "<|endoftext|>", "<|endof", "é", "ß", "日本", " ", "\x1c", "\x85", "　", "🙂",
    "࢏", "\U00012550", "guarantee", "ing", " the", "\t", "̀", "²", "Ⅷ", "--", "​", "\r\n", "'VE",
]


@pytest.fixture(scope="module")
def public():
    return Public.from_file(PATH)


@pytest.fixture(scope="module")
def ours():
    return bs.Tokenizer(json.load(open(PATH)))


def toy(merges):
    vocab = {c: i for i, c in enumerate(bs.LETTERS)}
    for a, b in merges:
        vocab.setdefault(a + b, len(vocab))
    model = {"type": "BPE", "vocab": vocab, "merges": merges}
    return {"model": model, "pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}, "added_tokens": []}


def test_texts_in_chunks_of_any_size(public, ours):
    rng = random.Random(5)
    for _ in range(1500):
        text = "".join(rng.choice(ODD) for _ in range(rng.randrange(40)))
        wanted = public.encode(text, add_special_tokens=False).ids
        for chunk in (1, 2, 3, 7, 1000):
            assert bs.encode_text(ours, text, chunk) == wanted, (text, chunk)


def test_every_code_point(public, ours):
    for start in range(0, 0x110000, 0x800):
        points = [chr(p) for p in range(start, start + 0x800) if not 0xD800 <= p < 0xE000]
        text = "".join(f"a{c}1{c}!{c} " for c in points)
        assert bs.encode_text(ours, text) == public.encode(text, add_special_tokens=False).ids, hex(start)


def test_pieces_longer_than_any_window(public, ours, monkeypatch):
    monkeypatch.setattr(bs, "CHUNK", 64)
    rng = random.Random(8)
    for i in range(120):
        part = rng.choice(["a", "ab", "guaranteeing", "=", "-", " ", "\n", "1", "日", "xyzq", "࢏"])
        text = part * rng.randrange(100, 2000) if i % 2 else "".join(rng.choice("abcdeghinorstu") for _ in range(rng.randrange(500, 6000)))
        text = rng.choice(["x ", "'", "1 ", "", " "]) + text + rng.choice([" z", "b", "", "!", " ", "  y"])
        wanted = public.encode(text, add_special_tokens=False).ids
        for chunk in (50, 64, 1000):
            assert bs.encode_text(ours, text, chunk) == wanted


def test_memory_does_not_grow_with_the_text(ours, monkeypatch):
    monkeypatch.setattr(bs, "CHUNK", 256)
    for part in ("a", " ", "ab1", "é"):
        encoder, most = bs.Encoder(ours), 0
        for _ in range(400):
            encoder.feed(part * (100 // len(part)))
            most = max(most, len(encoder.rest) + len(encoder.window.held))
        assert most <= 2 * bs.CHUNK + ours.window + ours.longest


def test_lookahead_suffices():
    rng = random.Random(2)
    for _ in range(60):
        tokens, merges = list("abc"), []
        for _ in range(rng.randrange(2, 9)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if a + b not in tokens:
                merges.append([a, b])
                tokens.append(a + b)
        t = bs.Tokenizer(toy(merges))
        lookahead = t.lookahead
        for _ in range(40):
            start = bytes(rng.choice(b"abc") for _ in range(rng.randrange(1, 14)))
            stable = []
            at = 0
            for token in t.merge(start):
                at += len(t.bytes[token])
                if at <= len(start) - lookahead:
                    stable.append(token)
            for more in itertools.chain.from_iterable(itertools.product(b"abc", repeat=n) for n in range(5)):
                assert t.merge(start + bytes(more))[: len(stable)] == stable, (merges, start, more)


def test_lookahead_of_a_chain():
    assert bs.Tokenizer(toy([["a", "b"]])).lookahead == 1
    # c behind b takes a from its neighbour: two rules, one byte each.
    assert bs.Tokenizer(toy([["b", "c"], ["a", "b"]])).lookahead == 2
    assert bs.Tokenizer(toy([["a", "b"], ["b", "c"]])).lookahead == 1


def test_decoding(public, ours):
    rng = random.Random(4)
    for _ in range(2000):
        ids = [rng.randrange(50258) if rng.random() < 0.5 else rng.choice(ours.of_byte) for _ in range(rng.randrange(30))]
        wanted = public.decode(ids, skip_special_tokens=False)
        assert all(bs.decode_ids(ours, ids, chunk) == wanted for chunk in (1, 2, 5, 100))


def test_both_merges_agree(ours):
    rng = random.Random(6)
    for _ in range(500):
        token = [ours.of_byte[rng.choice(b"aeinorst \xc3\xa9")] for _ in range(rng.randrange(60))]
        assert ours._merge_few(list(token)) == ours._merge_many(list(token))


def test_refuses_other_vocabularies():
    late = toy([["a", "b"]])
    late["model"]["merges"] = [["ab", "c"], ["a", "b"]]
    late["model"]["vocab"]["abc"] = 999
    other = toy([]) | {"normalizer": {"type": "NFC"}}
    for spec in (late, other, toy([]) | {"pre_tokenizer": {"type": "Whitespace"}}):
        with pytest.raises(ValueError):
            bs.Tokenizer(spec)


def test_query_equals_the_library(spark, public, tmp_path):
    from perigee.llm.queries import op13_stream_bpe

    rng = random.Random(11)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randrange(60))) for _ in range(200)]
    texts += [None, "", texts[0], "x" * 200_000, "many words " * 20_000, "é" * 70_000]
    rows = [(i if i % 9 else None, text, "ids", 5) for i, text in enumerate(texts)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").write.parquet(path)
    wanted = []
    for doc_id, text, *_ in rows:
        ids = public.encode(text or "", add_special_tokens=False).ids
        whole = public.decode(ids, skip_special_tokens=False)
        wanted.append((doc_id, len(ids), *(hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), whole))))
    found = op13_stream_bpe(spark, str(tmp_path))
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, wanted))


def test_ids_and_texts_as_columns(spark):
    coder = bs.Coder(spark, PATH)
    df = spark.createDataFrame([("hello world", [15496, None, 99999999, 995]), (None, None)], "text string, ids array<int>")
    rows = df.select(coder.encode(F.col("text")).alias("e"), coder.decode(F.col("ids")).alias("d")).collect()
    assert rows[0].e == [31373, 995] and rows[0].d == "Hello world" and tuple(rows[1]) == ([], "")
    assert df.limit(0).select(coder.encode(F.col("text"))).count() == 0
