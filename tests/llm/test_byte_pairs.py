"""Byte pairs against the tokenizers library."""

import hashlib
import os
import random

import pytest

from matchweave.llm import byte_pairs

pytestmark = pytest.mark.skipif(not os.path.exists(byte_pairs.VOCABULARY), reason="no vocabulary")
LETTERS = "ab 'sé中\U0001f600\t\n\r\x1c\x1d\x85\xa0 　٠²́x1,.<|endoftext|>'ll᠎​﻿ǅⅠ"


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("tokenizers").Tokenizer.from_file(byte_pairs.VOCABULARY)


@pytest.fixture(scope="module")
def vocabulary():
    return byte_pairs.Vocabulary.load(byte_pairs.VOCABULARY)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_any_text(library, vocabulary):
    draw, encoder = random.Random(1), byte_pairs.Encoder(vocabulary)
    texts = ["".join(draw.choice(LETTERS) for _ in range(draw.randint(0, 40))) for _ in range(800)]
    texts += [t + draw.choice(["<|endoftext|>", "  <|endoftext|> ", "<|endoftext|><|endoftext|>b"]) + t for t in texts[:200]]
    flat, sizes = encoder.encode(texts)
    want = [ids_of(library, t) for t in texts]
    assert sizes.tolist() == list(map(len, want)) and flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("word", ["a" * 3000, "ab" * 700 + "é" * 301, "中文" * 400, "supercalifragilistic" * 40, "a" * 256, "a" * 257])
def test_long_words(library, vocabulary, word):
    assert byte_pairs.Encoder(vocabulary).encode([word])[0].tolist() == ids_of(library, word)


def test_both_trees_agree(vocabulary):
    draw = random.Random(2)
    for _ in range(100):
        raw = bytes(draw.choice(b"eaintors") for _ in range(draw.randint(2, 60)))
        flat, _ = byte_pairs.encoded_words([raw.decode()], vocabulary)
        assert byte_pairs.merged_alone([int(vocabulary.of_byte[b]) for b in raw], vocabulary) == flat.tolist()


def test_any_ids(library, vocabulary):
    import numpy as np

    draw = random.Random(3)
    for _ in range(200):
        ids = [draw.randint(0, 50256) for _ in range(draw.randint(0, 12))]
        assert byte_pairs.decoded(np.array(ids, np.int64), np.array([len(ids)]), vocabulary).to_pylist() == [library.decode(ids, skip_special_tokens=False)]


def test_a_full_memory_starts_anew(library, vocabulary, monkeypatch):
    monkeypatch.setattr(byte_pairs, "CACHE", 3)
    encoder = byte_pairs.Encoder(vocabulary)
    for text in ("one two three four five", "three four six <|endoftext|> one", "two two seven"):
        assert encoder.encode([text])[0].tolist() == ids_of(library, text)


def test_documents(spark, library):
    texts = ["Hello, world!\n\n  It's 2024's end.", None, "", "same", "same", "x" * 5000 + " y", " <|endoftext|>é"]
    df = spark.createDataFrame([(i if i else None, t, 5, ["a"]) for i, t in enumerate(texts)], "doc_id long, text string, ids int, decoded array<string>")
    told = byte_pairs.decode(byte_pairs.encode(df))
    assert told.columns == ["doc_id", "text", "ids", "decoded"]
    rows = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_pairs.digests(told).collect())
    for (i, n, a, b), t in zip(rows, texts, strict=True):
        ids = ids_of(library, t or "")
        text = library.decode(ids, skip_special_tokens=False)
        assert (n, a, b) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()) and text == (t or ""), i
    assert byte_pairs.digests(byte_pairs.decode(byte_pairs.encode(df.where("false")))).count() == 0


def test_foreign_ids(spark):
    df = spark.createDataFrame([(1, [15496, -1, 99999, 0]), (2, None), (3, [None, 0]), (4, [])], "doc_id long, ids array<int>")
    assert [r.decoded for r in byte_pairs.decode(df).orderBy("doc_id").collect()] == ["Hello!", "", "!", ""]
