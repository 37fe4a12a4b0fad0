"""Encoding of unbroken strings and the edge cases of the codec."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest

from ridgeline.llm import sentencepiece_codec


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(model):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


def strings():
    r = random.Random(3)
    letters = "etaoinshrdlucmfwypvbgkjqxzETAOINS0123456789+/=éß中"
    return ["".join(r.choice(letters) for _ in range(n)) for n in (255, 256, 257, 300, 2_000, 9_000)] + ["a" * 1_000, "ab" * 700, "the" * 500, "=" * 3_000, "aaab" * 400]


def test_long_unbroken_strings_equal_the_library(model, library):
    codec = sentencepiece_codec.BpeCodec(sentencepiece_codec.load_vocabulary(model))
    texts = strings() + ["x " + t + " y" for t in strings()[:5]]
    ids, counts = codec.encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == library.encode(text), text[:40]


def test_rounds_and_heap_agree(model, monkeypatch):
    vocabulary = sentencepiece_codec.load_vocabulary(model)
    whole = sentencepiece_codec.BpeCodec(vocabulary).encode(strings()[:5])
    for most in (1, 10**9):
        monkeypatch.setattr(sentencepiece_codec, "LONG_SEGMENT", most)
        again = sentencepiece_codec.BpeCodec(vocabulary).encode(strings()[:5])
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))


def test_a_megabyte_without_a_space(model, library):
    r = random.Random(4)
    text = "".join(r.choice("ABCDEFGHabcdefgh0123456789+/") for _ in range(1_000_000))
    codec = sentencepiece_codec.BpeCodec(sentencepiece_codec.load_vocabulary(model))
    began = time.time()
    ids, _ = codec.encode([text])
    assert time.time() - began < 60
    assert ids.tolist() == library.encode(text)


def test_columns_repeated_rows_and_empty_tables(spark, model):
    vocabulary = sentencepiece_codec.load_vocabulary(model)
    df = spark.createDataFrame([(1, "one two", 5, "old"), (1, "one two", 5, "old"), (2, None, 6, None), (3, "", None, None)], "ids int, text string, __text int, decoded string")
    found = sentencepiece_codec.encode_decode(df, vocabulary)
    assert found.columns == ["text", "__text", "ids", "decoded"]
    assert sorted((r["text"] or "", r["__text"] or 0, r["decoded"]) for r in found.collect()) == [("", 0, ""), ("", 6, ""), ("one two", 5, "one two"), ("one two", 5, "one two")]
    assert sentencepiece_codec.encode_decode(df.limit(0), vocabulary).count() == 0
