"""Token counts of unigram vocabularies made by hand, against the library."""

from __future__ import annotations

import random

import pytest

from ridgeline.llm import token_counts

pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")


def library(scores):
    import sentencepiece

    model = pb.ModelProto()
    for piece, score, kind in [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), *((f"<0x{b:02X}>", 0.0, 6) for b in range(256)), *((p, s, 1) for p, s in scores.items())]:
        model.pieces.add(piece=piece, score=score, type=kind)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.pad_id = 1, True, -1
    model.normalizer_spec.name, model.normalizer_spec.remove_extra_whitespaces = "identity", False
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def vocabulary(scores):
    return {"pieces": ["<unk>", *scores], "scores": [0.0, *scores.values()], "kinds": ["unknown", *["normal"] * len(scores)]}


@pytest.mark.parametrize("seed", range(4))
def test_counts_of_real_scores_equal_the_library(seed):
    r = random.Random(seed)
    scores = {c: -r.uniform(3, 9) for c in "▁abc"}
    while len(scores) < 120:  # some scores tie, others differ in their last bits
        scores["".join(r.choice("▁abcdé") for _ in range(r.randint(2, 5)))] = -round(r.uniform(4, 14), r.choice([0, 1, 7]))
    counter, other = token_counts.UnigramCounter(vocabulary(scores)), library(scores)
    assert not counter.whole
    texts = ["".join(r.choice("aabbccdé x ") for _ in range(r.randint(0, 90))) for _ in range(800)] + ["", " ", "ab " * 20_000, "中a\n\tb"]
    assert counter.count(texts)[0].tolist() == [len(other.encode(t)) for t in texts]


def test_counts_of_whole_scores_equal_the_library():
    r = random.Random(9)
    scores = {c: -float(r.randint(3, 9)) for c in "▁abc"}
    while len(scores) < 120:
        scores[r.choice(["", "▁"]) + "".join(r.choice("abcdé") for _ in range(r.randint(2, 5)))] = -float(r.randint(4, 14))
    counter, other = token_counts.UnigramCounter(vocabulary(scores)), library(scores)
    assert counter.whole
    texts = ["".join(r.choice("aabbccdé x ") for _ in range(r.randint(0, 90))) for _ in range(800)] + ["", " ", "ab " * 5_000]
    assert counter.count(texts)[0].tolist() == [len(other.encode(t)) for t in texts]


def test_columns_nulls_repeated_rows_and_empty_tables(spark):
    scores = {"▁": -2.5, "a": -1.5, "▁a": -3.0}
    df = spark.createDataFrame([("a a", 1, 2, "x"), ("a a", 1, 2, "x"), (None, 3, 4, None), ("", 5, 6, None)], "text string, n_tokens int, c0 int, __text string")
    found = token_counts.count_tokens(df, vocabulary(scores))
    assert found.columns == ["text", "c0", "__text", "n_tokens", "score"]
    assert sorted((r["c0"], r["n_tokens"], r["score"]) for r in found.collect()) == [(2, 2, -6.0), (2, 2, -6.0), (4, 0, 0.0), (6, 0, 0.0)]
    assert token_counts.count_tokens(df.limit(0), vocabulary(scores)).count() == 0


def test_the_querys_vocabulary_counts_as_the_library_does():
    """A BPE vocabulary as a unigram one: its scores of -1e9, which no best path has, are raised, as the library loses the others' differences beside them."""
    import public_tokenizers
    import sentencepiece

    from ridgeline.llm import sentencepiece_codec

    path = pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")
    model = pb.ModelProto()
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    for piece in model.pieces:
        piece.score = max(piece.score, -40_000.0)
    other = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    r = random.Random(2)
    texts = ["the", "over the", ""] + [" ".join("".join(r.choice(["th", "e", "in", "re", "ou", "n", "s", "ing", "é", "中", "x9"]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 60))) for _ in range(300)]
    expected = [len(other.encode(t)) for t in texts]
    vocabulary = sentencepiece_codec.load_vocabulary(path)
    assert token_counts.UnigramCounter(vocabulary).count(texts)[0].tolist() == expected
    raised = vocabulary | {"scores": [max(s, -40_000.0) for s in vocabulary["scores"]]}
    assert token_counts.UnigramCounter(raised).count(texts)[0].tolist() == expected
