"""What stages leave in an executor's Python workers, which the stages after them have to live with."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import functions as F

from ridgeline.llm import language_id, queries, sentencepiece_codec

COLUMNS = "doc_id long, text string, lang string"


def test_learning_makes_no_rows_from_python(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"the dog {i}" if i % 2 else f"der hund {i}", "en" if i % 2 else "de") for i in range(40)], COLUMNS)

    def refuse(*_, **__):
        raise AssertionError("rows made from a Python list start further Python workers in every executor")

    monkeypatch.setattr(type(spark), "createDataFrame", refuse)
    assert [m.langs for m in language_id.learn(df)] == [["de", "en"]]


def test_the_sample_ends_with_the_bytes_of_a_language(spark):
    rows = [(i, f"text {i} " * (1 + i % 7), "aa") for i in range(60)] + [(100 + i, f"long {i} " * 200, "aa" if i % 2 else "bb") for i in range(6)]
    df = spark.createDataFrame(rows, COLUMNS)
    got = language_id.sample(df, F.col("lang"), F.lit(True), "doc_id", "text", docs_per_lang=30, bytes_per_lang=700, max_doc_bytes=500)
    ranked = df.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))).withColumn("long", F.octet_length("text") > 500).orderBy("lang", "long", "h", "doc_id").collect()
    plain, first, size, count = defaultdict(list), {}, defaultdict(int), defaultdict(int)
    for r in ranked:
        count[r["lang"]] += 1
        if count[r["lang"]] <= 30 and first.setdefault(r["lang"], r["long"]) == r["long"] and size[r["lang"]] < 700:
            size[r["lang"]] += min(700, len(r["text"]))
            plain[r["lang"]].append(r["text"].encode()[:700])
    assert len(plain["aa"]) > 5 and len(plain["bb"]) == 1
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in plain.items()}


def test_a_tokenizer_worker_remembers_few_segments():
    codec = sentencepiece_codec.BpeCodec(sentencepiece_codec.load_vocabulary(queries.tokenizer_path()))
    first = codec.encode(["n0 n1 n2"])[0].tolist()
    for i in range(0, 300_000, 10_000):
        codec.encode([" ".join(f"n{j}" for j in range(i, i + 10_000))])
    assert len(codec._row) <= 150_000
    assert codec.encode(["n0 n1 n2"])[0].tolist() == first
