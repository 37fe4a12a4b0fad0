"""Every stage on nulls, empty and very long texts, ties, repeated rows, empty tables and columns with clashing names."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ridgeline.llm import language_id, ngram_jaccard

corpus_pipeline = pytest.importorskip("corpus_pipeline")
EXTRA = ("score", "lang_pred", "node", "n", "id", "c", "stays", "component_id", "n_removed", "kept_text", "item_id", "ids", "decoded", "__node")


def unlike(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


@pytest.fixture(scope="module")
def documents(spark):
    rows = [(i, f"der hund und die katze {unlike(f'wort{i}x', 45)}", "de", "s", 1) for i in range(12)] + [(20 + i, f"the dog and the cat {unlike(f'word{i}y', 45)}", "en", "s", 1) for i in range(12)]
    rows += [(3, rows[3][1], "de", "s", 1), (40, None, "de", "s", 1), (None, None, None, None, None), (41, "", "en", "s", 1), (42, "12 !", "en", None, 1), (None, f"the dog {unlike('nameless', 50)}", None, None, None), (None, f"the dog {unlike('nameless', 50)}", None, None, None), (43, f"the long {unlike('far', 60_000)}", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(f"own {c}") for c in EXTRA})


@pytest.fixture(scope="module")
def folder(spark, documents, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    documents.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(0, unlike("word1y", 20)), (1, None), (None, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def test_each_stage_keeps_columns_and_clean_documents(spark, documents, folder):
    docs, counts = documents, []
    for name, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, folder)
        assert docs.columns == documents.columns, name
        rows = docs.collect()
        assert all(r[c] == f"own {c}" for r in rows for c in EXTRA), name
        counts.append(sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows))
        docs = spark.createDataFrame(rows, documents.schema)
    clean = [(False, i) for i in [*range(12), *range(20, 32), 43]] + [(True, 0)]
    assert counts[0] == sorted([*clean, (False, 3), (True, 0)])
    assert counts[1] == counts[2] == sorted(clean)
    assert counts[3] == sorted(set(clean) - {(False, 21)})
    encoded = corpus_pipeline.encode(spark, docs, folder)
    assert encoded.count() == len(counts[3]) and encoded.where("n_tokens > 60000").count() == 1


def test_the_whole_pipeline_and_empty_tables(spark, documents, folder, tmp_path):
    assert corpus_pipeline.run(spark, folder).count() == 25
    documents.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_long_lists_are_paired_to_the_end(spark, monkeypatch):
    """Many documents that share most words but link only in chains."""
    monkeypatch.setattr(ngram_jaccard, "SHORT", 2)
    monkeypatch.setattr(ngram_jaccard, "LEADS", 1)
    words = [f"w{i}" for i in range(100)]
    texts = [" ".join(f"c{j}" if j < i else w for j, w in enumerate(words)) for i in range(0, 48, 4)]  # each near its neighbours only
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in ngram_jaccard.join_components(df, bits=4, hot_count=1).collect()}
    assert got == dict.fromkeys(range(len(texts)), 0)
    apart = spark.createDataFrame([(i, t + " " + unlike(f"own{i}", 60)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.join_components(apart, bits=4).collect()} == {i: i for i in range(len(texts))}


def test_rows_with_one_id_are_one_node(spark):
    df = spark.createDataFrame([(5, unlike("a", 30)), (5, unlike("b", 30)), (2, unlike("a", 30)), (3, unlike("b", 30)), (9, unlike("c", 30))], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in ngram_jaccard.join_components(df).collect()} == {5: 2, 2: 2, 3: 2, 9: 9}


def test_learning_from_nothing(spark, documents):
    assert language_id.learn(documents.withColumn("lang", F.lit(None).cast("string"))) == []
