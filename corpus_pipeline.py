"""From raw documents to clean, tokenised ones, in five stages.

Each stage takes (spark, docs, sf_dir), works on every document that its
predecessor kept, and returns the documents that it keeps (with their new texts);
the last one returns ids and digests. Between two stages the documents are written
as Parquet and read again, in the folder that all executors share; a stage's table is
deleted when the next one is written, the last one with the session.

Defined results: documents without a letter, null and empty texts among them, go in the first
stage; where no document has a language they stay, and the last word goes with the third stage, which
drops what has no text left. Of repeated rows and copies one stays, also where ids repeat or are
null. Very long texts are used whole. Columns besides doc_id, text, lang, source and n_chars are kept up to
the last stage. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.llm import decontamination, language_id, ngram_jaccard, queries, sentencepiece_codec, substring_dedup
from ridgeline.llm.lineage import drop, shared_folder, written

#: Near duplicates share at least so many percent of their sequences of so many words (op6 has its own values).
NEAR_WORDS, NEAR_PERCENT = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a recognised language, however close the second best; lang becomes the prediction where it was null.

    Where no language can be learned, because no document has one, all documents stay as they are.
    """
    models = language_id.learn(docs)
    if not models:
        return docs
    kept = language_id.predict(docs, models, lang_col="__lang_pred", score_col="__lang_score").where(F.col("__lang_pred") != language_id.UNDETERMINED)
    return kept.withColumn("lang", F.coalesce("lang", "__lang_pred")).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates: the one with the smallest id."""
    return ngram_jaccard.keep_one(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages that stand elsewhere too; a document of which nothing is left goes."""
    cut = substring_dedup.remove_duplicates(docs)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).where(F.length("text") > 0).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold passages of the benchmark."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text, decode it again; returns ids' and texts' digests."""
    found = sentencepiece_codec.encode_decode(docs, sentencepiece_codec.load_vocabulary(queries.tokenizer_path()), keep=["doc_id", "lang", "source"])
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return found.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", remove_repeated_passages),
    ("decontamination", decontaminate),
    ("sentencepiece", encode),
]

#: The learned stage and the tokenizer can't be expressed in SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
        if before is not None:
            drop(before)
        before = docs
    return docs
