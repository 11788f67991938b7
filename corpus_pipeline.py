"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read again as the next one's input.

Every stage but the last returns the columns of ``documents``; other columns are left out.

1. Language ID: texts without a letter, and those whose calibrated score is under ``LEAST_SCORE``, go.
2. MinHash near-dedup: one document of each class of near duplicates stays (the smallest doc_id).
3. Suffix-array dedup: byte strings of ``REPEAT_BYTES`` that occur more than once are cut out of the texts; a document
   stays even if nothing is left of it, and ``n_chars`` follows its text.
4. Benchmark decontamination: documents that hold a benchmark item go.
5. BPE encoding and decoding: ids (packed little-endian 32-bit integers) and digests of each document.

Null texts are rejected by the first stage; empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.llm import bpe, decontam, langid, probminhash, runindex
from baitscope.llm.common import crc_mod, scratch
from baitscope.session import table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
LEAST_SCORE = 0.5
#: Most passages of over fifty words have more bytes than this, but not all (51 one-letter words have 101): of the 1.1 million
REPEAT_BYTES = 200


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = docs.select(COLUMNS)
    model = langid.fit(docs, crc_mod("doc_id", 4) != 2)
    return langid.predict(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return probminhash.keep_one(docs.select(COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = runindex.remove_repeats(docs.select(COLUMNS), REPEAT_BYTES)
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.clean(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.round_trip(docs.select(COLUMNS), public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).drop("decoded")


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("token_ids", token_ids),
]

#: SQL expresses neither the classifier nor the tokenizer; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``."""
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, rows, sf_dir).write.parquet(path)
        rows = spark.read.parquet(path)
    return rows
