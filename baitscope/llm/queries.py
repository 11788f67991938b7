"""Registered queries of the training-data operators: thin digests over their outputs."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from baitscope.llm import (
    bpe,
    centroids,
    chat,
    decontam,
    langid,
    probminhash,
    quality,
    repair,
    runindex,
    tokenstore,
    urlfilter,
    vecdup,
    warc,
)
from baitscope.session import table


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids written to token-id files and read back, as digests."""
    docs = table(spark, sf_dir, "documents")
    path = tokenstore.tokenize_to_store(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return tokenstore.read_store(spark, path)


def op2_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without its repeated 400-byte strings, as digests."""
    return runindex.repeat_digests(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back, as digests."""
    return warc.archive_digests(table(spark, sf_dir, "pages"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items that contaminate each document."""
    return decontam.flag(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by rules, else by the language-model ratio."""
    return urlfilter.judge(table(spark, sf_dir, "pages")).drop("ratio")


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class of every document."""
    return probminhash.near_classes(table(spark, sf_dir, "documents"))


def op8_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return vecdup.near_vectors(table(spark, sf_dir, "embeddings"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, with a calibrated score."""
    return langid.identify(table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and their decoding, as digests."""
    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("decoded")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one full of control strings, formatted, stored and read back, as digests."""
    said = r"\### Assistant: </turn> ok"
    odd = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(table(spark, sf_dir, "conversations").select(odd.columns).unionByName(odd))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest of 16 centroids of every embedding after three rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and repaired digest of every damaged conversation."""
    return repair.repair_digests(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_token_store": op1_token_store,
    "op2_repeats": op2_repeats,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_vector_links": op8_vector_links,
    "op9_langid": op9_langid,
    "op10_bpe": op10_bpe,
    "op11_chat_format": op11_chat_format,
    "op12_centroids": op12_centroids,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE: dict[str, str] = {"op4_warc": warc.ORACLE_SQL, "op8_vector_links": vecdup.ORACLE_SQL, "op11_chat_format": chat.ORACLE_SQL,
                          "op12_centroids": centroids.ORACLE_SQL}
