"""OCR word tables (SRC-16/17).  OCR itself is an external tool; its word
output (image_id, line_no, word_no, text, conf) is the input table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.functions.core import dbl, py_strip
from baitscope.session import table

c = F.col

#: Parts that the words of one part of the scan (up to 128 MB, compressed) are dealt to.
PARTS = 16


def ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived OCR words from ``documents``: every word of every line,
    conf = (word position in the document % 101) - 1.

    Whole texts are dealt by image before they are cut, so that what groups
    words by image or line later moves no words.  There are several parts for
    each part of the scan: the words of one must be sorted in a task's memory."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), PARTS * d.rdd.getNumPartitions())
    d = d.repartition(parts, "doc_id")
    lines = d.select(c("doc_id").alias("image_id"), F.posexplode(F.split(c("text"), "\n")).alias("line_no", "line"))
    words = lines.select("image_id", "line_no", F.posexplode(F.split(c("line"), " ")).alias("word_no", "word"))
    w = Window.partitionBy("image_id").orderBy("line_no", "word_no")
    return words.select("image_id", "line_no", "word_no", c("word").alias("text"),
                        ((F.row_number().over(w) - 1) % 101 - 1).alias("conf"))


def ocr_confidence(words: DataFrame) -> DataFrame:
    """SRC-16: mean confidence of words with conf > 0, divided by 100."""
    return words.groupBy("image_id").agg(
        F.round(F.avg(F.when(c("conf") > 0, c("conf"))) / dbl(100.0), 6).alias("ocr_confidence"))


def ocr_lines(words: DataFrame) -> DataFrame:
    """Line text rebuilt from its words (space-joined in word order)."""
    return words.groupBy("image_id", "line_no").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
        .alias("line"))


def ocr_subject(lines: DataFrame) -> DataFrame:
    """SRC-17: among the first five non-empty (stripped) lines, the first that
    starts with ``subject:`` (text after 8 characters, stripped) or ``re:`` /
    ``fw:``; else the first line cut to 100 characters."""
    s = lines.select("image_id", "line_no", py_strip(c("line")).alias("line")).filter(c("line") != "")
    w = Window.partitionBy("image_id").orderBy("line_no")
    s = s.withColumn("rn", F.row_number().over(w)).filter(c("rn") <= 5)
    low = F.lower(c("line"))
    is_subj = low.startswith("subject:")
    hit = is_subj | low.startswith("re:") | low.startswith("fw:")
    cand = F.when(hit, F.struct(c("rn"), F.when(is_subj, py_strip(F.substring(c("line"), 9, 1 << 30)))
                                .otherwise(c("line")).alias("v")))
    g = s.groupBy("image_id").agg(F.min(cand).alias("hit"),
                                  F.min_by(F.substring(c("line"), 1, 100), c("rn")).alias("first"))
    return g.select("image_id", F.coalesce(c("hit.v"), c("first")).alias("subject"))
