"""Corpus operators (SRC-10, SET-01 .. SET-09, AGG-01).

Scale notes: no operator here puts one key's rows into one task.
* Dedup groups by ``sha2(body)`` and keeps ``min(struct(rank, id))``; the
  partial aggregate collapses duplicates map-side, so a body repeated a
  billion times costs one row per map task in the shuffle.
* Per-class ranks (split, sample) are computed inside (label, bucket) cells
  of a hash order, plus a prefix count of the cells before; the window over
  cells has at most ``2 * buckets`` rows.
* Of the per-corpus label totals only those that change labels (at most two)
  are joined back, by broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.session import table
from baitscope.sources.fixtures import PHISH_TAILS, SUBJECTS, _pick

c = F.col

# FIXED VALUES: corpus names in discovery order (dictionary order of the loader).
CORPORA = ["spamassassin", "ceas", "enron", "ling", "nazario", "nigerian", "spaphish"]
ALL_PHISHING = ["nazario", "nigerian"]

def hash_order(key: str, seed: int = 42) -> F.Column:
    """Seeded shuffle: SHA-256 (hex) of the seed and the key as text, for keys
    of any type; ties are broken by the key itself."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(c(key).cast("string"), F.lit(""))), 256)


def corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived labelled corpus rows from ``documents``: the source number
    modulo 6 picks a corpus, labels follow the ``emails`` rule."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    src_no = F.regexp_extract(c("source"), r"(\d+)$", 1).cast("long")
    label = F.when((c("doc_id") % 12).isin(PHISH_TAILS) != ((c("doc_id") % 17) == 0), 1).otherwise(0)
    return d.select(
        c("doc_id").alias("row_id"), _pick(SUBJECTS, c("doc_id")).alias("subject"),
        F.coalesce(c("text"), F.lit("")).alias("body"), label.cast("int").alias("label"),
        _pick(CORPORA[:6], src_no).alias("corpus"))


def union_corpora(parts: list[DataFrame]) -> DataFrame:
    """SET-01: union by name, missing columns as NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def all_phishing_rule(df: DataFrame) -> DataFrame:
    """SRC-10: in the all-phishing corpora, a corpus whose labels sum to 0 is
    relabelled 1.  The corpora to relabel are at most the two named ones and
    are broadcast: rows dealt by corpus would meet in one task per corpus."""
    totals = df.where(c("corpus").isin(ALL_PHISHING)).groupBy("corpus").agg(F.sum("label").alias("_label_sum"))
    j = df.join(F.broadcast(totals.where(c("_label_sum") == 0)), "corpus", "left")
    return j.withColumn("label", F.when(c("_label_sum") == 0, F.lit(1)).otherwise(c("label")).cast("int")).drop("_label_sum")


def corpus_rank(col: str = "corpus") -> F.Column:
    expr = None
    for i, name in enumerate(CORPORA):
        expr = F.when(c(col) == name, i) if expr is None else expr.when(c(col) == name, i)
    return expr.otherwise(len(CORPORA))


def dedup_bodies(df: DataFrame) -> DataFrame:
    """SET-02: keep the first row of each exact body (corpus order, then row id)."""
    keyed = df.withColumn("_h", F.sha2(c("body"), 256)).withColumn("_rank", corpus_rank())
    first = keyed.groupBy("_h").agg(F.min(F.struct("_rank", "row_id")).alias("_k")) \
        .select("_h", c("_k._rank").alias("_rank"), c("_k.row_id").alias("row_id"))
    return keyed.join(first, ["_h", "_rank", "row_id"], "left_semi").drop("_h", "_rank")


def ranked(df: DataFrame, by: str | None = "label", key: str = "row_id", seed: int = 42,
           buckets: int | None = None) -> DataFrame:
    """Exact 1-based rank of each row within ``by`` (or over all rows), in hash
    order, plus the group's row count (``_rank``, ``_n``).

    Rows are cut into (group, bucket) cells by the hash order; a window over
    the small cell-count table gives each cell's offset, and ``row_number``
    runs inside cells only.  The bucket count follows the shuffle width, so
    cells stay small as the data grows."""
    spark = df.sparkSession
    if buckets is None:
        buckets = max(256, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    grp = c(by) if by else F.lit(0)
    x = df.withColumn("_g", grp).withColumn("_o", hash_order(key, seed))
    # Contiguous ranges of the hash, so cells are even whatever the keys are.
    x = x.withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 8), 16, 10).cast("long") * buckets / (1 << 32)).cast("int"))
    cells = x.groupBy("_g", "_b").agg(F.count("*").alias("_cnt"))
    wcum = Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("_g", "_b", F.coalesce(F.sum("_cnt").over(wcum), F.lit(0)).alias("_before"),
                         F.sum("_cnt").over(Window.partitionBy("_g")).alias("_n"))
    w = Window.partitionBy("_g", "_b").orderBy("_o", key)
    out = x.join(cells, ["_g", "_b"]).withColumn("_rank", c("_before") + F.row_number().over(w))
    return out.drop("_g", "_o", "_b", "_before")


def class_ranks(df: DataFrame, key: str = "row_id", seed: int = 42) -> DataFrame:
    return ranked(df, "label", key, seed)


def stratified_split(df: DataFrame, train: float = 0.70, val: float = 0.15, test: float = 0.15,
                     seed: int = 42) -> DataFrame:
    """SET-07: per class, the first n - ceil(n (val+test)) rows of the hash
    order go to train; of the rest (m rows) the last ceil(m test/(val+test))
    go to test.  Adds a ``split`` column."""
    if abs(train + val + test - 1.0) > 0.001:
        raise ValueError(f"train + val + test must sum to 1.0, got {train + val + test:.4f}")
    r = class_ranks(df, seed=seed)
    rest = F.ceil(c("_n") * dbl(val + test))
    n_test = F.ceil(rest * dbl(1.0 - val / (val + test)))
    n_train = c("_n") - rest
    split = F.when(c("_rank") <= n_train, F.lit("train")) \
        .when(c("_rank") <= c("_n") - n_test, F.lit("val")).otherwise(F.lit("test"))
    return r.withColumn("split", split).drop("_rank", "_n")


def balanced_sample(df: DataFrame, max_samples: int, seed: int = 42, top_up: bool = True) -> DataFrame:
    """SET-04/05/06: up to max_samples // 2 rows per class in hash order; with
    ``top_up`` the deficit is filled from the remaining rows in a second hash
    order.  (A single-class input gets the top-up from its own rows.)"""
    r = class_ranks(df, seed=seed)
    single = r.agg(F.count_distinct("label")).scalar() == 1
    if not top_up:
        # A single class fills the whole request.
        return r.filter(c("_rank") <= F.when(single, max_samples).otherwise(max_samples // 2)).drop("_rank", "_n")
    first = r.filter(c("_rank") <= max_samples // 2).drop("_rank", "_n")
    deficit = first.select((F.lit(max_samples) - F.count("*")).alias("d")).scalar()
    rest = ranked(r.filter(c("_rank") > max_samples // 2).drop("_rank", "_n"), None, seed=seed + 1)
    return first.unionByName(rest.filter(c("_rank") <= deficit).drop("_rank", "_n"))


def remainder(all_rows: DataFrame, used: DataFrame, key: str = "row_id") -> DataFrame:
    """SET-08: rows not in the used sample."""
    return all_rows.join(used.select(key), key, "left_anti")


def corpus_breakdown(df: DataFrame) -> DataFrame:
    """AGG-01: per corpus and grand total (NULL corpus): totals, phishing,
    legitimate and phishing share in percent."""
    g = df.rollup("corpus").agg(
        F.count("*").alias("total"), F.sum("label").cast("long").alias("phishing"))
    return g.select("corpus", "total", "phishing", (c("total") - c("phishing")).alias("legit"),
                    F.round(c("phishing") * dbl(100.0) / c("total"), 1).alias("phishing_pct"))


def write_splits(split_df: DataFrame, path: str) -> None:
    """SNK-06: train/val/test files in one write, partitioned by split."""
    split_df.write.mode("overwrite").partitionBy("split").option("header", True).csv(path)
