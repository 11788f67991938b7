"""Brand dictionary as tables (SRC-15)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.resources.brands import BRANDS


def brand_table(spark: SparkSession) -> DataFrame:
    """(ordinal, name, domains) in dictionary order."""
    return spark.createDataFrame([(i, n, d) for i, (n, d) in enumerate(BRANDS)],
                                 "ordinal int, name string, domains array<string>")


def read_brand_json(spark: SparkSession, path: str) -> DataFrame:
    """The same table from a ``{"brands": [{name, domains}]}`` JSON file."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.posexplode("brands").alias("ordinal", "b")) \
        .select("ordinal", F.col("b.name").alias("name"), F.col("b.domains").alias("domains"))


def keyword_table(brands: DataFrame) -> DataFrame:
    """Keyword -> domains: each brand's lower-case name and its words of at
    least three characters.  A repeated keyword keeps its first position and
    takes the last brand's domains.  Broadcast-sized (one row per keyword)."""
    lname = F.lower("name")
    words = F.filter(F.split(lname, " "), lambda w: F.length(w) >= 3)
    kws = F.concat(F.array(lname), words)
    exploded = brands.select("ordinal", F.posexplode(kws).alias("pos", "keyword"),
                             F.transform("domains", lambda d: F.lower(d)).alias("domains"))
    ranked = exploded.withColumn("order_key", F.struct("ordinal", "pos"))
    g = ranked.groupBy("keyword").agg(F.min("order_key").alias("first"), F.max_by("domains", "order_key").alias("domains"))
    return g.select("keyword", "domains", F.col("first.ordinal").alias("brand_ordinal"), F.col("first.pos").alias("pos"))
