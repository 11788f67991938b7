"""Label-integrity audit and request-rate checks (STR-02/03/05/07, WIN-02,
JOI-06/07, SNK-03) in batch form; ``baitscope.streaming`` runs the same
rules on streams.

A label of 0 submitted while the pipeline scored the email above 0.70 is
flagged.  The first flagged submission of a body hash is held; later ones
are admitted and confirm the earlier ones.

Skew: one body hash may carry a third of all submissions, so nothing here
windows or joins by the hash alone.  The first flagged row per hash comes
from a ``groupBy`` (map-side partial ``min``), and it is joined back on the
unique (hash, ts, id) key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.session import table

c = F.col
FLAG_CONFIDENCE = 0.70


def client_ip(xff: F.Column, peer: F.Column) -> F.Column:
    """STR-05: first X-Forwarded-For entry, else the peer address."""
    first = F.trim(F.split(xff, ",").getItem(0))
    return F.when(xff.isNotNull() & (xff != ""), first).otherwise(F.coalesce(peer, F.lit("unknown")))


def body_hash(body: F.Column) -> F.Column:
    """STR-07: SHA-256 of the UTF-8 body."""
    return F.sha2(body, 256)


def label_submissions(spark: SparkSession, sf_dir: str, key: str = "user_id % 20") -> DataFrame:
    """Derived submissions from ``events``: hash of ``user_id % 20``, label
    ``event_id % 2``, confidence ``least(value / 50, 1)``."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "value")
    k = (c("user_id") % 20) if key == "user_id % 20" else c("user_id")
    conf = F.least(c("value") / dbl(50.0), dbl(1.0))
    return e.select(
        c("event_id").alias("id"), c("ts").alias("timestamp"),
        F.concat(F.lit("10.0.0."), (c("user_id") % 10).cast("string")).alias("submitter_ip"),
        body_hash(k.cast("string")).alias("body_hash"),
        (c("event_id") % 2).cast("int").alias("submitted_label"),
        F.round(conf, 4).alias("pipeline_confidence"), conf.alias("_conf"))


def audit_labels(subs: DataFrame) -> DataFrame:
    """WIN-02 / JOI-06 / JOI-07: flagged, held, confirmed at insert time and
    confirmed after later resubmissions."""
    s = subs.withColumn("suspicious_flagged",
                        (c("submitted_label") == 0) & (F.coalesce(c("_conf"), c("pipeline_confidence")) > FLAG_CONFIDENCE))
    firsts = s.filter("suspicious_flagged").groupBy("body_hash").agg(
        F.min(F.struct("timestamp", "id")).alias("_first"), F.count("*").alias("_n_flagged"))
    firsts = firsts.select("body_hash", c("_first.timestamp").alias("timestamp"), c("_first.id").alias("id"),
                           "_n_flagged", F.lit(True).alias("_is_first"))
    j = s.join(firsts, ["body_hash", "timestamp", "id"], "left")
    held = c("suspicious_flagged") & F.coalesce(c("_is_first"), F.lit(False))
    return j.select(
        "id", "timestamp", "submitter_ip", "body_hash", "submitted_label", "pipeline_confidence",
        "suspicious_flagged", held.alias("held"),
        (c("suspicious_flagged") & ~held).alias("confirmed_at_insert"),
        (c("suspicious_flagged") & (~held | (c("_n_flagged") >= 2))).alias("confirmed"),
        (~held).alias("admitted_to_training"))


def audit_summary(audited: DataFrame) -> DataFrame:
    return audited.agg(
        F.count("*").alias("n_submissions"), F.count_if("suspicious_flagged").alias("n_flagged"),
        F.count_if("held").alias("n_held"), F.count_if("confirmed_at_insert").alias("n_confirmed_at_insert"),
        F.count_if("confirmed").alias("n_confirmed"), F.count_if("admitted_to_training").alias("n_admitted"))


# Request limits per client and minute.
ANALYSE_LIMIT = 30
TRAIN_LIMIT = 5


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived request log: client ``user_id % 10``; signup events are train
    calls, all others analyse calls."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return e.select("event_id", "ts", (c("user_id") % 10).alias("client"),
                    F.when(c("event_type") == "signup", F.lit("train")).otherwise(F.lit("analyse")).alias("kind"))


def rate_counts(reqs: DataFrame, analyse_limit: int = ANALYSE_LIMIT, train_limit: int = TRAIN_LIMIT) -> DataFrame:
    """STR-03 (batch): requests per client, kind and minute with the limit and
    whether it was exceeded."""
    minute = F.window("ts", "1 minute")
    g = reqs.groupBy("client", "kind", minute.alias("w")).agg(F.count("*").alias("n_requests"))
    limit = F.when(c("kind") == "train", F.lit(train_limit)).otherwise(F.lit(analyse_limit))
    return g.select("client", "kind", c("w.start").alias("minute_start"), "n_requests",
                    limit.alias("limit"), (c("n_requests") > limit).alias("violation"))
