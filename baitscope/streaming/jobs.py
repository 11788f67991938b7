"""Structured Streaming jobs (STR-01 .. STR-06).

Inputs are file streams (parquet directories); ``trigger(availableNow=True)``
drains what is there, which is how the tests drive them.  State lives in
Spark's checkpoint directory (a shared folder on a cluster), so a restarted
query or a lost executor resumes from the last committed batch.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from baitscope.operators import audit as A
from baitscope.operators import history as H
from baitscope.operators.scoring import score_emails
from baitscope.session import ensure_checkpoint_dir

c = F.col
#: Tasks over which the submissions of one body hash are dealt.
SALTS = 16


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(ensure_checkpoint_dir(spark), "streams", name)


def scoring_stream(spark: SparkSession, emails_dir: str, schema, out_dir: str, name: str = "scoring"):
    """STR-01: arriving emails -> score -> append to the scan history
    (partitioned by scan date).  Stateless, so it scales with the input."""
    src = spark.readStream.schema(schema).parquet(emails_dir)
    records = H.scan_records(score_emails(src))
    return (records.writeStream.format("parquet").option("path", out_dir)
            .option("checkpointLocation", _ckpt(spark, name)).partitionBy("scan_date")
            .outputMode("append").trigger(availableNow=True).start())


def audit_batch(batch: DataFrame, seen: DataFrame | None) -> DataFrame:
    """One micro-batch of the label audit: a flagged row is held when it is
    the first flagged row of its hash in this batch and the hash was never
    flagged before (``seen`` holds the hashes flagged so far)."""
    firsts = batch.filter("suspicious_flagged").groupBy("body_hash").agg(
        F.min(F.struct("timestamp", "id")).alias("_f"))
    if seen is not None:
        firsts = firsts.join(seen, "body_hash", "left_anti")
    firsts = firsts.select("body_hash", c("_f.timestamp").alias("timestamp"), c("_f.id").alias("id"),
                           F.lit(True).alias("_first"))
    j = batch.join(firsts, ["body_hash", "timestamp", "id"], "left")
    held = c("suspicious_flagged") & F.coalesce(c("_first"), F.lit(False))
    return j.select("id", "timestamp", "body_hash", "submitted_label", "pipeline_confidence",
                    "suspicious_flagged", held.alias("held"),
                    (c("suspicious_flagged") & ~held).alias("confirmed_at_insert"))


def _by_batch(df: DataFrame, path: str) -> None:
    """Write one batch of a table; a replay overwrites its own partition."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)


def quarantine_stream(spark: SparkSession, subs_dir: str, schema, out_dir: str, state_dir: str,
                      name: str = "quarantine", max_files: int | None = None):
    """STR-02: label quarantine over a submission stream.

    Each micro-batch is audited with ``audit_batch`` against the hashes that
    earlier batches flagged.  Output and state are tables partitioned by batch id;
    a batch reads only the state of the batches before it and overwrites its own
    partitions, so a replay gives the same rows.  State is read through Spark, on
    whatever file system it lies, and holds each hash once for the batch that
    flagged it first."""
    state = "body_hash string, batch_id long"
    spark.createDataFrame([], state).write.mode("append").partitionBy("batch_id").parquet(state_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        seen = batch.sparkSession.read.schema(state).parquet(state_dir).where(c("batch_id") < batch_id).select("body_hash")
        flagged = batch.withColumn("suspicious_flagged",
                                   (c("submitted_label") == 0) & (c("confidence_raw") > A.FLAG_CONFIDENCE))
        _by_batch(audit_batch(flagged, seen).withColumn("batch_id", F.lit(batch_id).cast("long")), out_dir)
        new = flagged.filter("suspicious_flagged").select("body_hash").distinct().join(seen, "body_hash", "left_anti")
        _by_batch(new.withColumn("batch_id", F.lit(batch_id).cast("long")), state_dir)

    src = spark.readStream.schema(schema)
    src = src if max_files is None else src.option("maxFilesPerTrigger", max_files)
    return (src.parquet(subs_dir).writeStream.foreachBatch(run).option("checkpointLocation", _ckpt(spark, name))
            .trigger(availableNow=True).start())


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first (timestamp, id) of each body hash of a task's rows, so that a hash is shuffled once a task."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if kept is None else pa.concat_tables([kept, rows])
        rows = rows.sort_by([("timestamp", "ascending"), ("id", "ascending")])
        kept = rows.group_by("body_hash", use_threads=False).aggregate([("timestamp", "first"), ("id", "first")])
        kept = kept.rename_columns([x.removesuffix("_first") for x in kept.column_names]).select(batch.schema.names)
    if kept is not None:
        yield from kept.to_batches()


def _hold_first(expiry_ms: int | None):
    """Keyed state of a body hash: the submission that is held for it."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = min((t, i) for f in frames for t, i in zip(f["timestamp"], f["id"], strict=True))
        if not state.exists:
            state.update((int(first[1]),))
            yield pd.DataFrame({"body_hash": [key[0]], "timestamp": [first[0]], "id": [first[1]]})
        if expiry_ms is not None:
            state.setTimeoutDuration(expiry_ms)

    return step


def held_stream(spark: SparkSession, subs_dir: str, schema, out_dir: str, name: str = "held",
                max_files: int | None = None, expiry_ms: int | None = None):
    """STR-02 on keyed state: appends (body_hash, timestamp, id) of each submission that is held, the first flagged
    one of its hash.

    A batch looks up the hashes that are in it and no others, in Spark's state store.  Flagged rows are cut to the
    first of each hash within a task before they are shuffled, so a hash with a third of all rows sends one row a
    task.  With ``expiry_ms`` a hash is forgotten when it was not flagged for so long (processing time); its next
    flagged submission is held again.  A replayed batch starts from the state before it."""
    src = spark.readStream.schema(schema)
    src = (src if max_files is None else src.option("maxFilesPerTrigger", max_files)).parquet(subs_dir)
    keys = "body_hash string, timestamp timestamp, id long"
    flagged = (src.where((c("submitted_label") == 0) & (c("confidence_raw") > A.FLAG_CONFIDENCE))
               .select("body_hash", c("timestamp").cast("timestamp").alias("timestamp"), c("id").cast("long").alias("id")))
    timeout = GroupStateTimeout.NoTimeout if expiry_ms is None else GroupStateTimeout.ProcessingTimeTimeout
    held = flagged.mapInArrow(_firsts, keys).groupBy("body_hash").applyInPandasWithState(
        _hold_first(expiry_ms), keys, "held long", "append", timeout)
    writer = (held.writeStream.format("parquet").option("path", out_dir).outputMode("append")
              .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True))
    # With a timeout Spark would run batches without rows for ever; a stream keeps the setting that it starts with.
    setting = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        return writer.start()
    finally:
        spark.conf.set(setting, before)


def audited_labels(subs: DataFrame, held: DataFrame) -> DataFrame:
    """Submissions against the rows of ``held_stream``: flagged, held, confirmed at insert (flagged, and another one of
    its hash is held), pending (flagged, and the stream has not come to its hash).

    With expiry a hash may have several held rows; ``held`` is one row for each hash, or for each time it was held."""
    first = held.groupBy("body_hash").agg(F.collect_set(F.struct(c("timestamp"), c("id"))).alias("_held"))
    # A hash may have a third of the submissions: it is dealt over SALTS tasks, its one row copied to each.
    salted = first.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = subs.withColumns({
        "suspicious_flagged": F.coalesce((c("submitted_label") == 0) & (c("confidence_raw") > A.FLAG_CONFIDENCE), F.lit(False)),
        "_salt": F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")})
    own = F.struct(c("timestamp").cast("timestamp").alias("timestamp"), c("id").cast("long").alias("id"))
    joined = rows.join(salted, ["body_hash", "_salt"], "left")
    is_held = c("suspicious_flagged") & F.coalesce(F.array_contains("_held", own), F.lit(False))
    return joined.withColumns({"held": is_held, "pending": c("suspicious_flagged") & c("_held").isNull()}).withColumn(
        "confirmed_at_insert", c("suspicious_flagged") & ~c("held") & ~c("pending")).drop("_salt", "_held")


def confirmed_labels(audited: DataFrame) -> DataFrame:
    """JOI-07: a flagged row is confirmed once its hash was flagged again, at its insert or later."""
    often = audited.filter("suspicious_flagged").groupBy("body_hash").agg(F.count("*").alias("_n")).where("_n >= 2")
    j = audited.join(often, "body_hash", "left")
    return j.withColumn("confirmed", c("suspicious_flagged") & c("_n").isNotNull()).drop("_n")


def rate_limit_stream(spark: SparkSession, req_dir: str, schema, out_dir: str, name: str = "rate_violations",
                      analyse_limit: int = A.ANALYSE_LIMIT, train_limit: int = A.TRAIN_LIMIT,
                      watermark: str = "10 minutes"):
    """STR-03: per client, kind and minute counts over a 10-minute watermark;
    rows over the limit are appended to a table once their window closes."""
    src = spark.readStream.schema(schema).parquet(req_dir).withColumn("ts", c("ts").cast("timestamp"))
    g = (src.withWatermark("ts", watermark)
         .groupBy(F.window("ts", "1 minute").alias("w"), "client", "kind").agg(F.count("*").alias("n_requests")))
    limit = F.when(c("kind") == "train", F.lit(train_limit)).otherwise(F.lit(analyse_limit))
    out = g.select("client", "kind", c("w.start").alias("minute_start"), "n_requests", limit.alias("max_per_minute")) \
        .filter(c("n_requests") > c("max_per_minute"))
    return (out.writeStream.format("parquet").option("path", out_dir).outputMode("append")
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def kpi_stream(spark: SparkSession, history_dir: str, schema, out_dir: str, name: str = "running_kpi"):
    """STR-04: running KPIs over the history stream.  The aggregate state is one
    row of exact sums; each batch publishes its one row under its own batch id,
    which a replay overwrites, so readers (``latest_kpi``) never meet a table
    that is being written."""
    src = spark.readStream.schema(schema).parquet(history_dir)
    n = F.count("*")
    agg = src.agg(n.alias("total_analyzed"),
                  F.count_if(c("verdict") == "phishing").alias("phishing_count"),
                  F.count_if(c("verdict") == "suspicious").alias("suspicious_count"),
                  F.count_if(c("verdict") == "legitimate").alias("legitimate_count"),
                  F.sum(F.round(c("confidence") * 10000).cast("long")).alias("confidence_sum"),
                  *[F.sum(F.round(H.indicator_score("threat_indicators", k) * 10000).cast("long"))
                    .alias(f"{k}_sum") for k in H.INDICATOR_KEYS])

    def mean(name: str) -> F.Column:
        return F.floor((2 * c(name) + c("total_analyzed")) / (2 * c("total_analyzed"))) / F.lit(10000.0)

    def run(batch: DataFrame, batch_id: int) -> None:
        rate = F.round(c("phishing_count") / c("total_analyzed") * 100, 1)
        row = batch.select("total_analyzed", "phishing_count", "suspicious_count", "legitimate_count", rate.alias("phishing_rate"),
                     mean("confidence_sum").alias("avg_confidence"), *[mean(f"{k}_sum").alias(f"{k}_mean") for k in H.INDICATOR_KEYS])
        _by_batch(row.withColumn("batch_id", F.lit(batch_id).cast("long")).coalesce(1), out_dir)

    return (agg.writeStream.foreachBatch(run).outputMode("complete")
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


def latest_kpi(spark: SparkSession, out_dir: str) -> DataFrame:
    """STR-04: the KPI row of the newest batch that was published whole."""
    rows = spark.read.parquet(out_dir)
    newest = rows.agg(F.max("batch_id").alias("_newest"))
    return rows.join(newest, c("batch_id") == c("_newest")).drop("batch_id", "_newest")


def retrain_trigger_stream(spark: SparkSession, samples_dir: str, schema, on_ready, min_samples: int = 6,
                           name: str = "retrain", max_files: int | None = None):
    """STR-06: call ``on_ready(samples)`` after each batch once there are at
    least ``min_samples`` samples and both classes.

    The stream's state is one count for each label; the check reads those counts
    and never the samples, which ``on_ready`` gets as a plan over the folder.  A
    replayed batch calls it again."""
    src = spark.readStream.schema(schema)
    src = (src if max_files is None else src.option("maxFilesPerTrigger", max_files)).parquet(samples_dir)

    def run(batch: DataFrame, batch_id: int) -> None:
        n = {r["label"]: r["n"] for r in batch.collect()}  # one row a label
        if sum(n.values()) >= min_samples and n.get(0) and n.get(1):
            on_ready(batch.sparkSession.read.schema(schema).parquet(samples_dir))

    # Labels other than 0 and 1 count as samples of one further kind, so the state is three rows at most.
    counts = src.groupBy(F.when(c("label").isin(0, 1), c("label")).alias("label")).agg(F.count("*").alias("n"))
    return (counts.writeStream.foreachBatch(run).outputMode("complete").option("checkpointLocation", _ckpt(spark, name))
            .trigger(availableNow=True).start())
