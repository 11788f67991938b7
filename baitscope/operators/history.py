"""Scan history, training samples, KPIs and exports (SNK-01..04, SRC-18,
AGG-02..04, ORD-01..06).

Every read below is a filter, a projection or a one-pass aggregate over the
history; ``history_table`` keeps it as files clustered by id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.functions.core import dbl

c = F.col
INDICATOR_KEYS = ["suspicious_urls", "urgency_language", "header_anomalies", "grammatical_anomalies",
                  "html_suspicious"]


def scan_records(scored: DataFrame, input_type: str = "eml", time_col: str = "received_at") -> DataFrame:
    """SNK-01: history rows from scored emails: whole subject, a 500-character
    preview of the body beside its SHA-256, JSON payloads, and the time of
    ``time_col`` (TIMESTAMP_NTZ in UTC, so it does not depend on the session
    time zone).  ``analysis_time_seconds`` is null until the rows are appended
    to a ``HistoryTable``, which measures it."""
    ts = c(time_col)
    embedded = c("embedding").isNotNull() if "embedding" in scored.columns else F.lit(False)
    raw = F.struct(
        F.struct(c("semantic_score").alias("overall_score"), embedded.alias("has_transformer_embedding"))
        .alias("semantic"),
        F.struct(c("url_count"), c("url_score"), c("header_score"), c("html_score"),
                 c("spf_result").alias("spf"), c("dkim_result").alias("dkim"),
                 c("dmarc_result").alias("dmarc")).alias("structural"),
        F.struct(c("verdict"), c("confidence"), c("method"), c("feature_mode"), c("degraded_mode"))
        .alias("classification"),
    )
    return scored.select(
        c("email_id").alias("id"), ts.alias("timestamp"), F.to_date(ts).alias("scan_date"),
        F.lit(input_type).alias("input_type"),
        F.coalesce(c("subject"), F.lit("")).alias("subject"),
        F.substring(F.coalesce(c("body_text"), F.lit("")), 1, 500).alias("body_preview"),
        F.sha2(F.coalesce(c("body_text"), F.lit("")), 256).alias("body_hash"),
        "verdict", "confidence", "recommended_action", "explanation", "education_note",
        F.to_json(c("threat_indicators")).alias("threat_indicators"),
        F.to_json(raw).alias("raw_features"),
        F.lit(None).cast("double").alias("analysis_time_seconds"),
    )


def indicator_score(json_col: str, key: str) -> F.Column:
    """AGG-03 value: ``{key: {score: x}}`` or ``{key: x}``; bad JSON gives 0."""
    v = F.try_parse_json(c(json_col))
    return F.coalesce(
        F.try_variant_get(v, f"$.{key}.score", "double"),
        F.try_variant_get(v, f"$.{key}", "double"),
        dbl(0.0))


def mean4(col: F.Column) -> F.Column:
    """Mean of 4-decimal scores rounded half-up to 4 decimals, computed on
    exact integers (sum of score x 10^4), so it does not depend on the order
    in which partial sums are added."""
    s = F.sum(F.round(col * 10000).cast("long"))
    n = F.count("*")
    return F.when(n > 0, F.floor((2 * s + n) / (2 * n)) / dbl(10000.0))


def scan_kpi(history: DataFrame) -> DataFrame:
    """AGG-02/03: totals per verdict, phishing rate, mean confidence and the
    mean of each indicator score, in one aggregate (zeros when empty)."""
    n = F.count("*")
    aggs = [
        n.alias("total_analyzed"),
        F.count_if(c("verdict") == "phishing").alias("phishing_count"),
        F.count_if(c("verdict") == "suspicious").alias("suspicious_count"),
        F.count_if(c("verdict") == "legitimate").alias("legitimate_count"),
        F.coalesce(F.round(F.count_if(c("verdict") == "phishing") / n * 100, 1), dbl(0.0)).alias("phishing_rate"),
        F.coalesce(mean4(c("confidence")), dbl(0.0)).alias("avg_confidence"),
    ]
    aggs += [F.coalesce(mean4(indicator_score("threat_indicators", k)), dbl(0.0)).alias(f"{k}_mean")
             for k in INDICATOR_KEYS]
    return history.agg(*aggs)


def history_page(history: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    """ORD-01/04: newest first, LIMIT/OFFSET (a top-k, planned as TakeOrdered)."""
    return history.orderBy(c("id").desc()).offset(offset).limit(limit)


def scan_by_id(history: DataFrame, scan_id: int) -> DataFrame:
    """ORD-02."""
    return history.filter(c("id") == scan_id)


def delete_scan(history: DataFrame, scan_id: int) -> DataFrame:
    """ORD-03 as a filter: the rows without one id (``HistoryTable.delete`` rewrites the file that holds it)."""
    return history.filter(c("id") != scan_id)


def export_history(history: DataFrame, cap: int | None = None) -> DataFrame:
    """SNK-04: 13 export columns, scores x100 rounded to 2, missing -> 0;
    ``sender`` is always empty (the history has no such column).  All rows are
    exported by a partitioned write; ``cap`` asks for the newest rows only."""
    def pct(k):
        return F.round(indicator_score("threat_indicators", k) * 100, 2).alias(f"{k}_score")
    top = history if cap is None else history_page(history, cap, 0)
    return top.select(
        "id", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "input_type", "subject",
        F.lit("").alias("sender"), "verdict", F.round(F.coalesce(c("confidence"), dbl(0.0)) * 100, 2).alias("confidence"),
        "recommended_action", *[pct(k) for k in INDICATOR_KEYS])


def write_export(export: DataFrame, path: str) -> None:
    export.write.mode("overwrite").option("header", True).csv(path)


def training_samples(scored: DataFrame, time_col: str = "received_at") -> DataFrame:
    """SNK-02: training rows: id, timestamp, subject, body preview and hash,
    label and the 70-d feature vector (rule + structural)."""
    return scored.select(
        c("email_id").alias("id"), c(time_col).alias("timestamp"),
        F.coalesce(c("subject"), F.lit("")).alias("subject"),
        F.substring(F.coalesce(c("body_text"), F.lit("")), 1, 500).alias("body_preview"),
        F.sha2(F.coalesce(c("body_text"), F.lit("")), 256).alias("body_hash"),
        c("label"), F.to_json(F.concat("rule_vector", "structural_vector")).alias("features"))


def load_training_samples(samples: DataFrame) -> DataFrame:
    """SRC-18: samples in id order with features parsed back to an array."""
    return samples.select("id", "label", F.from_json(c("features"), "array<double>").alias("features")) \
        .orderBy("id")


def training_counts(samples: DataFrame) -> DataFrame:
    """AGG-04: counts by label."""
    return samples.agg(F.count("*").alias("total_samples"),
                       F.count_if(c("label") == 1).alias("phishing_samples"),
                       F.count_if(c("label") == 0).alias("legitimate_samples"))


def public_view(scans: DataFrame, expose_raw: bool = False) -> DataFrame:
    """PRJ-13: the raw-features record stays in the table for audit but is
    dropped from what callers see unless explicitly exposed."""
    return scans if expose_raw else scans.drop("raw_features")


def write_metrics(metrics: DataFrame, path: str) -> None:
    """SNK-05: metrics as JSON (one file per metrics table)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_predictions(preds: DataFrame, path: str, max_body: int | None = None) -> None:
    """SNK-05: per-sample CSV; ``max_body`` cuts the body."""
    cols = [F.substring(c(x), 1, max_body).alias(x) if x == "body_text" and max_body else c(x) for x in preds.columns]
    preds.select(*cols).write.mode("overwrite").option("header", True).csv(path)
