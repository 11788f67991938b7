"""URL tables: exploded per-URL rows, model-score blend, training pairs and
character tokens (URL-03b, URL-20 .. URL-22, JOI-05)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.functions.urls import analyze_urls, extract_urls_model, text_urls, tokenize_url

c = F.col


def explode_urls(scored: DataFrame) -> DataFrame:
    """One row per (email, distinct URL) with every per-URL field."""
    return scored.select("email_id", F.explode("urls").alias("u")).select("email_id", "u.*")


def model_url_rows(emails: DataFrame) -> DataFrame:
    """URL-03b: the model-path URL list, one row per occurrence (position kept)."""
    urls = extract_urls_model(c("body_text"), c("body_html"))
    return emails.select("email_id", F.posexplode(urls).alias("pos", "url"))


def derived_model_scores(url_rows: DataFrame) -> DataFrame:
    """Stand-in model output for tests: probability = (length(url) % 100) / 100."""
    return url_rows.select("email_id", "url", ((F.length("url") % 100) / dbl(100.0)).alias("probability")).distinct()


def blend_url_scores(model_rows: DataFrame, model_scores: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """URL-20 / JOI-05: per URL occurrence, risk = round(.6 p + .4 rule, 4)
    when a rule row exists, else round(p, 4); per email .7 max + .3 mean."""
    r = rule_rows.select("email_id", "url", c("risk_score").alias("rule_risk"))
    j = model_rows.join(model_scores, ["email_id", "url"], "left").join(r, ["email_id", "url"], "left")
    p = F.coalesce(c("probability"), dbl(0.0))
    risk = F.when(c("rule_risk").isNotNull(), F.round(dbl(0.6) * p + dbl(0.4) * c("rule_risk"), 4)) \
        .otherwise(F.round(p, 4))
    band = F.when(p >= 0.7, F.lit("high")).when(p >= 0.5, F.lit("medium")).otherwise(F.lit("low"))
    rows = j.select("email_id", "url", F.round(p, 4).alias("model_score"), risk.alias("risk_score"), band.alias("band"))
    return rows.groupBy("email_id").agg(
        F.count("*").alias("url_count"),
        F.round(dbl(0.7) * F.max("risk_score") + dbl(0.3) * (F.sum("risk_score") / F.count("*")), 4).alias("url_score"),
        F.count_if(c("band") == "high").alias("n_high"), F.count_if(c("band") == "medium").alias("n_medium"))


def url_training_pairs(corpus: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """URL-21: every body URL with its row's label; rows without URLs drop
    out.  ``keep`` carries id columns along (with the URL's position)."""
    if keep:
        return corpus.select(*keep, F.posexplode(text_urls(c("body"))).alias("pos", "url"), c("label"))
    return corpus.select(F.explode(text_urls(c("body"))).alias("url"), c("label"))


def url_tokens(urls: DataFrame, col: str = "url", max_len: int = 200) -> DataFrame:
    """URL-22: 200 character ids per URL."""
    return urls.withColumn("tokens", tokenize_url(c(col), max_len))


def analyzed_rows(emails: DataFrame) -> DataFrame:
    """Rule rows for the distinct URLs of each email (input of the blend)."""
    from baitscope.functions.urls import extract_urls
    return emails.select("email_id", F.explode(analyze_urls(extract_urls(c("body_text"), c("body_html")))).alias("u")) \
        .select("email_id", "u.*")
