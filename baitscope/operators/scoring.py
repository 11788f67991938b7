"""End-to-end email scoring (CLS-12) as one narrow DataFrame transformation.

``score_emails`` is a chain of projections over the input rows: lexicon
matching, URL extraction and analysis (array columns), header and HTML
analysis, fusion, verdict and explanations.  It introduces no shuffle, so it
runs at scan speed on any number of partitions and keeps the input
partitioning for whatever comes next.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.functions import fusion as FU
from baitscope.functions import semantic as S
from baitscope.functions.headers import header_columns
from baitscope.functions.html import html_columns
from baitscope.functions.phrases import held_phrases
from baitscope.functions.urls import analyze_urls, extract_urls, url_rollup

c = F.col


@dataclass(frozen=True)
class EmailColumns:
    """Input column names (the derived ``emails`` table uses these)."""
    email_id: str = "email_id"
    subject: str = "subject"
    body: str = "body_text"
    html: str = "body_html"
    from_hdr: str = "from_hdr"
    reply_to: str = "reply_to"
    auth: str = "auth_results"
    x_mailer: str = "x_mailer"
    message_id: str = "message_id"
    date_hdr: str = "date_hdr"
    hops: str = "received_hops"


def _opt(df: DataFrame, name: str, typ: str = "string"):
    return c(name) if name in df.columns else F.lit(None).cast(typ)


@lru_cache(maxsize=32)
def _semantic_exprs():
    return S.semantic_columns(c("_raw"))


@lru_cache(maxsize=32)
def _structural_exprs(cols: EmailColumns, present: frozenset, relax_received: bool, strict_brands: bool = False):
    def opt(name, typ="string"):
        return c(name) if name in present else F.lit(None).cast(typ)
    body, html = opt(cols.body), opt(cols.html)
    hdr = header_columns(opt(cols.from_hdr), opt(cols.reply_to), opt(cols.auth), opt(cols.x_mailer),
                         opt(cols.message_id), opt(cols.date_hdr), opt(cols.hops, "int"),
                         relax_received=relax_received, strict_brands=strict_brands)
    return analyze_urls(extract_urls(body, html)), hdr, html_columns(html), url_rollup(c("urls"))


def semantic_stage(df: DataFrame, subject: str = "subject", body: str = "body_text") -> DataFrame:
    """LEX-01..16 columns added to ``df``."""
    # Steps of their own, so that the text and the pass over it are made once.
    text = df.withColumn("_text", S.analysis_text(c(subject), c(body)))
    text = text.withColumn("_lower", F.lower("_text")).withColumn("_held", held_phrases(c("_lower")))
    raw = text.withColumn("_raw", S.raw_matches(c("_text"), c("_lower"), c("_held"))).drop("_text", "_lower", "_held")
    cols = _semantic_exprs()
    out = raw.select("*", *[v.alias(k) for k, v in cols.items()]).drop("_raw")
    out = out.withColumn("semantic_score", S.combined_score(None))
    return out.withColumn("semantic_details", S.semantic_details()) \
        .withColumn("dominant_category", S.dominant_category())


STRUCTURAL = ("urls", "headers", "html")


def structural_stage(df: DataFrame, cols: EmailColumns = EmailColumns(), relax_received: bool = False,
                     strict_brands: bool = False, parts: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """URL, header and HTML columns added to ``df`` (URL-*, HDR-*, HTM-*).
    ``strict_brands`` also skips the very common brand words (one, app, best,
    home) in the sender check (HDR-03 option).  ``parts`` names the analyses to make."""
    urls, hdr, htm, rollup = _structural_exprs(cols, frozenset(df.columns), relax_received, strict_brands)
    first = {"urls": urls.alias("urls"), "headers": hdr.alias("_hdr"), "html": htm.alias("_htm")}
    packed = {"urls": "_url", "headers": "_hdr", "html": "_htm"}
    step = df.select("*", *[first[x] for x in STRUCTURAL if x in parts])
    if "urls" in parts:
        step = step.select("*", rollup.alias("_url"))
    names = [packed[x] for x in STRUCTURAL if x in parts]
    return step.select("*", *[f"{x}.*" for x in names]).drop(*names)


def score_emails(df: DataFrame, cols: EmailColumns = EmailColumns(), relax_received: bool = False,
                 strict_brands: bool = False, analyzed: bool = False) -> DataFrame:
    """CLS-12: every analysis column, the heuristic verdict and explanations.
    Rows that carry the columns of both stages (``analyzed``) are not analyzed again.

    Text input (no header block) is marked by a NULL hop count.  The rule
    vector and the 50-d structural vector are attached for the ML operators.
    The heuristic is degraded where a row has no ``embedding``.
    """
    scored = df if analyzed else structural_stage(semantic_stage(df, cols.subject, cols.body), cols, relax_received, strict_brands)
    first, second, third = _fusion_exprs("embedding" in df.columns)
    return scored.select("*", *first).select("*", *second).select("*", *third)


@lru_cache(maxsize=2)
def _fusion_exprs(embeddings: bool):
    embedded = c("embedding").isNotNull() if embeddings else F.lit(False)
    raw_conf = FU.heuristic_confidence(c("semantic_score"), c("url_score"), c("header_score"), c("html_score"))
    first = [
        FU.structural_score().alias("structural_score"),
        FU.structural_details().alias("structural_details"),
        FU.verdict(raw_conf).alias("verdict"),
        F.round(raw_conf, 4).alias("confidence"),
    ]
    second = [
        FU.recommended_action(c("verdict"), c("confidence")).alias("recommended_action"),
        F.lit("heuristic").alias("method"),
        F.lit("heuristic").alias("feature_mode"),
        (~embedded).alias("degraded_mode"),
        FU.rule_vector().alias("rule_vector"),
        FU.structural_vector().alias("structural_vector"),
        *FU.indicator_flags(),
    ]
    third = [
        FU.action_description(c("recommended_action")).alias("action_description"),
        FU.explanation().alias("explanation"),
        FU.education_note().alias("education_note"),
        FU.threat_indicators().alias("threat_indicators"),
    ]
    return first, second, third
