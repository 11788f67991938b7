"""Fusion, heuristic classification and explanations (FUS-*, CLS-01..03, EXP-*).

All functions read the flat columns produced by ``score_emails`` stages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.functions.core import at, dbl, flag, let
from baitscope.resources import lexicons as L

c = F.col


def structural_score() -> Column:
    """FUS-05: .40 url + .35 header + .25 html, capped, round 4."""
    return F.round(F.least(c("url_score") * dbl(0.40) + c("header_score") * dbl(0.35)
                           + c("html_score") * dbl(0.25), dbl(1.0)), 4)


def structural_details() -> Column:
    """FUS-06: detail lists joined, dropping only the three exact placeholders."""
    def keep(col, placeholder):
        return F.when((F.size(col) == 1) & (at(col, 1) == placeholder), F.array().cast("array<string>")) \
            .otherwise(col)
    allx = F.concat(keep(c("url_details"), "No URLs found in email content"),
                    keep(c("header_details"), "No header anomalies detected"),
                    keep(c("html_details"), "No suspicious HTML elements detected"))
    return F.when(F.size(allx) > 0, allx).otherwise(F.array(F.lit("No structural anomalies detected")))


def _count(pred) -> Column:
    return F.size(F.filter(c("urls"), pred)).cast("double")


def structural_vector() -> Column:
    """FUS-01: the 50-d structural feature vector."""
    urls = c("urls")
    n = F.size(urls)
    u, h, m = c("url_score"), c("header_score"), c("html_score")
    spf = F.when(c("spf_result") == "pass", 0.0).when(c("spf_result") == "softfail", 0.7) \
        .when(c("spf_result") == "fail", 1.0).otherwise(0.5)
    dkim = F.when(c("dkim_result") == "pass", 0.0).when(c("dkim_result") == "fail", 1.0).otherwise(0.5)
    dmarc = F.when(c("dmarc_result") == "pass", 0.0).when(c("dmarc_result") == "fail", 1.0).otherwise(0.5)

    def b(col):
        return F.when(col, 1.0).otherwise(0.0)

    def capped(col, cap):
        return F.least(col, F.lit(cap)) / dbl(cap)
    zeros = [dbl(0.0)]
    vec = [
        n.cast("double"), u,
        _count(lambda x: x["is_ip_based"]), _count(lambda x: x["uses_shortener"]),
        _count(lambda x: x["suspicious_tld"]), _count(lambda x: x["long_domain"]),
        _count(lambda x: x["has_at_symbol"]), _count(lambda x: x["excessive_subdomains"]),
        _count(lambda x: x["excessive_hyphens"]), _count(lambda x: ~x["uses_https"]),
        F.coalesce(F.array_max(F.transform(urls, lambda x: x["typosquatting_score"])), dbl(0.0)),
        _count(lambda x: x["suspicious_path"]),
        c("max_risk"), c("sum_risk") / F.greatest(n, F.lit(1)),
        F.least(n, F.lit(20)) / dbl(20.0),
        spf, dkim, dmarc, b(c("reply_to_mismatch")), b(c("display_name_mismatch")),
        b(c("x_mailer_suspicious")), b(c("missing_message_id")), b(c("missing_date")),
        b(c("suspicious_received_chain")), capped(c("received_hop_count"), 15), h,
    ] + zeros * 4 + [
        capped(c("hidden_element_count"), 10), capped(c("external_form_count"), 5),
        capped(c("tracking_pixel_count"), 5), capped(c("external_image_count"), 20),
        capped(c("iframe_count"), 5), b(c("has_obfuscated_js")), capped(c("base64_content_count"), 10), m,
    ] + zeros * 7 + [
        u * h, F.greatest(u, h), (u + h + m) / dbl(3.0),
        b((n > 0) & c("display_name_mismatch")), b((c("external_form_count") > 0) & (n > 0)),
    ]
    return F.array(*[x.cast("double") for x in vec])


def rule_vector() -> Column:
    """FUS-02: 6 x (score, count), grammar, combined, brand count, 5 zeros."""
    vals = []
    for name, _ in L.CATEGORIES:
        vals += [c(f"{name}_score"), c(f"{name}_count")]
    vals += [c("grammar_score"), c("semantic_score"), F.size(c("brand_mentions"))]
    vals += [dbl(0.0)] * 5
    return F.array(*[v.cast("double") for v in vals])


def fit_length(vec: Column, n: int) -> Column:
    """FUS-04: zero-pad or truncate to ``n``."""
    return F.slice(F.concat(vec, F.array_repeat(dbl(0.0), n)), 1, n)


def heuristic_confidence(sem: Column, url: Column, hdr: Column, htm: Column) -> Column:
    """CLS-01 (unrounded).  Each step is bound once with ``let`` so the
    expression stays linear in size when the optimizer inlines it."""
    def steps(x):
        s, u, h, m = x["s"], x["u"], x["h"], x["m"]
        conf = s * dbl(0.35) + u * dbl(0.30) + h * dbl(0.20) + m * dbl(0.15)
        mx = F.greatest(s, u, h, m)
        flagged = sum([F.when(v > 0.2, 1).otherwise(0) for v in (s, u, h, m)])
        return let(F.struct(conf.alias("c"), mx.alias("mx"), flagged.alias("f")), lambda y: let(
            F.when(y["mx"] > 0.4, F.greatest(y["c"], y["mx"] * dbl(0.70))).otherwise(y["c"]),
            lambda c1: let(
                F.when(y["f"] >= 2, c1 * dbl(1.15)).otherwise(c1),
                lambda c2: let(
                    F.when(y["f"] >= 3, c2 * dbl(1.10)).otherwise(c2),
                    lambda c3: let(
                        F.when(c3 > 0.2, dbl(0.2) + (c3 - dbl(0.2)) * dbl(1.3)).otherwise(c3),
                        lambda c4: F.least(F.greatest(c4, dbl(0.0)), dbl(1.0)))))))
    return let(F.struct(sem.alias("s"), url.alias("u"), hdr.alias("h"), htm.alias("m")), steps)


def verdict(raw_conf: Column) -> Column:
    """CLS-02: compared before rounding."""
    return F.when(raw_conf >= 0.40, F.lit("phishing")).when(raw_conf >= 0.22, F.lit("suspicious")) \
        .otherwise(F.lit("legitimate"))


def recommended_action(verd: Column, conf: Column) -> Column:
    """CLS-03."""
    return F.when((verd == "phishing") & (conf > 0.75), F.lit("quarantine")) \
        .when(verd.isin("phishing", "suspicious"), F.lit("alert")).otherwise(F.lit("pass"))


_ACTION_TEXT = {
    "quarantine": "Quarantine this email immediately. High confidence phishing detected.",
    "alert": "Flag for manual review. Suspicious indicators detected.",
    "pass": "No significant phishing indicators detected. Email appears legitimate.",
}


def action_description(action: Column) -> Column:
    expr = None
    for k, v in _ACTION_TEXT.items():
        expr = F.when(action == k, F.lit(v)) if expr is None else expr.when(action == k, F.lit(v))
    return expr


def _pct(x: Column) -> Column:
    """``f"{x*100:.1f}"``: half-even rounding of the exact binary value."""
    return F.format_number(x * dbl(100), 1)


def explanation() -> Column:
    """EXP-01."""
    conf = c("confidence")
    first = lambda col: at(col, 1)
    reasons = F.array_compact(F.array(
        F.when(F.size(c("urgency_matches")) > 0,
               F.concat(F.lit("urgency language (e.g., '"), first(c("urgency_matches")), F.lit("')"))),
        F.when(F.size(c("authority_matches")) > 0,
               F.concat(F.lit("authority impersonation (references to '"), first(c("authority_matches")), F.lit("')"))),
        F.when(F.size(c("credential_requests_matches")) > 0, F.lit("requests for sensitive credentials")),
        F.when(F.size(c("pressure_matches")) > 0, F.lit("time-pressure tactics")),
        F.when((c("url_score") > 0.3) & (c("url_count") > 0),
               F.concat(F.lit("suspicious URLs ("), c("url_count").cast("string"), F.lit(" found)"))),
        F.when((c("header_score") > 0.3) & (c("spf_result") == "fail"), F.lit("failed SPF authentication")),
        F.when((c("header_score") > 0.3) & c("display_name_mismatch"), F.lit("sender display name mismatch")),
        F.when((c("header_score") > 0.3) & c("reply_to_mismatch"), F.lit("Reply-To address mismatch")),
        F.when((c("html_score") > 0.2) & (c("external_form_count") > 0),
               F.lit("embedded forms pointing to external domains")),
        F.when((c("html_score") > 0.2) & c("has_obfuscated_js"), F.lit("obfuscated JavaScript code")),
    ))
    n = F.size(reasons)
    reason_text = F.when(n > 1, F.concat(F.array_join(F.slice(reasons, 1, n - 1), ", "), F.lit(", and "),
                                         at(reasons, -1))).otherwise(first(reasons))
    phishing = F.when(n > 0, F.concat(
        F.lit("This email was classified as PHISHING with "), _pct(conf), F.lit("% confidence. "),
        F.lit("The analysis detected "), reason_text, F.lit(". "),
        F.lit("These are strong indicators of a phishing attempt designed to deceive "
              "the recipient into revealing sensitive information or taking harmful actions."),
    )).otherwise(F.concat(
        F.lit("This email was classified as PHISHING with "), _pct(conf),
        F.lit("% confidence based on a combination of semantic and structural indicators that match "
              "known phishing patterns."),
    ))
    inds = F.array_compact(F.array(
        F.when(c("semantic_score") > 0.2, F.lit("some suspicious language patterns")),
        F.when(c("url_score") > 0.2, F.lit("potentially suspicious URLs")),
        F.when(c("header_score") > 0.2, F.lit("minor header anomalies")),
    ))
    ind_text = F.when(F.size(inds) > 0, F.array_join(inds, ", ")).otherwise(F.lit("borderline indicators"))
    suspicious = F.concat(
        F.lit("This email was classified as SUSPICIOUS with "), _pct(conf), F.lit("% confidence. "),
        F.lit("The analysis found "), ind_text,
        F.lit(", but the evidence is not conclusive enough for a definitive phishing classification. "
              "Manual review is recommended to determine if this email is legitimate."),
    )
    legit = F.concat(
        F.lit("This email appears to be LEGITIMATE with "), _pct(dbl(1.0) - conf), F.lit("% confidence. "),
        F.lit("No significant phishing indicators were detected in the content, URLs, "
              "headers, or HTML structure. Standard security hygiene is still recommended."),
    )
    v = c("verdict")
    return F.when(v == "legitimate", legit).when(v == "suspicious", suspicious).otherwise(phishing)


# FIXED VALUES: education note texts.
EDU_LEGIT = ("Even legitimate-looking emails can sometimes be phishing attempts. "
             "Always verify sender addresses, hover over links before clicking, "
             "and never share passwords or sensitive information via email.")
EDU_URGENCY = ("URGENCY TACTICS: Phishing emails often create a false sense of urgency "
               "('account suspended', 'act immediately') to pressure you into acting "
               "without thinking. Legitimate organizations rarely demand immediate action via email.")
EDU_AUTHORITY = ("AUTHORITY IMPERSONATION: Attackers impersonate trusted entities (banks, "
                 "tech companies, executives) to gain your trust. Always verify through "
                 "official channels — call the organization directly using a known number.")
EDU_CREDENTIALS = ("CREDENTIAL HARVESTING: This email attempts to collect sensitive information. "
                   "No legitimate organization will ask for passwords, SSN, or full credit card "
                   "numbers via email. Report such requests to your security team.")
EDU_TYPO_PREFIX = "TYPOSQUATTING: The email contains a URL that closely mimics '"
EDU_TYPO_SUFFIX = ("' but is slightly different. Always carefully check domain names — "
                   "attackers register look-alike domains to steal credentials.")
EDU_GENERAL = ("GENERAL PHISHING: This email exhibits patterns commonly seen in phishing "
               "attacks. Be cautious with any email that asks you to click links, download "
               "attachments, or provide personal information. When in doubt, contact the "
               "supposed sender through a known, verified channel.")


def education_note() -> Column:
    """EXP-02."""
    typo = at(F.filter(c("urls"), lambda x: x["typosquatting_score"] > 0.5), 1)
    notes = F.array_compact(F.array(
        F.when(F.size(c("urgency_matches")) > 0, F.lit(EDU_URGENCY)),
        F.when(F.size(c("authority_matches")) > 0, F.lit(EDU_AUTHORITY)),
        F.when(F.size(c("credential_requests_matches")) > 0, F.lit(EDU_CREDENTIALS)),
        F.when(typo.isNotNull(), F.concat(F.lit(EDU_TYPO_PREFIX),
                                          F.coalesce(typo["typosquatting_target"], F.lit("a known brand")),
                                          F.lit(EDU_TYPO_SUFFIX))),
    ))
    joined = F.when(F.size(notes) > 0, F.array_join(notes, " | ")).otherwise(F.lit(EDU_GENERAL))
    return F.when(c("verdict") == "legitimate", F.lit(EDU_LEGIT)).otherwise(joined)


def _drop_placeholder(col: Column, placeholder: str) -> Column:
    return F.when((F.size(col) == 1) & (at(col, 1) == placeholder), F.array().cast("array<string>")) \
        .otherwise(col)


def threat_indicators() -> Column:
    """EXP-03: five {score, details} indicators."""
    def ind(score, details):
        return F.struct(score.alias("score"), details.alias("details"))
    return F.struct(
        ind(c("url_score"), _drop_placeholder(c("url_details"), "No URLs found in email content"))
        .alias("suspicious_urls"),
        ind(F.round(c("urgency_score") * dbl(0.4) + c("authority_score") * dbl(0.3)
                    + c("pressure_score") * dbl(0.3), 4),
            F.concat(c("urgency_matches"), c("authority_matches"), c("pressure_matches")))
        .alias("urgency_language"),
        ind(c("header_score"), _drop_placeholder(c("header_details"), "No header anomalies detected"))
        .alias("header_anomalies"),
        ind(c("grammar_score"), c("grammar_issues")).alias("grammatical_anomalies"),
        ind(c("html_score"), _drop_placeholder(c("html_details"), "No suspicious HTML elements detected"))
        .alias("html_suspicious"),
    )


def indicator_flags() -> list[Column]:
    """FUS-07: the 20 0/1 indicator columns, named as in ``INDICATOR_NAMES``."""
    urls = c("urls")

    def any_url(pred):
        return F.exists(urls, pred)
    rule = [
        (c(f"{n}_count") > 0) | (c(f"{n}_score") > 0) for n, _ in L.CATEGORIES
    ]
    exprs = rule + [
        c("grammar_score") > 0,
        F.size(c("brand_mentions")) > 0,
        any_url(lambda x: x["is_ip_based"]),
        any_url(lambda x: x["uses_shortener"]),
        any_url(lambda x: x["suspicious_tld"]),
        any_url(lambda x: ~x["uses_https"]),
        any_url(lambda x: x["typosquatting_score"] > 0.5),
        any_url(lambda x: x["suspicious_path"]),
        any_url(lambda x: x["uses_free_hosting"]),
        c("spf_result") == "fail",
        c("dkim_result") == "fail",
        c("display_name_mismatch"),
        c("external_form_count") > 0,
        c("has_obfuscated_js"),
    ]
    return [flag(e).alias(name) for e, name in zip(exprs, L.INDICATOR_NAMES)]
