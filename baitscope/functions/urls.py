"""URL extraction and risk scoring as column expressions (URL-01 .. URL-22).

Per-email work stays inside the row: the URL list is an array column and
each URL is analysed with ``transform``; the per-email rollup uses array
aggregates.  Nothing here shuffles.  ``baitscope.operators.urls`` offers the
exploded one-row-per-URL table for URL-level reports.
"""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.functions.core import at, dbl, let, lit_array
from baitscope.resources import lexicons as L

URL_RE = r"""(?iU)https?://[^\s<>"')\]]+|www\.[^\s<>"')\]]+"""
HREF_RE = r"""(?i)href\s*=\s*["']([^"']+)["']"""
_SCHEME_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_NETLOC_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"
_PATH_RE = r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)"
_IPV4_RE = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def _with_http(u: Column) -> Column:
    return F.when(u.startswith("http"), u).otherwise(F.concat(F.lit("http://"), u))


def text_urls(text: Column) -> Column:
    """URL-01: URLs in plain text, trailing punctuation removed, http:// added."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(URL_RE), 0)
    return F.transform(found, lambda u: _with_http(F.regexp_replace(u, r"[.,;:!?)]+$", "")))


def href_urls(html: Column) -> Column:
    """URL-02: href values that start with http://, https:// or www."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(HREF_RE), 1)
    keep = F.filter(found, lambda h: h.startswith("http://") | h.startswith("https://") | h.startswith("www."))
    return F.transform(keep, _with_http)


def extract_urls(text: Column, html: Column) -> Column:
    """URL-03: distinct union of text and href URLs, sorted."""
    return F.array_sort(F.array_distinct(F.concat(text_urls(text), href_urls(html))))


def extract_urls_model(text: Column, html: Column) -> Column:
    """URL-03b: model-path list; duplicates kept unless HTML is present."""
    both = F.concat(text_urls(text), href_urls(html))
    has_html = F.coalesce(html, F.lit("")) != ""
    return F.when(has_html, F.array_distinct(both)).otherwise(text_urls(text))


def decode_url(u: Column) -> Column:
    """URL-04: percent-decoding that keeps '+' and leaves bad input unchanged."""
    return F.coalesce(F.try_url_decode(F.replace(u, F.lit("+"), F.lit("%2B"))), u)


def url_host(decoded: Column) -> Column:
    """Host of a URL: authority without user info and port, lower case."""
    netloc = F.regexp_extract(decoded, _NETLOC_RE, 1)
    no_user = F.regexp_replace(netloc, r"^.*@", "")
    return F.lower(F.regexp_replace(no_user, r":.*$", ""))


def domain_parts(host: Column) -> Column:
    """URL-05 fallback rule: last label suffix, previous domain, rest subdomain."""
    def body(parts):
        n = F.size(parts)
        return F.struct(
            F.when(n >= 3, F.array_join(F.slice(parts, 1, n - 2), ".")).otherwise(F.lit("")).alias("subdomain"),
            F.when(n >= 3, at(parts, -2)).when(n == 2, at(parts, 1))
            .otherwise(host).alias("domain"),
            F.when(n >= 2, at(parts, -1)).otherwise(F.lit("")).alias("suffix"),
            F.when(n >= 3, F.concat_ws(".", at(parts, -2), at(parts, -1)))
            .otherwise(host).alias("registered"),
        )
    return let(F.split(host, r"\."), body)


def typosquat(domain: Column) -> Column:
    """URL-15: nearest brand by edit distance, first brand wins ties.

    Only distances up to 2 count, so brands whose length differs by more are
    left out, and the others are measured within a band of 2."""
    brands = lit_array(L.TYPOSQUAT_BRANDS)

    def body(x):
        near = F.filter(brands, lambda b: F.abs(F.length(b) - x["n"]) <= 2)
        found = F.transform(near, lambda b: F.struct(F.levenshtein(x["d"], b, 2).alias("d"), F.array_position(brands, b).alias("i"), b.alias("b")))
        return let(F.array_min(F.filter(found, lambda f: f["d"] >= 0)), result(x["n"]))

    def result(n):
        def best(f):
            hit = F.coalesce(f["d"] > 0, F.lit(False))
            return F.struct(F.when(hit, dbl(1.0) - f["d"] / F.greatest(n, F.length(f["b"]))).otherwise(dbl(0.0)).alias("score"),
                            F.when(hit, f["b"]).alias("target"))
        return best

    return let(F.struct(domain.alias("d"), F.length(domain).alias("n")), body)


def _free_hosting(host: Column, registered: Column) -> Column:
    plats = lit_array(L.free_hosting_priority())
    return at(F.filter(plats, lambda p: host.endswith(p) | (registered == p)), 1)


def analyze_url(u: Column) -> Column:
    """URL-04 .. URL-17 for one URL: flags, typosquatting and risk."""
    def with_decoded(d):
        def with_host(h):
            def with_parts(dp):
                def with_typo(ty):
                    path = F.lower(F.regexp_extract(d, _PATH_RE, 1))
                    authority = F.regexp_replace(F.regexp_replace(d, r"^.*?//", ""), r"/.*$", "")
                    sub = dp["subdomain"]
                    kws = F.array_sort(F.filter(lit_array(L.PATH_KEYWORDS), lambda k: path.contains(k)))
                    platform = _free_hosting(h, F.lower(dp["registered"]))
                    return F.struct(
                        u.alias("url"),
                        h.rlike(_IPV4_RE).alias("is_ip_based"),
                        F.lower(dp["registered"]).isin(L.URL_SHORTENERS).alias("uses_shortener"),
                        platform.isNotNull().alias("uses_free_hosting"),
                        platform.alias("free_hosting_platform"),
                        F.lower(dp["suffix"]).isin(L.SUSPICIOUS_TLDS).alias("suspicious_tld"),
                        (F.length(h) > 30).alias("long_domain"),
                        authority.contains("@").alias("has_at_symbol"),
                        (F.when(sub != "", F.size(F.split(sub, r"\."))).otherwise(0) > 3).alias("excessive_subdomains"),
                        (F.length(dp["domain"]) - F.length(F.replace(dp["domain"], F.lit("-"), F.lit(""))) > 2)
                        .alias("excessive_hyphens"),
                        (F.lower(F.regexp_extract(d, _SCHEME_RE, 1)) == "https").alias("uses_https"),
                        ty["score"].alias("typosquatting_score"),
                        ty["target"].alias("typosquatting_target"),
                        (F.size(kws) > 0).alias("suspicious_path"),
                        kws.alias("suspicious_path_keywords"),
                    )
                return let(typosquat(F.lower(dp["domain"])), with_typo)
            return let(domain_parts(h), with_parts)
        return let(url_host(d), with_host)
    return let(decode_url(u), with_decoded).alias("info")


def url_risk(x: Column) -> Column:
    """URL-17: weighted sum of flags, capped at 1 (additions in fixed order)."""
    def w(cond, weight):
        return F.when(cond, dbl(weight)).otherwise(dbl(0.0))
    risk = (dbl(0.0) + w(x["is_ip_based"], 0.25) + w(x["uses_shortener"], 0.15)
            + w(x["suspicious_tld"], 0.15) + w(x["long_domain"], 0.05)
            + w(x["has_at_symbol"], 0.20) + w(x["excessive_subdomains"], 0.10)
            + w(x["excessive_hyphens"], 0.05) + w(~x["uses_https"], 0.05)
            + w(x["typosquatting_score"] > 0.5, 0.25) + w(x["suspicious_path"], 0.10)
            + w(x["uses_free_hosting"], 0.30))
    return F.least(risk, dbl(1.0))


def url_flags_text(x: Column) -> Column:
    """URL-19: flag strings for one analysed URL, in rule order."""
    return F.array_compact(F.array(
        F.when(x["is_ip_based"], F.lit("IP-based URL")),
        F.when(x["uses_shortener"], F.lit("URL shortener")),
        F.when(x["suspicious_tld"], F.lit("Suspicious TLD")),
        F.when(x["typosquatting_score"] > 0.5,
               F.concat(F.lit("Possible typosquatting of '"), x["typosquatting_target"], F.lit("'"))),
        F.when(x["has_at_symbol"], F.lit("Contains @ symbol")),
        F.when(x["suspicious_path"],
               F.concat(F.lit("Suspicious path keywords: "), F.array_join(x["suspicious_path_keywords"], ", "))),
        F.when(x["uses_free_hosting"],
               F.concat(F.lit("Free hosting platform ("), x["free_hosting_platform"], F.lit(")"))),
        F.when(~x["uses_https"], F.lit("No HTTPS")),
    ))


def analyze_urls(urls: Column) -> Column:
    """Array of per-URL structs with risk attached.  A URL whose authority has an
    unmatched bracket cannot be taken apart: its risk is .5 and it resembles no brand."""
    def one(x):
        authority = F.regexp_extract(x["url"], _NETLOC_RE, 1)
        broken = F.contains(authority, F.lit("[")) != F.contains(authority, F.lit("]"))
        risk = F.when(broken, dbl(0.5)).otherwise(url_risk(x))
        return (x.withField("typosquatting_score", F.when(broken, dbl(0.0)).otherwise(x["typosquatting_score"]))
                .withField("typosquatting_target", F.when(~broken, x["typosquatting_target"])).withField("risk_score", risk))

    return F.transform(urls, lambda u: let(analyze_url(u), one))


def url_rollup(infos: Column) -> Column:
    """URL-18/19: count, overall score (.7 max + .3 mean, round 4) and details."""
    def body(xs):
        n = F.size(xs)
        risks = F.transform(xs, lambda x: x["risk_score"])
        mx = F.array_max(risks)
        total = F.aggregate(risks, dbl(0.0), lambda acc, r: acc + r)
        overall = F.when(n > 0, F.round(dbl(0.7) * mx + dbl(0.3) * (total / n), 4)).otherwise(dbl(0.0))
        lines = F.filter(
            F.transform(xs, lambda x: let(url_flags_text(x), lambda fl: F.when(
                F.size(fl) > 0, F.concat(x["url"], F.lit(": "), F.array_join(fl, "; "))))),
            lambda s: s.isNotNull())
        details = (F.when(n == 0, F.array(F.lit("No URLs found in email content")))
                   .when(F.size(lines) == 0, F.array(F.lit("No suspicious URL indicators found")))
                   .otherwise(lines))
        return F.struct(n.alias("url_count"), overall.alias("url_score"), details.alias("url_details"),
                        F.coalesce(mx, dbl(0.0)).alias("max_risk"), total.alias("sum_risk"))
    return let(infos, body)


# Character vocabulary of the URL tokenizer: Python's ``string.printable``
# (100 characters, ids 1..100 in that order; unknown characters map to 0).
URL_VOCAB = string.printable


def tokenize_url(u: Column, max_len: int = 200) -> Column:
    """URL-22: character ids, unknown -> 0, padded with 0 / cut to ``max_len``."""
    chars = F.slice(F.split(F.coalesce(u, F.lit("")), ""), 1, max_len)
    ids = F.transform(chars, lambda c: F.coalesce(
        (F.instr(F.lit(URL_VOCAB), c)).cast("int") * F.when(F.length(c) == 1, 1).otherwise(0), F.lit(0)))
    pad = F.array_repeat(F.lit(0), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0)))
    return F.slice(F.concat(ids, pad), 1, max_len)
