"""Lexicon scoring as column expressions (LEX-01 .. LEX-16).

The phrases that a text holds come from one pass over it (``phrases``); whole
words, grammar checks and the combined score are column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.functions.core import at, dbl, let, py_strip
from baitscope.resources import lexicons as L


def analysis_text(subject: Column, body: Column) -> Column:
    """PRJ-09: ``f"{subject} {body}".strip()`` (NULL parts read as empty)."""
    return py_strip(F.concat_ws(" ", F.coalesce(subject, F.lit("")), F.coalesce(body, F.lit(""))))


def match_phrases(t: Column, held: Column, phrases) -> Column:
    """LEX-01: of the phrases ``held`` as substrings those that match: acronyms
    and short phrases only as whole words of ``t``."""
    short = [ph for ph in phrases if L.is_whole_word(ph)]
    if not short:
        return held

    def test(p: Column) -> Column:
        expr = F
        for ph in short:
            expr = expr.when(p == ph, t.rlike(r"(?U)\b" + re.escape(ph) + r"\b"))
        return expr.otherwise(F.lit(True))

    return F.filter(held, test)


def count_to_score(n: Column) -> Column:
    """LEX-02: 0, .35, .60, .80, then min(.90 + .03 (n-4), 1), rounded 4."""
    return F.round(
        F.when(n == 0, dbl(0.0))
        .when(n == 1, dbl(0.35))
        .when(n == 2, dbl(0.60))
        .when(n == 3, dbl(0.80))
        .otherwise(F.least(dbl(0.90) + (n - 4) * dbl(0.03), dbl(1.0))),
        4,
    )


def _caps_ratio_high(text: Column) -> Column:
    """LEX-10: more than 30 % of whitespace tokens are upper case and longer than 1."""
    def body(words):
        n = F.size(words)
        caps = F.size(F.filter(words, lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)))
        return (n > 0) & (caps / n > 0.3)
    return let(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), body)


def raw_matches(text: Column, lowered: Column, held: Column) -> Column:
    """One struct with every phrase list's matches, brand mentions and grammar
    inputs, from a text, the same in lower case and ``phrases.held_phrases`` of that."""
    fields = [match_phrases(lowered, held[name], phrases).alias(name) for name, phrases in L.CATEGORIES]
    inner = F.struct(*fields, held["brands"].alias("brands"), held["misspellings"].alias("misspellings"))
    return F.struct(inner.alias("m"), _caps_ratio_high(text).alias("caps"),
                    (text.contains("!!!") | text.contains("???")).alias("punct"))


def semantic_columns(raw: Column) -> dict[str, Column]:
    """Scores derived from ``raw_matches`` (the caller binds ``raw`` to a column).

    Returns a mapping of output column name -> expression.
    """
    m = raw["m"]
    out: dict[str, Column] = {}
    for name, _ in L.CATEGORIES:
        out[f"{name}_matches"] = m[name]
        out[f"{name}_count"] = F.size(m[name])
        out[f"{name}_score"] = count_to_score(F.size(m[name]))
    out["brand_mentions"] = m["brands"]
    mis = m["misspellings"]
    issues = F.array_compact(F.array(
        F.when(raw["caps"], F.lit("Excessive capitalization")),
        F.when(raw["punct"], F.lit("Excessive punctuation")),
        F.when(F.size(mis) > 0, F.concat(F.lit("Suspicious misspellings: "), F.array_join(mis, ", "))),
    ))
    out["grammar_issues"] = issues
    out["grammar_score"] = F.round(F.least(F.size(issues) / dbl(3), dbl(1.0)), 4)
    return out


def combined_score(c=None) -> Column:
    """LEX-14 over columns already holding the category scores/counts; steps
    are bound with ``let`` so the expression stays linear in size."""
    u, a, p = F.col("urgency_score"), F.col("authority_score"), F.col("pressure_score")
    g, r, cr = F.col("generic_greetings_score"), F.col("reward_lures_score"), F.col("credential_requests_score")
    gram = F.col("grammar_score")
    weighted = (u * dbl(0.20) + a * dbl(0.15) + p * dbl(0.15) + g * dbl(0.10)
                + r * dbl(0.10) + cr * dbl(0.20) + gram * dbl(0.10))
    has_brand = F.size(F.col("brand_mentions")) > 0
    uc, cc = F.col("urgency_count") > 0, F.col("credential_requests_count") > 0

    def body(top):
        top0, top1 = at(top, 1), at(top, 2)
        n_flag = F.size(F.filter(top, lambda s: s >= 0.3))
        return let(weighted, lambda w0: let(
            F.when(top0 >= 0.35, F.greatest(w0, top0 * dbl(0.75))).otherwise(w0),
            lambda s1: let(
                F.when(n_flag >= 2, F.greatest(s1, (top0 + top1) / dbl(2) * dbl(0.85))).otherwise(s1),
                lambda s2: let(
                    F.when(has_brand & (uc | cc), F.greatest(s2, dbl(0.45))).otherwise(s2),
                    lambda s3: F.round(F.least(
                        F.when(has_brand & uc & cc, F.greatest(s3, dbl(0.60))).otherwise(s3), dbl(1.0)), 4)))))
    return let(F.sort_array(F.array(u, a, p, cr, r), asc=False), body)


_DETAIL_PREFIX = [
    ("urgency", "Urgency cues: ", 5),
    ("authority", "Authority references: ", 5),
    ("pressure", "Pressure tactics: ", 5),
    ("generic_greetings", "Generic greetings: ", 3),
    ("reward_lures", "Reward/lure language: ", 3),
    ("credential_requests", "Credential requests: ", 3),
]


def semantic_details() -> Column:
    """LEX-15: detail strings (array)."""
    parts = []
    for name, prefix, k in _DETAIL_PREFIX:
        ms = F.col(f"{name}_matches")
        parts.append(F.when(F.size(ms) > 0, F.concat(F.lit(prefix), F.array_join(F.slice(ms, 1, k), ", "))))
    gi = F.col("grammar_issues")
    parts.append(F.when(F.size(gi) > 0, F.concat(F.lit("Grammar issues: "), F.array_join(gi, ", "))))
    bm = F.col("brand_mentions")
    parts.append(F.when(F.size(bm) > 0, F.concat(F.lit("Brand names mentioned: "), F.array_join(F.slice(bm, 1, 5), ", "))))
    arr = F.array_compact(F.array(*parts))
    return F.when(F.size(arr) > 0, arr).otherwise(F.array(F.lit("No suspicious semantic patterns detected")))


_DOMINANT_ORDER = ["urgency", "authority", "pressure", "credential_requests", "reward_lures", "generic_greetings"]


def dominant_category() -> Column:
    """LEX-16: argmax of the six scores, earlier category wins ties."""
    best = F.greatest(*[F.col(f"{c}_score") for c in _DOMINANT_ORDER])
    expr = None
    for c in _DOMINANT_ORDER:
        cond = F.col(f"{c}_score") == best
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr
