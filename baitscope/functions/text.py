"""Text normalisation and input parsing (PRJ-01 .. PRJ-09)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from baitscope.functions.core import py_strip
from baitscope.functions.html import strip_html_tags


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x) if isinstance(x, str) else None)


def nfkc(s: Column | str) -> Column:
    """PRJ-01: Unicode NFKC (no built-in equivalent); Arrow-batched.

    NFKC folds compatibility forms (full-width letters, ligatures) but does
    not map Cyrillic look-alikes to Latin.  It leaves ASCII as it is, so only
    other texts go to Python."""
    s = F.col(s) if isinstance(s, str) else s
    return F.coalesce(_nfkc(F.when(s.rlike(r"[^\x00-\x7F]"), s)), s)


# FIXED VALUES: label words (case-sensitive loader form, then the
# case-insensitive evaluation form).
POSITIVE_STRICT = ["1", "spam", "phishing", "phish"]
NEGATIVE_STRICT = ["0", "ham", "legitimate", "legit"]
POSITIVE_LOOSE = ["1", "phishing", "phishing email", "spam", "phish"]
NEGATIVE_LOOSE = ["0", "ham", "legitimate", "legit", "safe", "safe email", "not phishing"]


def _numeric_label(s: Column) -> Column:
    d = F.try_cast(s, "double") if hasattr(F, "try_cast") else s.try_cast("double")
    v = F.when(~F.isnan(d), d.cast("long"))
    return F.when(v.isin(0, 1), v.cast("int"))


def normalize_label_strict(raw: Column) -> Column:
    """PRJ-07a: trimmed, case-sensitive words, else int(float(x)) in {0, 1}."""
    s = py_strip(F.coalesce(raw, F.lit("")))
    return F.when(s.isin(POSITIVE_STRICT), F.lit(1)).when(s.isin(NEGATIVE_STRICT), F.lit(0)) \
        .otherwise(_numeric_label(s))


def normalize_label_loose(raw: Column) -> Column:
    """PRJ-07b: trimmed and lower-cased, with the extra evaluation words."""
    s = F.lower(py_strip(F.coalesce(raw, F.lit(""))))
    return F.when(s.isin(POSITIVE_LOOSE), F.lit(1)).when(s.isin(NEGATIVE_LOOSE), F.lit(0)) \
        .otherwise(_numeric_label(s))


def parse_text_input(subject: Column, body: Column, normalize: bool = True) -> Column:
    """PRJ-04/05/08: text input -> parsed-email struct.  A body holding
    ``<html`` becomes the HTML part and its stripped text the body."""
    subj = nfkc(subject) if normalize else F.coalesce(subject, F.lit(""))
    bod = nfkc(body) if normalize else F.coalesce(body, F.lit(""))
    s, b = py_strip(F.coalesce(subj, F.lit(""))), py_strip(F.coalesce(bod, F.lit("")))
    is_html = (b != "") & F.lower(b).contains("<html")
    text = F.when(is_html, strip_html_tags(b)).otherwise(b)
    return F.struct(
        s.alias("subject"), text.alias("body_text"),
        F.when(is_html, b).otherwise(F.lit("")).alias("body_html"),
        F.lit("text").alias("input_type"),
        F.when((s == "") & (text == ""), F.lit("Both subject and body are empty")).alias("parse_error"),
    )


def truncate(col: Column, n: int) -> Column:
    """PRJ-06: trim then keep the first ``n`` characters."""
    return F.substring(py_strip(F.coalesce(col, F.lit(""))), 1, n)
