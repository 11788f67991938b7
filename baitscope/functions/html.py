"""HTML analysis as column expressions (HTM-01 .. HTM-09, PRJ-02..04)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.functions.core import dbl, let, py_strip
from baitscope.resources import lexicons as L

FORM_RE = r"""(?i)<form[^>]*action\s*=\s*["']([^"']+)["']"""
IMG_RE = r"""(?i)<img[^>]*src\s*=\s*["']([^"']+)["']"""
SCRIPT_RE = r"(?is)<script[^>]*>(.*?)</script>"
BASE64_RE = r"(?i)(?:data:[^;]+;base64,|[A-Za-z0-9+/]{50,}={0,2})"


# Lower-case keyword each hidden-element pattern needs (same order).
_HIDDEN_KEYWORDS = ["display", "visibility", "opacity", "height", "width", "font-size", "position"]


def _external(u: Column) -> Column:
    return u.startswith("http://") | u.startswith("https://")


def strip_html_tags(html: Column) -> Column:
    """PRJ-02: drop style and script blocks, tags to spaces, squeeze spaces."""
    t = F.regexp_replace(html, r"(?is)<style[^>]*>.*?</style>", "")
    t = F.regexp_replace(t, r"(?is)<script[^>]*>.*?</script>", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return py_strip(F.regexp_replace(t, r"(?U)\s+", " "))


def strip_html_corpus(html: Column) -> Column:
    """PRJ-03: corpus stripper; tags to spaces, four entities, squeeze (keeps script text)."""
    t = F.regexp_replace(html, r"<[^>]+>", " ")
    t = F.regexp_replace(t, "&nbsp;", " ")
    t = F.regexp_replace(t, "&amp;", "&")
    t = F.regexp_replace(t, "&lt;", "<")
    t = F.regexp_replace(t, "&gt;", ">")
    return py_strip(F.regexp_replace(t, r"(?U)\s+", " "))


def html_columns(html: Column) -> Column:
    """HTM-01 .. HTM-09 as one struct."""
    def body(h):
        return let(F.lower(h), lambda lh: _analyze(h, lh))

    def _analyze(h, lh):
        # Each regex runs only when its keyword occurs in the lower-cased
        # page: a cheap substring scan that skips most regex passes.
        def gated(keyword, expr, default):
            return F.when(lh.contains(keyword), expr).otherwise(default)
        empty = F.array().cast("array<string>")
        hidden = None
        for kw, p in zip(_HIDDEN_KEYWORDS, L.HIDDEN_PATTERNS):
            c = gated(kw, F.regexp_count(h, F.lit(p)), F.lit(0))
            hidden = c if hidden is None else hidden + c
        forms = F.filter(gated("<form", F.regexp_extract_all(h, F.lit(FORM_RE), 1), empty), _external)
        tags = gated("<img", F.regexp_extract_all(h, F.lit(IMG_RE), 0), empty)
        imgs = F.filter(
            F.transform(tags, lambda t: F.struct(t.alias("tag"), F.regexp_extract(t, IMG_RE, 1).alias("src"))),
            lambda x: _external(x["src"]))
        pixels = F.filter(imgs, lambda x: let(F.lower(x["tag"]), lambda lt: lt.contains('width="1"')
                                              | lt.contains('height="1"') | lt.contains('width="0"')
                                              | lt.contains('height="0"'))
                          | F.lower(x["src"]).contains("1x1"))
        iframes = gated("<iframe", F.regexp_count(h, F.lit("(?i)<iframe")), F.lit(0))
        scripts = gated("<script", F.regexp_extract_all(h, F.lit(SCRIPT_RE), 1), empty)
        js = F.array_distinct(F.flatten(F.transform(scripts, lambda s: F.array_compact(F.array(
            *[F.when(s.rlike(p), F.lit(name)) for name, p in L.JS_OBFUSCATION])))))
        b64 = F.regexp_count(h, F.lit(BASE64_RE))
        # measure once, then derive score and details from the bound values
        # (lambda bodies get no common-subexpression elimination)
        base = F.struct(hidden.alias("hidden"), forms.alias("forms"), F.size(pixels).alias("n_pix"),
                        F.size(imgs).alias("n_img"), iframes.alias("iframes"), js.alias("js"), b64.alias("b64"))
        return let(base, _finish)

    def _finish(b):
        hidden, forms, iframes, js, b64 = b["hidden"], b["forms"], b["iframes"], b["js"], b["b64"]
        n_forms, n_pix, n_img = F.size(forms), b["n_pix"], b["n_img"]
        has_js = F.size(js) > 0

        def w(cond, v):
            return F.when(cond, v).otherwise(dbl(0.0))
        score = (dbl(0.0) + w(hidden > 0, F.least(hidden * dbl(0.05), dbl(0.20))) + w(n_forms > 0, dbl(0.30))
                 + w(n_pix > 0, dbl(0.05)) + w(iframes > 0, dbl(0.15)) + w(has_js, dbl(0.25))
                 + w(b64 > 2, dbl(0.10)))
        form_lines = F.transform(F.slice(forms, 1, 3), lambda u: F.concat(F.lit("  Form action: "), u))
        details = F.concat(
            F.array_compact(F.array(
                F.when(hidden > 0, F.concat(F.lit("Found "), hidden.cast("string"), F.lit(" hidden element(s)"))),
                F.when(n_forms > 0, F.concat(F.lit("Found "), n_forms.cast("string"),
                                             F.lit(" form(s) with external action URLs"))))),
            form_lines,
            F.array_compact(F.array(
                F.when(n_pix > 0, F.concat(F.lit("Found "), n_pix.cast("string"), F.lit(" potential tracking pixel(s)"))),
                F.when(iframes > 0, F.concat(F.lit("Found "), iframes.cast("string"), F.lit(" iframe element(s)"))),
                F.when(has_js, F.concat(F.lit("Detected obfuscated JavaScript: "), F.array_join(F.slice(js, 1, 3), ", "))),
                F.when(b64 > 2, F.concat(F.lit("Found "), b64.cast("string"), F.lit(" Base64-encoded content blocks"))),
            )),
        )
        return F.struct(
            hidden.alias("hidden_element_count"), forms.alias("external_forms"),
            n_forms.alias("external_form_count"), n_pix.alias("tracking_pixel_count"),
            n_img.alias("external_image_count"), iframes.alias("iframe_count"),
            has_js.alias("has_obfuscated_js"), js.alias("obfuscation_indicators"),
            b64.alias("base64_content_count"),
            F.round(F.least(score, dbl(1.0)), 4).alias("html_score"),
            F.when(F.size(details) > 0, details).otherwise(F.array(F.lit("No suspicious HTML elements detected")))
            .alias("html_details"),
        )

    empty = F.struct(
        F.lit(0).alias("hidden_element_count"), F.array().cast("array<string>").alias("external_forms"),
        F.lit(0).alias("external_form_count"), F.lit(0).alias("tracking_pixel_count"),
        F.lit(0).alias("external_image_count"), F.lit(0).alias("iframe_count"),
        F.lit(False).alias("has_obfuscated_js"), F.array().cast("array<string>").alias("obfuscation_indicators"),
        F.lit(0).alias("base64_content_count"), dbl(0.0).alias("html_score"),
        F.array(F.lit("No HTML content to analyze")).alias("html_details"),
    )
    # The first character that is no space ends this search; stripping would go through the whole page.
    blank = ~F.coalesce(html, F.lit("")).rlike(r"(?U)\S")
    return F.when(blank, empty).otherwise(let(html, body))
