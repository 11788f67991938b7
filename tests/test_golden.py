"""Hand-checked golden rows (FIXTURES.md §4) and the published confusion counts."""

import pytest
from pyspark.sql import functions as F

from baitscope.functions.fusion import heuristic_confidence, recommended_action, verdict
from baitscope.operators.metrics import metrics_from_counts
from baitscope.operators.scoring import score_emails

GOLDEN_HEURISTIC = [
    ((0, 0, 0.1, 0), 0.02, "legitimate", "pass"),
    ((0.35, 0, 0.1, 0), 0.1425, "legitimate", "pass"),
    ((0.2, 0.2, 0.2, 0.2), 0.2, "legitimate", "pass"),
    ((0.45, 0, 0.1, 0), 0.3495, "suspicious", "alert"),
    ((0.6, 0.5, 0.1, 0), 0.5679, "phishing", "alert"),
    ((0.8, 0.6, 0.5, 0.3), 0.9349, "phishing", "quarantine"),
    ((1, 1, 1, 1), 1.0, "phishing", "quarantine"),
]


def test_heuristic_golden(spark):
    rows = [tuple(float(x) for x in g[0]) for g in GOLDEN_HEURISTIC]
    df = spark.createDataFrame(rows, "s double, u double, h double, m double")
    raw = heuristic_confidence(F.col("s"), F.col("u"), F.col("h"), F.col("m"))
    out = df.select(F.round(raw, 4).alias("conf"), verdict(raw).alias("v")) \
        .withColumn("a", recommended_action(F.col("v"), F.col("conf"))).collect()
    for (inputs, conf, v, a), r in zip(GOLDEN_HEURISTIC, out):
        assert (r.conf, r.v, r.a) == (conf, v, a), inputs


EMAIL_SCHEMA = ("email_id long, subject string, body_text string, body_html string, from_hdr string, reply_to string, "
                "auth_results string, x_mailer string, message_id string, date_hdr string, received_hops int")
DATE = "Mon, 1 Jan 2024 00:00:00 +0000"

URL_GOLDEN = [("http://192.168.4.12/login", 0.40), ("https://bit.ly/3abc", 0.15), ("http://paypa1.com/verify", 0.40),
              ("https://my-shop.weebly.com/", 0.30), ("http://user@evil.xyz/a", 0.40)]
SEM_GOLDEN = [("act immediately", 0.2625), ("your account will be closed", 0.2975),
              ("paypal: verify now, enter your password", 0.6), ("the director of the sector", 0.0)]


@pytest.fixture(scope="module")
def golden(spark):
    """All golden inputs scored in one DataFrame (one plan, one job)."""
    rows = []
    for i, (url, _) in enumerate(URL_GOLDEN):
        rows.append((100 + i, "", f"see {url}", "", None, None, None, None, "<1@x>", DATE, 3))
    for i, (text, _) in enumerate(SEM_GOLDEN):
        rows.append((200 + i, "", text, "", None, None, None, None, "<1@x>", DATE, 3))
    rows.append((300, "", "The director of the sector met the groups first.", "", None, None, None, None, "<1@x>", DATE, 3))
    rows.append((301, "", "x", "", "PayPal Support <help@paypa1.com>", "x@evil.xyz",
                 "mx; spf=fail; dkim=none; dmarc=fail", None, "<1@x>", DATE, 3))
    rows.append((302, "", "hello", "", None, None, None, None, None, None, None))
    rows.append((303, "", "", '<div style="display:none">x</div><iframe src="http://a.example/f"></iframe>',
                 None, None, None, None, "<1@x>", DATE, 3))
    df = spark.createDataFrame(rows, EMAIL_SCHEMA)
    return {r.email_id: r for r in score_emails(df).collect()}


def test_url_risk_golden(golden):
    for i, (url, risk) in enumerate(URL_GOLDEN):
        r = golden[100 + i].urls
        assert len(r) == 1 and abs(r[0].risk_score - risk) < 1e-9, url


def test_typosquat_score(golden):
    r = golden[102].urls[0]
    assert r.typosquatting_target == "paypal" and round(r.typosquatting_score, 4) == 0.8333


def test_semantic_golden(golden):
    for i, (text, combined) in enumerate(SEM_GOLDEN):
        assert golden[200 + i].semantic_score == combined, text


def test_acronym_trap(golden):
    r = golden[300]
    assert r.authority_matches == [] and "ups" in r.brand_mentions and "irs" in r.brand_mentions


def test_header_golden(golden):
    r = golden[301]
    assert r.header_score == 0.9 and r.display_name_mismatch and r.reply_to_mismatch


def test_text_only_headers(golden):
    r = golden[302]
    assert r.header_score == 0.1 and r.header_details == ["No email headers available (text-only input)"]


def test_html_golden(golden):
    r = golden[303]
    assert r.html_score == 0.2 and r.hidden_element_count == 1 and r.iframe_count == 1


def test_scores_bounded(spark):
    from baitscope.sources.fixtures import emails
    s = score_emails(emails(spark, "/root/testdata/sf0.001"))
    bad = s.filter(~F.col("confidence").between(0, 1) | ~F.col("semantic_score").between(0, 1)
                   | ~F.col("url_score").between(0, 1) | ~F.col("header_score").between(0, 1)
                   | ~F.col("html_score").between(0, 1)).count()
    assert bad == 0


def test_heuristic_monotone(spark):
    import itertools
    grid = [0.0, 0.1, 0.25, 0.45, 0.7, 1.0]
    rows = list(itertools.product(grid, repeat=4))
    df = spark.createDataFrame(rows, "s double, u double, h double, m double")
    def conf(s, u, h, m):
        return heuristic_confidence(F.col(s), F.col(u), F.col(h), F.col(m))
    base = df.select("*", conf("s", "u", "h", "m").alias("c0"))
    bumped = base.withColumn("s2", F.least(F.col("s") + 0.05, F.lit(1.0))) \
        .select("c0", heuristic_confidence(F.col("s2"), F.col("u"), F.col("h"), F.col("m")).alias("c1"))
    assert bumped.filter(F.col("c1") < F.col("c0") - 1e-12).count() == 0


def test_published_confusion_counts(spark):
    cm = spark.createDataFrame([(241, 226, 24, 9)], "tp long, tn long, fp long, fn long")
    m = metrics_from_counts(cm).first()
    assert m.accuracy == 0.934
    assert m.fpr == 0.096 and m.fnr == 0.036
    assert m.cohen_kappa == 0.868
    assert m.macro_f1 == 0.9339 and m.weighted_f1 == 0.9339
    assert (m.phishing_precision, m.phishing_recall, m.phishing_f1) == (0.9094, 0.964, 0.9359)
    assert (m.legit_precision, m.legit_recall, m.legit_f1) == (0.9617, 0.904, 0.932)
    assert (m.macro_precision, m.macro_recall) == (0.9356, 0.934)


def test_nfkc(spark):
    from baitscope.functions.text import nfkc
    df = spark.createDataFrame([("раypal",), ("ｐaypal",), (None,)], "t string")
    out = [r[0] for r in df.select(nfkc("t")).collect()]
    assert out[0] == "раypal" and out[1] == "paypal" and out[2] is None


def test_strict_brand_option(spark):
    rows = [(1, "", "x", "", "Best Deals <a@shop.example>", None, None, None, "<1@x>", DATE, 3)]
    df = spark.createDataFrame(rows, EMAIL_SCHEMA)
    loose = score_emails(df).first()
    strict = score_emails(df, strict_brands=True).first()
    assert loose.brand_mismatch_keyword == "best" and strict.brand_mismatch_keyword is None


def test_phrase_pass_equals_substring_tests():
    """The automaton finds what testing every phrase alone finds, overlaps and shared phrases included."""
    import random

    from baitscope.functions.phrases import LISTS, substrings
    rng = random.Random(1)
    words = [w for _, ps in LISTS for p in ps for w in p.split()]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 60))) for _ in range(300)] + ["", None, "groups first irs irs1", "étéverify now日本"]
    got = substrings(texts)
    for (_, phrases), column in zip(LISTS, got, strict=True):
        assert column == [[p for p in phrases if p in (t or "")] for t in texts]
