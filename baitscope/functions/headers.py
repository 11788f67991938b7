"""Header analysis as column expressions (PRJ-10..12, HDR-01 .. HDR-10)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from baitscope.functions.core import at, blank_to_null, dbl, let, lit_array
from baitscope.resources import lexicons as L
from baitscope.resources.brands import brand_keywords

_ANGLE_RE = r"<([^>]+)>"
_BARE_RE = r"(?U)[\w.+-]+@[\w.-]+\.\w+"


def email_address(value: Column) -> Column:
    """PRJ-10: address inside <...>, else the first bare address; lower case."""
    angle = F.regexp_extract(value, _ANGLE_RE, 1)
    bare = F.regexp_extract(value, _BARE_RE, 0)
    return F.lower(F.when(angle != "", angle).when(bare != "", bare))


def email_domain(addr: Column) -> Column:
    """PRJ-11: text after the first '@', lower case; NULL without '@'."""
    return F.when(addr.contains("@"), F.lower(F.regexp_extract(addr, r"(?s)^[^@]*@(.*)$", 1)))


def auth_result(auth: Column, protocol: str) -> Column:
    """PRJ-12: spf/dkim/dmarc result from Authentication-Results, else 'none'."""
    raw = F.lower(F.regexp_extract(auth, rf"(?i){protocol}\s*=\s*(\w+)", 1))
    return F.when(raw.isin(L.AUTH_RESULTS), raw).otherwise(F.lit("none"))


def _keyword_table() -> Column:
    """Brand keyword dimension as an array literal of (keyword, domains)."""
    rows = brand_keywords()
    return F.array(*[F.struct(F.lit(kw).alias("kw"), lit_array(doms).alias("domains")) for _, kw, doms in rows])


def brand_mismatch(from_hdr: Column, from_domain: Column, strict: bool = False) -> Column:
    """HDR-03: first brand keyword in the From header whose domains the sender
    domain does not end with; the four generic keywords are skipped."""
    lower_from = F.lower(from_hdr)
    dom = F.coalesce(from_domain, F.lit(""))
    skip = list(L.GENERIC_BRAND_WORDS)
    if strict:
        skip += ["one", "app", "best", "home"]
    hits = F.filter(_keyword_table(), lambda k: lower_from.contains(k["kw"])
                    & ~F.exists(k["domains"], lambda d: dom.endswith(d))
                    & ~k["kw"].isin(skip))
    return at(hits, 1)


def header_columns(from_hdr: Column, reply_to: Column, auth: Column, x_mailer: Column,
                   message_id: Column, date_hdr: Column, hops: Column,
                   relax_received: bool = False, strict_brands: bool = False) -> Column:
    """HDR-01 .. HDR-10 as one struct.  A row whose ``hops`` is NULL has no
    header block at all (text input) and takes the HDR-09 defaults."""
    def body(h):
        spf, dkim, dmarc = h["spf"], h["dkim"], h["dmarc"]
        mm = h["mismatch"]
        reply_mismatch = (h["reply_domain"].isNotNull() & h["from_domain"].isNotNull()
                          & (h["reply_domain"] != h["from_domain"]))
        mailer_susp = F.coalesce(F.exists(lit_array(L.SUSPICIOUS_MAILERS),
                                          lambda s: F.lower(h["x_mailer"]).contains(s)), F.lit(False))
        missing_id = h["message_id"].isNull()
        missing_date = h["date"].isNull()
        n = h["hops"]
        chain = (n > 8) | ((n == 0) & F.lit(not relax_received))
        display_mismatch = mm.isNotNull()

        def w(cond, weight):
            return F.when(cond, dbl(weight)).otherwise(dbl(0.0))
        score = (dbl(0.0)
                 + F.when(spf == "fail", dbl(0.20)).when(spf == "softfail", dbl(0.10))
                 .when(spf == "none", dbl(0.05)).otherwise(dbl(0.0))
                 + F.when(dkim == "fail", dbl(0.20)).when(dkim == "none", dbl(0.05)).otherwise(dbl(0.0))
                 + F.when(dmarc == "fail", dbl(0.15)).when(dmarc == "none", dbl(0.05)).otherwise(dbl(0.0))
                 + w(reply_mismatch, 0.20) + w(display_mismatch, 0.30) + w(mailer_susp, 0.05)
                 + w(missing_id, 0.05) + w(missing_date, 0.05) + w(chain, 0.10))
        fd = F.coalesce(h["from_domain"], F.lit(""))
        details = F.array_compact(F.array(
            F.when(display_mismatch, F.concat(F.lit("Display name contains '"), mm["kw"],
                                              F.lit("' but sender domain '"), fd,
                                              F.lit("' is not an official domain"))),
            F.when(reply_mismatch, F.concat(F.lit("Reply-To domain ("), h["reply_domain"],
                                            F.lit(") differs from From domain ("), h["from_domain"], F.lit(")"))),
            F.when(mailer_susp, F.concat(F.lit("Suspicious X-Mailer: "), h["x_mailer"])),
            F.when(missing_id, F.lit("Missing Message-ID header")),
            F.when(missing_date, F.lit("Missing Date header")),
            F.when(n > 8, F.concat(F.lit("Unusually long Received chain ("), n.cast("string"), F.lit(" hops)")))
            .when((n == 0) & F.lit(relax_received), F.lit("No Received headers (suppressed in test mode)"))
            .when(n == 0, F.lit("No Received headers found (possibly forged)")),
            F.when(spf == "fail", F.lit("SPF check failed")).when(spf == "softfail", F.lit("SPF softfail")),
            F.when(dkim == "fail", F.lit("DKIM check failed")),
            F.when(dmarc == "fail", F.lit("DMARC check failed")),
        ))
        return F.struct(
            spf.alias("spf_result"), dkim.alias("dkim_result"), dmarc.alias("dmarc_result"),
            h["from"].alias("from_display_name"), h["from_email"].alias("from_email"),
            h["from_domain"].alias("from_domain"), h["reply_email"].alias("reply_to_email"),
            reply_mismatch.alias("reply_to_mismatch"), display_mismatch.alias("display_name_mismatch"),
            mm["kw"].alias("brand_mismatch_keyword"),
            F.slice(mm["domains"], 1, 3).alias("brand_legitimate_domains"),
            h["x_mailer"].alias("x_mailer"), mailer_susp.alias("x_mailer_suspicious"),
            missing_id.alias("missing_message_id"), missing_date.alias("missing_date"),
            chain.alias("suspicious_received_chain"), n.alias("received_hop_count"),
            F.round(F.least(score, dbl(1.0)), 4).alias("header_score"),
            F.when(F.size(details) > 0, details).otherwise(F.array(F.lit("No header anomalies detected")))
            .alias("header_details"),
        )

    def parsed():
        frm = blank_to_null(from_hdr)
        from_email = email_address(frm)
        from_domain = email_domain(from_email)
        reply = blank_to_null(reply_to)
        reply_email = email_address(reply)
        auth_v = blank_to_null(auth)
        return F.struct(
            frm.alias("from"), from_email.alias("from_email"), from_domain.alias("from_domain"),
            reply_email.alias("reply_email"), email_domain(reply_email).alias("reply_domain"),
            F.when(auth_v.isNull(), F.lit("none")).otherwise(auth_result(auth_v, "spf")).alias("spf"),
            F.when(auth_v.isNull(), F.lit("none")).otherwise(auth_result(auth_v, "dkim")).alias("dkim"),
            F.when(auth_v.isNull(), F.lit("none")).otherwise(auth_result(auth_v, "dmarc")).alias("dmarc"),
            blank_to_null(x_mailer).alias("x_mailer"),
            blank_to_null(message_id).alias("message_id"),
            blank_to_null(date_hdr).alias("date"),
            hops.alias("hops"),
            F.when(frm.isNotNull(), brand_mismatch(frm, from_domain, strict_brands)).alias("mismatch"),
        )

    present = let(parsed(), body)
    return F.when(hops.isNull(), text_only_headers()).otherwise(present)


def text_only_headers() -> Column:
    """HDR-09: defaults for input without headers."""
    return F.struct(
        F.lit("none").alias("spf_result"), F.lit("none").alias("dkim_result"), F.lit("none").alias("dmarc_result"),
        F.lit(None).cast("string").alias("from_display_name"), F.lit(None).cast("string").alias("from_email"),
        F.lit(None).cast("string").alias("from_domain"), F.lit(None).cast("string").alias("reply_to_email"),
        F.lit(False).alias("reply_to_mismatch"), F.lit(False).alias("display_name_mismatch"),
        F.lit(None).cast("string").alias("brand_mismatch_keyword"),
        F.lit(None).cast("array<string>").alias("brand_legitimate_domains"),
        F.lit(None).cast("string").alias("x_mailer"), F.lit(False).alias("x_mailer_suspicious"),
        F.lit(True).alias("missing_message_id"), F.lit(True).alias("missing_date"),
        F.lit(False).alias("suspicious_received_chain"), F.lit(0).alias("received_hop_count"),
        dbl(0.1).alias("header_score"),
        F.array(F.lit("No email headers available (text-only input)")).alias("header_details"),
    )
