"""DuckDB twins of the registered queries (the correctness gate).

Written independently of the Spark code, in plain SQL over the driver's
pre-registered views.  URL analysis here unnests one row per URL and groups
back by email, the way a SQL user would write it; the Spark side keeps the
URLs in an array column.  Numeric literals carry ``::DOUBLE`` so DuckDB does
double (not decimal) arithmetic, like Spark and Python.
"""

from __future__ import annotations

import re

from baitscope.resources import lexicons as L
from baitscope.resources.brands import brand_keywords
from baitscope.sources import fixtures as FX


def q(s: str | None) -> str:
    if s is None:
        return "NULL"
    return "'" + s.replace("'", "''") + "'"


def D(x) -> str:
    return f"{float(x)!r}::DOUBLE"


def lst(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def pick(values, key: str) -> str:
    parts = " ".join(f"WHEN {i} THEN {q(v)}" for i, v in enumerate(values))
    return f"(CASE ({key}) % {len(values)} {parts} END)"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def blank_null(x: str) -> str:
    return f"nullif({strip(x)}, '')"


EMAILS = f"""
np AS (SELECT max(page_id) + 1 AS n FROM pages),
emails AS (
  SELECT d.doc_id AS email_id,
    {pick(FX.SUBJECTS, 'd.doc_id')} AS subject,
    coalesce(d.text, '') || ' ' || {pick(FX.TAILS, 'd.doc_id')} AS body_text,
    CASE WHEN d.doc_id % 9 <= 5 THEN coalesce(p.html, '') || {pick(FX.INJECTIONS, 'd.doc_id % 9')}
         WHEN d.doc_id % 9 = 6 THEN coalesce(p.html, '') ELSE '' END AS body_html,
    {pick(FX.FROM_HEADERS, 'd.doc_id')} AS from_hdr,
    {pick(FX.REPLY_TO, 'd.doc_id')} AS reply_to,
    {pick(FX.AUTH, 'd.doc_id')} AS auth_results,
    {pick(FX.MAILERS, 'd.doc_id')} AS x_mailer,
    CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE '<' || CAST(d.doc_id AS VARCHAR) || '@mail>' END AS message_id,
    CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE {q(FX.DATE_VALUE)} END AS date_hdr,
    CAST(d.doc_id % 11 AS INTEGER) AS received_hops,
    CAST(CASE WHEN (d.doc_id % 12 IN ({', '.join(map(str, FX.PHISH_TAILS))})) <> (d.doc_id % 17 = 0)
              THEN 1 ELSE 0 END AS INTEGER) AS label,
    d.source
  FROM documents d CROSS JOIN np LEFT JOIN pages p ON p.page_id = d.doc_id % np.n
)"""


def _phrase_filter(phrases) -> str:
    short = [p for p in phrases if L.is_whole_word(p)]
    if short:
        whens = " ".join(f"WHEN p = {q(s)} THEN regexp_matches(lt, {q(chr(92) + 'b' + re.escape(s) + chr(92) + 'b')})"
                         for s in short)
        test = f"CASE {whens} ELSE contains(lt, p) END"
    else:
        test = "contains(lt, p)"
    return f"list_filter({lst(phrases)}, lambda p: {test})"


def _score(n: str) -> str:
    return (f"round(CASE WHEN {n} = 0 THEN {D(0)} WHEN {n} = 1 THEN {D(0.35)} WHEN {n} = 2 THEN {D(0.6)} "
            f"WHEN {n} = 3 THEN {D(0.8)} ELSE least({D(0.9)} + ({n} - 4) * {D(0.03)}, {D(1)}) END, 4)")


_CATS = [n for n, _ in L.CATEGORIES]

SEMANTIC = f"""
sem0 AS (SELECT *, {strip("coalesce(subject, '') || ' ' || coalesce(body_text, '')")} AS atext FROM emails),
sem1 AS (SELECT *, lower(atext) AS lt FROM sem0),
sem2 AS (
  SELECT *,
    {', '.join(f"{_phrase_filter(ph)} AS {n}_matches" for n, ph in L.CATEGORIES)},
    list_filter({lst(L.BODY_BRANDS)}, lambda b: contains(lt, b)) AS brand_mentions,
    list_filter({lst(L.MISSPELLINGS)}, lambda m: contains(lt, m)) AS missp,
    list_filter(string_split_regex(atext, '\\s+'), lambda w: w <> '') AS words
  FROM sem1),
sem3 AS (
  SELECT *,
    {', '.join(f"len({n}_matches) AS {n}_count, {_score(f'len({n}_matches)')} AS {n}_score" for n in _CATS)},
    list_filter([
      CASE WHEN len(words) > 0 AND len(list_filter(words, lambda w: upper(w) = w AND lower(w) <> w AND length(w) > 1)) / len(words) > 0.3
           THEN 'Excessive capitalization' END,
      CASE WHEN contains(atext, '!!!') OR contains(atext, '???') THEN 'Excessive punctuation' END,
      CASE WHEN len(missp) > 0 THEN 'Suspicious misspellings: ' || array_to_string(missp, ', ') END
    ], lambda x: x IS NOT NULL) AS grammar_issues
  FROM sem2),
sem4 AS (
  SELECT *, round(least(len(grammar_issues) / {D(3)}, {D(1)}), 4) AS grammar_score,
    list_reverse_sort([urgency_score, authority_score, pressure_score, credential_requests_score, reward_lures_score]) AS top
  FROM sem3),
sem5 AS (
  SELECT *,
    urgency_score * {D(0.2)} + authority_score * {D(0.15)} + pressure_score * {D(0.15)}
      + generic_greetings_score * {D(0.1)} + reward_lures_score * {D(0.1)}
      + credential_requests_score * {D(0.2)} + grammar_score * {D(0.1)} AS w0
  FROM sem4),
sem6 AS (SELECT *, CASE WHEN top[1] >= 0.35 THEN greatest(w0, top[1] * {D(0.75)}) ELSE w0 END AS w1 FROM sem5),
sem7 AS (SELECT *, CASE WHEN len(list_filter(top, lambda s: s >= 0.3)) >= 2
                        THEN greatest(w1, (top[1] + top[2]) / {D(2)} * {D(0.85)}) ELSE w1 END AS w2 FROM sem6),
sem8 AS (SELECT *,
  CASE WHEN len(brand_mentions) > 0 AND (urgency_count > 0 OR credential_requests_count > 0)
       THEN greatest(w2, {D(0.45)}) ELSE w2 END AS w3 FROM sem7),
sem AS (SELECT *,
  round(least(CASE WHEN len(brand_mentions) > 0 AND urgency_count > 0 AND credential_requests_count > 0
                   THEN greatest(w3, {D(0.6)}) ELSE w3 END, {D(1)}), 4) AS semantic_score FROM sem8)"""

URL_RE = r"""https?://[^\s<>"')\]]+|www\.[^\s<>"')\]]+"""
HREF_RE = r"""href\s*=\s*["']([^"']+)["']"""


def _typo_brand_lit() -> str:
    return lst(L.TYPOSQUAT_BRANDS)


URLS = f"""
u0 AS (
  SELECT email_id,
    list_transform(regexp_extract_all(coalesce(body_text, ''), {q(URL_RE)}, 0, 'i'),
      lambda u: CASE WHEN starts_with(rtrim(u, '.,;:!?)'), 'http') THEN rtrim(u, '.,;:!?)')
                     ELSE 'http://' || rtrim(u, '.,;:!?)') END) AS t_urls,
    list_transform(list_filter(regexp_extract_all(coalesce(body_html, ''), {q(HREF_RE)}, 1, 'i'),
        lambda h: starts_with(h, 'http://') OR starts_with(h, 'https://') OR starts_with(h, 'www.')),
      lambda h: CASE WHEN starts_with(h, 'http') THEN h ELSE 'http://' || h END) AS h_urls
  FROM emails),
u1 AS (SELECT DISTINCT email_id, unnest(list_concat(t_urls, h_urls)) AS url FROM u0),
u2 AS (SELECT *, coalesce(try(url_decode(url)), url) AS dec FROM u1),
u3 AS (SELECT *,
    lower(regexp_replace(regexp_replace(regexp_extract(dec, '^[A-Za-z][A-Za-z0-9+.\\-]*://([^/?#]*)', 1), '^.*@', ''), ':.*$', '')) AS host,
    lower(regexp_extract(dec, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1)) AS path,
    lower(regexp_extract(dec, '^([A-Za-z][A-Za-z0-9+.\\-]*):', 1)) AS scheme,
    regexp_replace(regexp_replace(dec, '^.*?//', ''), '/.*$', '') AS authority
  FROM u2),
u4 AS (SELECT *, string_split(host, '.') AS parts FROM u3),
u5 AS (SELECT *,
    CASE WHEN len(parts) >= 3 THEN array_to_string(parts[1:len(parts) - 2], '.') ELSE '' END AS subdomain,
    CASE WHEN len(parts) >= 3 THEN parts[len(parts) - 1] WHEN len(parts) = 2 THEN parts[1] ELSE host END AS domain,
    CASE WHEN len(parts) >= 2 THEN parts[len(parts)] ELSE '' END AS suffix,
    CASE WHEN len(parts) >= 3 THEN parts[len(parts) - 1] || '.' || parts[len(parts)] ELSE host END AS registered
  FROM u4),
u6 AS (SELECT *, list_transform({_typo_brand_lit()}, lambda b: levenshtein(lower(domain), b)) AS dists FROM u5),
u7 AS (SELECT *, list_min(dists) AS dmin, {_typo_brand_lit()}[list_position(dists, list_min(dists))] AS dbrand FROM u6),
u8 AS (SELECT *,
    regexp_matches(host, '^\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}$') AS is_ip_based,
    lower(registered) IN ({', '.join(q(x) for x in L.URL_SHORTENERS)}) AS uses_shortener,
    list_filter({lst(L.free_hosting_priority())}, lambda fh: ends_with(host, fh) OR lower(registered) = fh)[1] AS free_hosting_platform,
    lower(suffix) IN ({', '.join(q(x) for x in L.SUSPICIOUS_TLDS)}) AS suspicious_tld,
    length(host) > 30 AS long_domain,
    contains(authority, '@') AS has_at_symbol,
    (CASE WHEN subdomain <> '' THEN len(string_split(subdomain, '.')) ELSE 0 END) > 3 AS excessive_subdomains,
    length(domain) - length(replace(domain, '-', '')) > 2 AS excessive_hyphens,
    scheme = 'https' AS uses_https,
    CASE WHEN dmin > 0 AND dmin <= 2 THEN {D(1)} - dmin / greatest(length(lower(domain)), length(dbrand)) ELSE {D(0)} END AS typosquatting_score,
    CASE WHEN dmin > 0 AND dmin <= 2 THEN dbrand END AS typosquatting_target,
    list_sort(list_filter({lst(L.PATH_KEYWORDS)}, lambda k: contains(path, k))) AS path_kws
  FROM u7),
u9 AS (SELECT *, free_hosting_platform IS NOT NULL AS uses_free_hosting, len(path_kws) > 0 AS suspicious_path FROM u8),
url_rows AS (SELECT *,
    least({D(0)}
      + CASE WHEN is_ip_based THEN {D(0.25)} ELSE {D(0)} END + CASE WHEN uses_shortener THEN {D(0.15)} ELSE {D(0)} END
      + CASE WHEN suspicious_tld THEN {D(0.15)} ELSE {D(0)} END + CASE WHEN long_domain THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN has_at_symbol THEN {D(0.2)} ELSE {D(0)} END + CASE WHEN excessive_subdomains THEN {D(0.1)} ELSE {D(0)} END
      + CASE WHEN excessive_hyphens THEN {D(0.05)} ELSE {D(0)} END + CASE WHEN NOT uses_https THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN typosquatting_score > 0.5 THEN {D(0.25)} ELSE {D(0)} END + CASE WHEN suspicious_path THEN {D(0.1)} ELSE {D(0)} END
      + CASE WHEN uses_free_hosting THEN {D(0.3)} ELSE {D(0)} END, {D(1)}) AS risk_score,
    list_filter([
      CASE WHEN is_ip_based THEN 'IP-based URL' END,
      CASE WHEN uses_shortener THEN 'URL shortener' END,
      CASE WHEN suspicious_tld THEN 'Suspicious TLD' END,
      CASE WHEN typosquatting_score > 0.5 THEN 'Possible typosquatting of ''' || typosquatting_target || '''' END,
      CASE WHEN has_at_symbol THEN 'Contains @ symbol' END,
      CASE WHEN suspicious_path THEN 'Suspicious path keywords: ' || array_to_string(path_kws, ', ') END,
      CASE WHEN uses_free_hosting THEN 'Free hosting platform (' || free_hosting_platform || ')' END,
      CASE WHEN NOT uses_https THEN 'No HTTPS' END], lambda x: x IS NOT NULL) AS flags
  FROM u9),
url_agg AS (
  SELECT email_id, count(*) AS url_count, max(risk_score) AS max_risk, sum(risk_score) AS sum_risk,
    round({D(0.7)} * max(risk_score) + {D(0.3)} * (sum(risk_score) / count(*)), 4) AS url_score,
    string_agg(CASE WHEN len(flags) > 0 THEN url || ': ' || array_to_string(flags, '; ') END, ' | ' ORDER BY url) AS url_lines,
    count(*) FILTER (WHERE is_ip_based) AS n_ip, count(*) FILTER (WHERE uses_shortener) AS n_short,
    count(*) FILTER (WHERE suspicious_tld) AS n_tld, count(*) FILTER (WHERE long_domain) AS n_long,
    count(*) FILTER (WHERE has_at_symbol) AS n_at, count(*) FILTER (WHERE excessive_subdomains) AS n_sub,
    count(*) FILTER (WHERE excessive_hyphens) AS n_hyph, count(*) FILTER (WHERE NOT uses_https) AS n_nohttps,
    max(typosquatting_score) AS max_typo, count(*) FILTER (WHERE suspicious_path) AS n_path,
    count(*) FILTER (WHERE uses_free_hosting) AS n_free,
    min(CASE WHEN typosquatting_score > 0.5 THEN url END) AS first_typo_url
  FROM url_rows GROUP BY email_id),
urlx AS (
  SELECT e.email_id, coalesce(a.url_count, 0) AS url_count, coalesce(a.url_score, {D(0)}) AS url_score,
    CASE WHEN a.url_count IS NULL THEN 'No URLs found in email content'
         WHEN a.url_lines IS NULL THEN 'No suspicious URL indicators found' ELSE a.url_lines END AS url_details,
    a.* EXCLUDE (email_id, url_count, url_score, url_lines)
  FROM emails e LEFT JOIN url_agg a USING (email_id))"""


def _kw_table_sql() -> str:
    rows = brand_keywords()
    return "[" + ", ".join(f"{{'ord': {i}, 'kw': {q(kw)}, 'domains': {lst(doms)}}}" for i, kw, doms in rows) + "]"


def _addr(x: str) -> str:
    return (f"lower(CASE WHEN regexp_extract({x}, '<([^>]+)>', 1) <> '' THEN regexp_extract({x}, '<([^>]+)>', 1) "
            f"WHEN regexp_extract({x}, '[\\w.+-]+@[\\w.-]+\\.\\w+', 0) <> '' THEN regexp_extract({x}, '[\\w.+-]+@[\\w.-]+\\.\\w+', 0) END)")


def _dom(x: str) -> str:
    return f"CASE WHEN contains({x}, '@') THEN lower(substr({x}, position('@' IN {x}) + 1)) END"


def _auth(proto: str) -> str:
    raw = f"lower(regexp_extract(av, '{proto}\\s*=\\s*(\\w+)', 1, 'i'))"
    return (f"CASE WHEN av IS NULL THEN 'none' WHEN {raw} IN ({', '.join(q(x) for x in L.AUTH_RESULTS)}) "
            f"THEN {raw} ELSE 'none' END")


HEADERS = f"""
h0 AS (SELECT email_id, {blank_null('from_hdr')} AS frm, {blank_null('reply_to')} AS rpl, {blank_null('auth_results')} AS av,
    {blank_null('x_mailer')} AS xm, {blank_null('message_id')} AS mid, {blank_null('date_hdr')} AS dt, received_hops AS n, received_hops
  FROM emails),
h1 AS (SELECT *, {_addr('frm')} AS from_email, {_addr('rpl')} AS reply_to_email FROM h0),
h2 AS (SELECT *, {_dom('from_email')} AS from_domain, {_dom('reply_to_email')} AS reply_domain,
    {_auth('spf')} AS spf_result, {_auth('dkim')} AS dkim_result, {_auth('dmarc')} AS dmarc_result FROM h1),
h3 AS (SELECT *,
    CASE WHEN frm IS NOT NULL THEN list_filter({_kw_table_sql()}, lambda k: contains(lower(frm), k.kw)
         AND NOT list_bool_or(list_transform(k.domains, lambda d: ends_with(coalesce(from_domain, ''), d)))
         AND k.kw NOT IN ({', '.join(q(x) for x in L.GENERIC_BRAND_WORDS)}))[1] END AS mm
  FROM h2),
h4 AS (SELECT *,
    mm IS NOT NULL AS display_name_mismatch,
    coalesce(reply_domain IS NOT NULL AND from_domain IS NOT NULL AND reply_domain <> from_domain, false) AS reply_to_mismatch,
    coalesce(list_bool_or(list_transform({lst(L.SUSPICIOUS_MAILERS)}, lambda s: contains(lower(xm), s))), false) AS x_mailer_suspicious,
    mid IS NULL AS missing_message_id, dt IS NULL AS missing_date,
    (n > 8 OR n = 0) AS suspicious_received_chain
  FROM h3),
hdr AS (SELECT *,
    round(least({D(0)}
      + CASE WHEN spf_result = 'fail' THEN {D(0.2)} WHEN spf_result = 'softfail' THEN {D(0.1)} WHEN spf_result = 'none' THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN dkim_result = 'fail' THEN {D(0.2)} WHEN dkim_result = 'none' THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN dmarc_result = 'fail' THEN {D(0.15)} WHEN dmarc_result = 'none' THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN reply_to_mismatch THEN {D(0.2)} ELSE {D(0)} END + CASE WHEN display_name_mismatch THEN {D(0.3)} ELSE {D(0)} END
      + CASE WHEN x_mailer_suspicious THEN {D(0.05)} ELSE {D(0)} END + CASE WHEN missing_message_id THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN missing_date THEN {D(0.05)} ELSE {D(0)} END + CASE WHEN suspicious_received_chain THEN {D(0.1)} ELSE {D(0)} END,
      {D(1)}), 4) AS header_score,
    list_filter([
      CASE WHEN display_name_mismatch THEN 'Display name contains ''' || mm.kw || ''' but sender domain ''' || coalesce(from_domain, '') || ''' is not an official domain' END,
      CASE WHEN reply_to_mismatch THEN 'Reply-To domain (' || reply_domain || ') differs from From domain (' || from_domain || ')' END,
      CASE WHEN x_mailer_suspicious THEN 'Suspicious X-Mailer: ' || xm END,
      CASE WHEN missing_message_id THEN 'Missing Message-ID header' END,
      CASE WHEN missing_date THEN 'Missing Date header' END,
      CASE WHEN n > 8 THEN 'Unusually long Received chain (' || CAST(n AS VARCHAR) || ' hops)'
           WHEN n = 0 THEN 'No Received headers found (possibly forged)' END,
      CASE WHEN spf_result = 'fail' THEN 'SPF check failed' WHEN spf_result = 'softfail' THEN 'SPF softfail' END,
      CASE WHEN dkim_result = 'fail' THEN 'DKIM check failed' END,
      CASE WHEN dmarc_result = 'fail' THEN 'DMARC check failed' END], lambda x: x IS NOT NULL) AS hdl
  FROM h4)"""

_HIDDEN_DUCK = [
    r"(?i)display\s*:\s*none", r"(?i)visibility\s*:\s*hidden", r"(?i)opacity\s*:\s*0[^.]",
    r"(?i)height\s*:\s*0", r"(?i)width\s*:\s*0", r"(?i)font-size\s*:\s*0",
    r"(?is)position\s*:\s*absolute.*left\s*:\s*-\d{4,}",
]
_JS_DUCK = [
    ("eval(", r"(?i)eval\s*\("), (r"document\.write(", r"(?i)document\.write\s*\("),
    ("unescape(", r"(?i)unescape\s*\("), ("fromCharCode", r"(?i)fromCharCode"),
    (r"\\x[0-9a-fA-F]{2}", r"(?i)\\x[0-9a-fA-F]{2}"), (r"\\u[0-9a-fA-F]{4}", r"(?i)\\u[0-9a-fA-F]{4}"),
    ("atob(", r"(?i)atob\s*\("),
]
FORM_RE = r"""(?i)<form[^>]*action\s*=\s*["']([^"']+)["']"""
IMG_RE = r"""(?i)<img[^>]*src\s*=\s*["']([^"']+)["']"""


HTML = f"""
m0 AS (SELECT email_id, body_html AS h, {strip("coalesce(body_html, '')")} = '' AS blank FROM emails),
m1 AS (SELECT *,
    {' + '.join(f"len(regexp_extract_all(h, {q(p)}))" for p in _HIDDEN_DUCK)} AS hidden_element_count,
    list_filter(regexp_extract_all(h, {q(FORM_RE)}, 1), lambda a: starts_with(a, 'http://') OR starts_with(a, 'https://')) AS forms,
    list_filter(list_transform(regexp_extract_all(h, {q(IMG_RE)}, 0), lambda t: {{'tag': t, 'src': regexp_extract(t, {q(IMG_RE)}, 1)}}),
      lambda x: starts_with(x.src, 'http://') OR starts_with(x.src, 'https://')) AS imgs,
    len(regexp_extract_all(h, '(?i)<iframe')) AS iframe_count,
    regexp_extract_all(h, '(?is)<script[^>]*>(.*?)</script>', 1) AS scripts,
    len(regexp_extract_all(h, {q(r"(?i)(?:data:[^;]+;base64,|[A-Za-z0-9+/]{50,}={0,2})")})) AS base64_content_count
  FROM m0),
m2 AS (SELECT *, len(forms) AS external_form_count, len(imgs) AS external_image_count,
    len(list_filter(imgs, lambda x: contains(lower(x.tag), 'width="1"') OR contains(lower(x.tag), 'height="1"')
      OR contains(lower(x.tag), 'width="0"') OR contains(lower(x.tag), 'height="0"') OR contains(lower(x.src), '1x1'))) AS tracking_pixel_count,
    list_filter(js_all, lambda x, i: list_position(js_all, x) = i) AS js
  FROM (SELECT *, flatten(list_transform(scripts, lambda s: list_filter([
      {', '.join(f"CASE WHEN regexp_matches(s, {q(p)}) THEN {q(n)} END" for n, p in _JS_DUCK)}], lambda x: x IS NOT NULL))) AS js_all FROM m1) z),
html AS (SELECT email_id,
    CASE WHEN blank THEN 0 ELSE hidden_element_count END AS hidden_element_count,
    CASE WHEN blank THEN 0 ELSE external_form_count END AS external_form_count,
    CASE WHEN blank THEN 0 ELSE tracking_pixel_count END AS tracking_pixel_count,
    CASE WHEN blank THEN 0 ELSE external_image_count END AS external_image_count,
    CASE WHEN blank THEN 0 ELSE iframe_count END AS iframe_count,
    CASE WHEN blank THEN false ELSE coalesce(len(js), 0) > 0 END AS has_obfuscated_js,
    CASE WHEN blank THEN 0 ELSE base64_content_count END AS base64_content_count,
    CASE WHEN blank THEN {D(0)} ELSE round(least({D(0)}
      + CASE WHEN hidden_element_count > 0 THEN least(hidden_element_count * {D(0.05)}, {D(0.2)}) ELSE {D(0)} END
      + CASE WHEN external_form_count > 0 THEN {D(0.3)} ELSE {D(0)} END
      + CASE WHEN tracking_pixel_count > 0 THEN {D(0.05)} ELSE {D(0)} END
      + CASE WHEN iframe_count > 0 THEN {D(0.15)} ELSE {D(0)} END
      + CASE WHEN coalesce(len(js), 0) > 0 THEN {D(0.25)} ELSE {D(0)} END
      + CASE WHEN base64_content_count > 2 THEN {D(0.1)} ELSE {D(0)} END, {D(1)}), 4) END AS html_score,
    CASE WHEN blank THEN 'No HTML content to analyze' ELSE coalesce(nullif(array_to_string(list_concat(
      list_filter([CASE WHEN hidden_element_count > 0 THEN 'Found ' || hidden_element_count || ' hidden element(s)' END,
                   CASE WHEN external_form_count > 0 THEN 'Found ' || external_form_count || ' form(s) with external action URLs' END],
                  lambda x: x IS NOT NULL),
      list_transform(forms[1:3], lambda f: '  Form action: ' || f),
      list_filter([CASE WHEN tracking_pixel_count > 0 THEN 'Found ' || tracking_pixel_count || ' potential tracking pixel(s)' END,
                   CASE WHEN iframe_count > 0 THEN 'Found ' || iframe_count || ' iframe element(s)' END,
                   CASE WHEN coalesce(len(js), 0) > 0 THEN 'Detected obfuscated JavaScript: ' || array_to_string(js[1:3], ', ') END,
                   CASE WHEN base64_content_count > 2 THEN 'Found ' || base64_content_count || ' Base64-encoded content blocks' END],
                  lambda x: x IS NOT NULL)), ' | '), ''), 'No suspicious HTML elements detected') END AS html_details
  FROM m2)"""


def _conf() -> str:
    s, u, h, m = "semantic_score", "url_score", "header_score", "html_score"
    c0 = f"({s} * {D(0.35)} + {u} * {D(0.3)} + {h} * {D(0.2)} + {m} * {D(0.15)})"
    mx = f"greatest({s}, {u}, {h}, {m})"
    c1 = f"(CASE WHEN {mx} > 0.4 THEN greatest({c0}, {mx} * {D(0.7)}) ELSE {c0} END)"
    fl = " + ".join(f"(CASE WHEN {x} > 0.2 THEN 1 ELSE 0 END)" for x in (s, u, h, m))
    c2 = f"(CASE WHEN ({fl}) >= 2 THEN {c1} * {D(1.15)} ELSE {c1} END)"
    c3 = f"(CASE WHEN ({fl}) >= 3 THEN {c2} * {D(1.1)} ELSE {c2} END)"
    c4 = f"(CASE WHEN {c3} > 0.2 THEN {D(0.2)} + ({c3} - {D(0.2)}) * {D(1.3)} ELSE {c3} END)"
    return f"least(greatest({c4}, {D(0)}), {D(1)})"


SCORED = f"""
joined AS (
  SELECT s.email_id, s.label, s.source, s.subject, s.body_text,
    {', '.join(f's.{n}_matches, s.{n}_count, s.{n}_score' for n in _CATS)},
    s.brand_mentions, s.grammar_issues, s.grammar_score, s.semantic_score,
    u.* EXCLUDE (email_id), h.* EXCLUDE (email_id), m.* EXCLUDE (email_id)
  FROM sem s JOIN urlx u USING (email_id) JOIN hdr h USING (email_id) JOIN html m USING (email_id)),
cls AS (SELECT *, {_conf()} AS raw_conf FROM joined),
scored AS (SELECT *,
    CASE WHEN raw_conf >= 0.4 THEN 'phishing' WHEN raw_conf >= 0.22 THEN 'suspicious' ELSE 'legitimate' END AS verdict,
    round(raw_conf, 4) AS confidence,
    round(least(url_score * {D(0.4)} + header_score * {D(0.35)} + html_score * {D(0.25)}, {D(1)}), 4) AS structural_score
  FROM cls),
final AS (SELECT *,
    CASE WHEN verdict = 'phishing' AND confidence > 0.75 THEN 'quarantine'
         WHEN verdict IN ('phishing', 'suspicious') THEN 'alert' ELSE 'pass' END AS recommended_action
  FROM scored)"""


def with_chain(select: str) -> str:
    return "WITH " + ",".join([EMAILS, SEMANTIC, URLS, HEADERS, HTML, SCORED]) + "\n" + select


def _j(x: str) -> str:
    return f"array_to_string({x}, ' | ')"


def _details_sem() -> str:
    parts = []
    for n, prefix, k in [("urgency", "Urgency cues: ", 5), ("authority", "Authority references: ", 5),
                         ("pressure", "Pressure tactics: ", 5), ("generic_greetings", "Generic greetings: ", 3),
                         ("reward_lures", "Reward/lure language: ", 3),
                         ("credential_requests", "Credential requests: ", 3)]:
        parts.append(f"CASE WHEN len({n}_matches) > 0 THEN {q(prefix)} || array_to_string({n}_matches[1:{k}], ', ') END")
    parts.append("CASE WHEN len(grammar_issues) > 0 THEN 'Grammar issues: ' || array_to_string(grammar_issues, ', ') END")
    parts.append("CASE WHEN len(brand_mentions) > 0 THEN 'Brand names mentioned: ' || array_to_string(brand_mentions[1:5], ', ') END")
    arr = f"list_filter([{', '.join(parts)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({arr}) > 0 THEN array_to_string({arr}, ' | ') ELSE 'No suspicious semantic patterns detected' END"


def _dominant() -> str:
    order = ["urgency", "authority", "pressure", "credential_requests", "reward_lures", "generic_greetings"]
    best = f"greatest({', '.join(f'{o}_score' for o in order)})"
    return "CASE " + " ".join(f"WHEN {o}_score = {best} THEN {q(o)}" for o in order) + " END"


def _pct(x: str) -> str:
    return f"printf('%.1f', ({x}) * {D(100)})"


def _explanation() -> str:
    reasons = ("list_filter(["
               "CASE WHEN len(urgency_matches) > 0 THEN 'urgency language (e.g., ''' || urgency_matches[1] || ''')' END, "
               "CASE WHEN len(authority_matches) > 0 THEN 'authority impersonation (references to ''' || authority_matches[1] || ''')' END, "
               "CASE WHEN len(credential_requests_matches) > 0 THEN 'requests for sensitive credentials' END, "
               "CASE WHEN len(pressure_matches) > 0 THEN 'time-pressure tactics' END, "
               "CASE WHEN url_score > 0.3 AND url_count > 0 THEN 'suspicious URLs (' || url_count || ' found)' END, "
               "CASE WHEN header_score > 0.3 AND spf_result = 'fail' THEN 'failed SPF authentication' END, "
               "CASE WHEN header_score > 0.3 AND display_name_mismatch THEN 'sender display name mismatch' END, "
               "CASE WHEN header_score > 0.3 AND reply_to_mismatch THEN 'Reply-To address mismatch' END, "
               "CASE WHEN html_score > 0.2 AND external_form_count > 0 THEN 'embedded forms pointing to external domains' END, "
               "CASE WHEN html_score > 0.2 AND has_obfuscated_js THEN 'obfuscated JavaScript code' END"
               "], lambda x: x IS NOT NULL)")
    rtext = (f"CASE WHEN len(r) > 1 THEN array_to_string(r[1:len(r) - 1], ', ') || ', and ' || r[len(r)] ELSE r[1] END")
    inds = ("list_filter([CASE WHEN semantic_score > 0.2 THEN 'some suspicious language patterns' END, "
            "CASE WHEN url_score > 0.2 THEN 'potentially suspicious URLs' END, "
            "CASE WHEN header_score > 0.2 THEN 'minor header anomalies' END], lambda x: x IS NOT NULL)")
    return f"""(SELECT CASE
      WHEN verdict = 'legitimate' THEN 'This email appears to be LEGITIMATE with ' || {_pct(f'{D(1)} - confidence')} || '% confidence. '
        || 'No significant phishing indicators were detected in the content, URLs, headers, or HTML structure. Standard security hygiene is still recommended.'
      WHEN verdict = 'suspicious' THEN 'This email was classified as SUSPICIOUS with ' || {_pct('confidence')} || '% confidence. '
        || 'The analysis found ' || coalesce(nullif(array_to_string({inds}, ', '), ''), 'borderline indicators')
        || ', but the evidence is not conclusive enough for a definitive phishing classification. Manual review is recommended to determine if this email is legitimate.'
      WHEN len(r) > 0 THEN 'This email was classified as PHISHING with ' || {_pct('confidence')} || '% confidence. '
        || 'The analysis detected ' || ({rtext}) || '. These are strong indicators of a phishing attempt designed to deceive the recipient into revealing sensitive information or taking harmful actions.'
      ELSE 'This email was classified as PHISHING with ' || {_pct('confidence')} || '% confidence based on a combination of semantic and structural indicators that match known phishing patterns.'
      END FROM (SELECT {reasons} AS r))"""


def _education() -> str:
    from baitscope.functions import fusion as FU
    notes = (f"list_filter([CASE WHEN len(urgency_matches) > 0 THEN {q(FU.EDU_URGENCY)} END, "
             f"CASE WHEN len(authority_matches) > 0 THEN {q(FU.EDU_AUTHORITY)} END, "
             f"CASE WHEN len(credential_requests_matches) > 0 THEN {q(FU.EDU_CREDENTIALS)} END, "
             f"CASE WHEN first_typo_url IS NOT NULL THEN {q(FU.EDU_TYPO_PREFIX)} || (SELECT typosquatting_target FROM url_rows r WHERE r.email_id = final.email_id AND r.url = final.first_typo_url) || {q(FU.EDU_TYPO_SUFFIX)} END"
             "], lambda x: x IS NOT NULL)")
    return (f"CASE WHEN verdict = 'legitimate' THEN {q(FU.EDU_LEGIT)} "
            f"ELSE coalesce(nullif(array_to_string({notes}, ' | '), ''), {q(FU.EDU_GENERAL)}) END")


def _struct_vec() -> list[str]:
    def b(x):
        return f"CASE WHEN {x} THEN {D(1)} ELSE {D(0)} END"

    def capped(x, cap):
        return f"least({x}, {cap}) / {D(cap)}"
    n = "url_count"
    z = D(0)
    v = [f"CAST({n} AS DOUBLE)", "url_score"] + [f"CAST(coalesce({x}, 0) AS DOUBLE)" for x in
                                                  ["n_ip", "n_short", "n_tld", "n_long", "n_at", "n_sub", "n_hyph", "n_nohttps"]]
    v += [f"coalesce(max_typo, {z})", "CAST(coalesce(n_path, 0) AS DOUBLE)", f"coalesce(max_risk, {z})",
          f"coalesce(sum_risk, {z}) / greatest({n}, 1)", f"least({n}, 20) / {D(20)}"]
    v += [f"CASE spf_result WHEN 'pass' THEN {D(0)} WHEN 'softfail' THEN {D(0.7)} WHEN 'fail' THEN {D(1)} ELSE {D(0.5)} END",
          f"CASE dkim_result WHEN 'pass' THEN {D(0)} WHEN 'fail' THEN {D(1)} ELSE {D(0.5)} END",
          f"CASE dmarc_result WHEN 'pass' THEN {D(0)} WHEN 'fail' THEN {D(1)} ELSE {D(0.5)} END",
          b("reply_to_mismatch"), b("display_name_mismatch"), b("x_mailer_suspicious"), b("missing_message_id"),
          b("missing_date"), b("suspicious_received_chain"), capped("received_hops", 15), "header_score"]
    v += [z] * 4
    v += [capped("hidden_element_count", 10), capped("external_form_count", 5), capped("tracking_pixel_count", 5),
          capped("external_image_count", 20), capped("iframe_count", 5), b("has_obfuscated_js"),
          capped("base64_content_count", 10), "html_score"]
    v += [z] * 7
    v += ["url_score * header_score", "greatest(url_score, header_score)",
          f"(url_score + header_score + html_score) / {D(3)}",
          b(f"{n} > 0 AND display_name_mismatch"), b(f"external_form_count > 0 AND {n} > 0")]
    return v


def _rule_vec() -> list[str]:
    v = []
    for n in _CATS:
        v += [f"{n}_score", f"CAST({n}_count AS DOUBLE)"]
    v += ["grammar_score", "semantic_score", "CAST(len(brand_mentions) AS DOUBLE)"] + [D(0)] * 5
    return v


def _flags() -> list[str]:
    f = [f"({n}_count > 0 OR {n}_score > 0)" for n in _CATS]
    f += ["grammar_score > 0", "len(brand_mentions) > 0", "coalesce(n_ip, 0) > 0", "coalesce(n_short, 0) > 0",
          "coalesce(n_tld, 0) > 0", "coalesce(n_nohttps, 0) > 0", "coalesce(max_typo, 0) > 0.5",
          "coalesce(n_path, 0) > 0", "coalesce(n_free, 0) > 0", "spf_result = 'fail'", "dkim_result = 'fail'",
          "display_name_mismatch", "external_form_count > 0", "has_obfuscated_js"]
    return [f"CASE WHEN {x} THEN 1 ELSE 0 END AS {name}" for x, name in zip(f, L.INDICATOR_NAMES)]


def _drop(x: str, placeholder: str) -> str:
    return f"CASE WHEN {x} = {q(placeholder)} THEN '' ELSE {x} END"


_ORACLE_SELECT = {
    "verdict_summary": "SELECT verdict, recommended_action, count(*) AS n_emails, round(avg(confidence), 4) AS avg_confidence "
                       "FROM final GROUP BY verdict, recommended_action",
    "email_scores": "SELECT email_id, label, semantic_score, url_count, url_score, header_score, html_score, "
                    "structural_score, confidence, verdict, recommended_action FROM final",
    "semantic_matches": "SELECT email_id, " + ", ".join(
        f"{n}_count, {n}_score, {_j(f'{n}_matches')} AS {n}_matches" for n in _CATS)
        + f", {_j('brand_mentions')} AS brand_mentions, {_j('grammar_issues')} AS grammar_issues, grammar_score, "
          f"semantic_score, {_dominant()} AS dominant_category, {_details_sem()} AS semantic_details FROM final",
    "url_features": "SELECT email_id, url, is_ip_based, uses_shortener, uses_free_hosting, free_hosting_platform, "
                    "suspicious_tld, long_domain, has_at_symbol, excessive_subdomains, excessive_hyphens, uses_https, "
                    "round(typosquatting_score, 6) AS typosquatting_score, typosquatting_target, "
                    "array_to_string(path_kws, ', ') AS path_keywords, round(risk_score, 6) AS risk_score FROM url_rows",
    "url_rollup": "SELECT email_id, url_count, url_score, url_details FROM final",
    "header_features": "SELECT email_id, spf_result, dkim_result, dmarc_result, from_email, from_domain, reply_to_email, "
                       "reply_to_mismatch, display_name_mismatch, mm.kw AS brand_mismatch_keyword, x_mailer_suspicious, "
                       "missing_message_id, missing_date, suspicious_received_chain, received_hops AS received_hop_count, "
                       "header_score, CASE WHEN len(hdl) = 0 THEN 'No header anomalies detected' ELSE array_to_string(hdl, ' | ') END "
                       "AS header_details FROM final",
    "html_features": "SELECT email_id, hidden_element_count, external_form_count, tracking_pixel_count, external_image_count, "
                     "iframe_count, has_obfuscated_js, base64_content_count, html_score, html_details FROM final",
    "explanations": "SELECT email_id, verdict, confidence, recommended_action, CASE recommended_action "
                    "WHEN 'quarantine' THEN 'Quarantine this email immediately. High confidence phishing detected.' "
                    "WHEN 'alert' THEN 'Flag for manual review. Suspicious indicators detected.' "
                    "ELSE 'No significant phishing indicators detected. Email appears legitimate.' END AS action_description, "
                    f"{_explanation()} AS explanation, {_education()} AS education_note FROM final",
    "threat_indicators": "SELECT email_id, url_score AS suspicious_urls_score, "
                         f"{_drop('url_details', 'No URLs found in email content')} AS suspicious_urls_details, "
                         f"round(urgency_score * {D(0.4)} + authority_score * {D(0.3)} + pressure_score * {D(0.3)}, 4) AS urgency_language_score, "
                         "array_to_string(list_concat(urgency_matches, authority_matches, pressure_matches), ' | ') AS urgency_language_details, "
                         "header_score AS header_anomalies_score, array_to_string(hdl, ' | ') AS header_anomalies_details, "
                         "grammar_score AS grammatical_anomalies_score, array_to_string(grammar_issues, ' | ') AS grammatical_anomalies_details, "
                         "html_score AS html_suspicious_score, "
                         f"{_drop('html_details', 'No suspicious HTML elements detected')} AS html_suspicious_details, "
                         "coalesce(nullif(concat_ws(' | ', "
                         f"nullif({_drop('url_details', 'No URLs found in email content')}, ''), "
                         "nullif(array_to_string(hdl, ' | '), ''), "
                         f"nullif({_drop('html_details', 'No suspicious HTML elements detected')}, '')), ''), "
                         "'No structural anomalies detected') AS structural_details FROM final",
    "indicator_flags": "SELECT email_id, " + ", ".join(_flags()) + " FROM final",
    "feature_vector": "SELECT email_id, " + ", ".join(
        f"round({x}, 6) AS f{i:02d}" for i, x in enumerate(_rule_vec() + _struct_vec())) + " FROM final",
}




# ---------------------------------------------------------------------------
# embedding modes
# ---------------------------------------------------------------------------

_EMB = ("emb AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS embedding FROM embeddings WHERE len(embedding) > 0 "
        "AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0 GROUP BY vec_id)")


def _modes_sql() -> str:
    plain, older, whole, reduced = "'rule_structural'", "'rule_only'", "'bert_structural'", "'pca_bert'"
    cols = {"heuristic": ("'heuristic'", "NOT has"), "reduced": (f"CASE WHEN has THEN {reduced} ELSE {older} END", "NOT has"),
            "degraded": (plain, "NOT has"), "older": (older, "true"), "padded": (older, "true"),
            "whole": (f"CASE WHEN has THEN {whole} ELSE {plain} END", "NOT has")}
    out = ", ".join(f"{m} AS {n}_mode, {d} AS {n}_degraded" for n, (m, d) in cols.items())
    return f"WITH {_EMB} SELECT doc_id AS email_id, has, {out} FROM (SELECT doc_id, doc_id IN (SELECT vec_id FROM emb) AS has FROM documents)"


def _vectors_sql() -> str:
    rule, struct = f"[{', '.join(_rule_vec())}]", f"[{', '.join(_struct_vec())}]"

    def fit(v, n):
        return f"list_concat({v}, list_transform(range({n}), lambda i: {D(0)}))[1:{n}]"

    def text(v):
        return f"array_to_string(list_transform({v}, lambda x: CAST(CAST(round(x * 10000) AS BIGINT) AS VARCHAR)), ',')"
    wide = f"CASE WHEN embedding IS NOT NULL THEN list_concat(embedding, s) ELSE {fit('list_concat(r, s[1:20])', 114)} END"
    return with_chain_plus(_EMB, f"SELECT email_id, {text('list_concat(r, s[1:20])')} AS degraded_40, {text(fit('list_concat(r, s)', 60))} AS older_60, "
                           f"{text(fit('list_concat(r, s)', 84))} AS older_84, {text('w[1:64]')} AS whole_head, {text('w[65:114]')} AS whole_tail "
                           f"FROM (SELECT *, {wide} AS w FROM (SELECT email_id, {rule} AS r, {struct} AS s FROM final) v LEFT JOIN emb ON vec_id = email_id)")


# Scans of even emails first, then of odd ones, each by time and email.
_SCANS = "(SELECT *, row_number() OVER (ORDER BY email_id % 2, email_id % (100 * 365 * 1440), email_id) AS id FROM final) scans"

_FAILURES = ("SELECT reason, count(*) AS n_rows FROM (SELECT CASE WHEN doc_id % 10 IN (3, 7) THEN 'label' ELSE 'kept' END AS reason FROM documents) "
             "GROUP BY reason")


# ---------------------------------------------------------------------------
# metrics, corpus, history and audit twins
# ---------------------------------------------------------------------------

PREDS = "preds AS (SELECT *, CASE WHEN verdict = 'phishing' THEN 1 ELSE 0 END AS pred FROM final)"


def _dv(a: str, b: str) -> str:
    return f"(CASE WHEN ({b}) <> 0 THEN ({a}) / ({b}) ELSE {D(0)} END)"


def _metrics_select(src: str) -> str:
    tp, tn, fp, fn = "CAST(tp AS DOUBLE)", "CAST(tn AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)"
    n = f"({tp} + {tn} + {fp} + {fn})"
    p_ph, r_ph = _dv(tp, f"{tp} + {fp}"), _dv(tp, f"{tp} + {fn}")
    f_ph = _dv(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}")
    p_lg, r_lg = _dv(tn, f"{tn} + {fn}"), _dv(tn, f"{tn} + {fp}")
    f_lg = _dv(f"2 * {p_lg} * {r_lg}", f"{p_lg} + {r_lg}")
    f_lgm = _dv(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
    po = _dv(f"{tp} + {tn}", n)
    pe = _dv(f"({tp} + {fp}) * ({tp} + {fn}) + ({tn} + {fn}) * ({tn} + {fp})", f"{n} * {n}")
    kappa = _dv(f"{po} - {pe}", f"{D(1)} - {pe}")
    r4 = lambda x: f"round({x}, 4)"
    return (f"SELECT CAST({n} AS BIGINT) AS n_total, CAST({tp} + {fn} AS BIGINT) AS n_phishing, "
            f"CAST({tn} + {fp} AS BIGINT) AS n_legit, tp, tn, fp, fn, {r4(po)} AS accuracy, "
            f"{r4(f'({p_ph} + {p_lg}) / 2')} AS macro_precision, {r4(f'({r_ph} + {r_lg}) / 2')} AS macro_recall, "
            f"{r4(f'({f_ph} + {f_lgm}) / 2')} AS macro_f1, "
            f"{r4(_dv(f'{f_ph} * ({tp} + {fn}) + {f_lgm} * ({tn} + {fp})', n))} AS weighted_f1, "
            f"{r4(_dv(fp, f'{fp} + {tn}'))} AS fpr, {r4(_dv(fn, f'{fn} + {tp}'))} AS fnr, {r4(kappa)} AS cohen_kappa, "
            f"{r4(p_ph)} AS phishing_precision, {r4(r_ph)} AS phishing_recall, {r4(f_ph)} AS phishing_f1, "
            f"{r4(p_lg)} AS legit_precision, {r4(r_lg)} AS legit_recall, {r4(f_lg)} AS legit_f1 FROM {src}")


CM = ("cm AS (SELECT count(*) FILTER (WHERE label = 1 AND pred = 1) AS tp, count(*) FILTER (WHERE label = 0 AND pred = 0) AS tn, "
      "count(*) FILTER (WHERE label = 0 AND pred = 1) AS fp, count(*) FILTER (WHERE label = 1 AND pred = 0) AS fn FROM preds)")
GSCORE = ("g AS (SELECT confidence AS score, count(*) FILTER (WHERE label = 1) AS pos, "
          "count(*) FILTER (WHERE label = 0) AS neg FROM preds GROUP BY confidence)")
AUC = (f"{GSCORE}, g2 AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
       f"AS neg_below FROM g), auc AS (SELECT CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN "
       f"round(sum(pos * (neg_below + neg * {D(0.5)})) / (sum(pos) * sum(neg)), 4) ELSE 'nan'::DOUBLE END AS roc_auc, "
       f"CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM g2)")


def _bootstrap_sql(n_boot: int = 1000, seed: int = 42) -> str:
    """Poisson bootstrap: cumulative probabilities by group size, draws by their rank in it, metrics and percentiles by replicate."""
    tp, tn, fp, fn = "CAST(tp AS DOUBLE)", "CAST(tn AS DOUBLE)", "CAST(fp AS DOUBLE)", "CAST(fn AS DOUBLE)"
    f_ph, f_lg = _dv(f"2 * {tp}", f"2 * {tp} + {fp} + {fn}"), _dv(f"2 * {tn}", f"2 * {tn} + {fn} + {fp}")
    hit = lambda y, p: f"CAST(sum(CASE WHEN label = {y} AND pred = {p} THEN w ELSE 0 END) AS BIGINT)"
    extra = f"""{PREDS}, bg AS (SELECT label, pred, confidence AS score, count(*) AS m FROM preds GROUP BY ALL),
bm AS (SELECT m, greatest(0, m - (10 * sqrt(m) + 10)) AS lo, m + 10 * sqrt(m) + 10 AS hi FROM (SELECT DISTINCT m FROM bg)),
bk AS (SELECT m, unnest(range(CAST(floor(lo) AS BIGINT), CAST(ceil(hi) AS BIGINT))) AS k FROM bm),
bc AS (SELECT m, k, sum(exp(-m + k * ln(m) - lgamma(k + 1))) OVER (PARTITION BY m ORDER BY k) AS cdf FROM bk),
bl AS (SELECT m, min(k) AS lo, list(cdf ORDER BY k) AS cdfs FROM bc GROUP BY m),
bu AS (SELECT label, pred, score, b, m, (CAST('0x' || substr(md5(concat_ws(':', '{seed}', b, label, pred, CAST(round(score * 1000000000) AS BIGINT))), 1, 13) AS BIGINT)
    + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM bg, (SELECT unnest(range({n_boot})) AS b)),
bw AS (SELECT bu.*, lo + len(list_filter(cdfs, lambda x: x < u)) AS w FROM bu JOIN bl USING (m)),
bcm AS (SELECT b, {hit(1, 1)} AS tp, {hit(0, 0)} AS tn, {hit(0, 1)} AS fp, {hit(1, 0)} AS fn FROM bw GROUP BY b),
bs AS (SELECT b, score, CAST(sum(CASE WHEN label = 1 THEN w ELSE 0 END) AS BIGINT) AS pos, CAST(sum(CASE WHEN label = 0 THEN w ELSE 0 END) AS BIGINT) AS neg
    FROM bw GROUP BY b, score),
bb AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY b ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM bs),
ba AS (SELECT b, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (below + neg * {D(0.5)})) / (sum(pos) * sum(neg)) END AS roc_auc FROM bb GROUP BY b),
bx AS (SELECT b, {_dv(f'{tp} + {tn}', f'{tp} + {tn} + {fp} + {fn}')} AS accuracy, ({f_ph} + {f_lg}) / 2 AS macro_f1, roc_auc,
    {_dv(fp, f'{fp} + {tn}')} AS fpr, {_dv(fn, f'{fn} + {tp}')} AS fnr FROM bcm JOIN ba USING (b))"""
    rows = " UNION ALL ".join(f"SELECT '{k}' AS metric, round(quantile_cont({k}, 0.025), 4) AS ci_low, round(quantile_cont({k}, 0.975), 4) AS ci_high FROM bx"
                              for k in ("accuracy", "macro_f1", "roc_auc", "fpr", "fnr"))
    return with_chain_plus(extra, rows)


def _preds_sql(select: str) -> str:
    return with_chain_plus(PREDS, select)


def with_chain_plus(extra: str, select: str) -> str:
    return "WITH " + ",".join([EMAILS, SEMANTIC, URLS, HEADERS, HTML, SCORED, extra]) + "\n" + select


_FLAGS_CTE = "flags AS (SELECT email_id, " + ", ".join(_flags()) + " FROM final)"
_UNPIV = ("SELECT indicator, CAST(sum(fired) AS BIGINT) AS fires, round(sum(fired) * 100.0::DOUBLE / count(*), 2) AS pct "
          "FROM (UNPIVOT flags ON " + ", ".join(L.INDICATOR_NAMES) + " INTO NAME indicator VALUE fired) GROUP BY indicator")

_CORPORA = f"""
corp0 AS (SELECT doc_id AS row_id, {pick(FX.SUBJECTS, 'doc_id')} AS subject, coalesce(text, '') AS body,
    CAST(CASE WHEN (doc_id % 12 IN ({', '.join(map(str, FX.PHISH_TAILS))})) <> (doc_id % 17 = 0) THEN 1 ELSE 0 END AS INTEGER) AS label,
    {pick(['spamassassin', 'ceas', 'enron', 'ling', 'nazario', 'nigerian'], "CAST(regexp_extract(source, '(\\d+)$', 1) AS BIGINT)")} AS corpus
  FROM documents),
corp AS (SELECT row_id, subject, body, corpus,
    CAST(CASE WHEN corpus IN ('nazario', 'nigerian') AND sum(label) OVER (PARTITION BY corpus) = 0 THEN 1 ELSE label END AS INTEGER) AS label
  FROM corp0),
crank AS (SELECT *, CASE corpus {' '.join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(['spamassassin', 'ceas', 'enron', 'ling', 'nazario', 'nigerian', 'spaphish']))} ELSE 7 END AS source_rank FROM corp),
dedup AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY source_rank, row_id) AS rn FROM crank) WHERE rn = 1)"""


def _order(seed: int) -> str:
    return f"sha256(concat('{seed}:', CAST(row_id AS VARCHAR)))"


def _split_sql(train=0.70, val=0.15, test=0.15) -> str:
    vt = val + test
    return (f"WITH {_CORPORA}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(42)}, row_id) AS rk, "
            f"count(*) OVER (PARTITION BY label) AS n FROM dedup), "
            f"r2 AS (SELECT *, ceil(n * {D(vt)}) AS rest FROM r), r3 AS (SELECT *, ceil(rest * {D(1.0 - val / vt)}) AS ntest FROM r2) "
            f"SELECT CASE WHEN rk <= n - rest THEN 'train' WHEN rk <= n - ntest THEN 'val' ELSE 'test' END AS split, label, "
            f"count(*) AS n_rows, CAST(sum(row_id) AS BIGINT) AS id_sum FROM r3 GROUP BY ALL")


def _sample_sql(max_samples=500) -> str:
    half = max_samples // 2
    return (f"WITH {_CORPORA}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(42)}, row_id) AS rk FROM corp), "
            f"first AS (SELECT row_id, label FROM r WHERE rk <= {half}), "
            f"rest AS (SELECT row_id, label, row_number() OVER (ORDER BY {_order(43)}, row_id) AS rk2 FROM r WHERE rk > {half}), "
            f"smp AS (SELECT * FROM first UNION ALL SELECT row_id, label FROM rest WHERE rk2 <= {max_samples} - (SELECT count(*) FROM first)) "
            f"SELECT row_id, label, 'sample' AS part FROM smp UNION ALL "
            f"SELECT row_id, label, 'remainder' AS part FROM corp WHERE row_id NOT IN (SELECT row_id FROM smp)")


def _small_sample_sql() -> str:
    return (f"WITH {_CORPORA}, m AS (SELECT count(*) - 10 AS k FROM corp), "
            f"r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(42)}, row_id) AS rk FROM corp), "
            f"first AS (SELECT row_id FROM r, m WHERE rk <= k // 2), "
            f"rest AS (SELECT row_id, row_number() OVER (ORDER BY {_order(43)}, row_id) AS rk2 FROM r, m WHERE rk > k // 2) "
            f"SELECT row_id, 'top_up' AS part FROM first UNION ALL "
            f"SELECT row_id, 'top_up' FROM rest, m WHERE rk2 <= k - (SELECT count(*) FROM first) UNION ALL "
            f"SELECT row_id, 'single' FROM r WHERE label = 1 AND rk <= 60")


def _split_rows_sql(train=0.70, val=0.15, test=0.15) -> str:
    vt = val + test
    return (f"WITH {_CORPORA}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_order(42)}, row_id) AS rk, "
            f"count(*) OVER (PARTITION BY label) AS n FROM dedup), "
            f"r2 AS (SELECT *, ceil(n * {D(vt)}) AS rest FROM r), r3 AS (SELECT *, ceil(rest * {D(1.0 - val / vt)}) AS ntest FROM r2) "
            f"SELECT row_id, corpus, label, CASE WHEN rk <= n - rest THEN 'train' WHEN rk <= n - ntest THEN 'val' ELSE 'test' END AS split, "
            f"corpus = 'spamassassin' AS no_subject FROM r3 WHERE corpus IS NOT NULL")


def _paths_sql() -> str:
    from baitscope.plans.queries import FOLDERS
    from baitscope.sources.files import HAM_WORDS, PHISH_WORDS
    words = lambda x, ws: "(" + " OR ".join(f"contains({x}, '{w}')" for w in ws) + ")"
    label = f"CASE WHEN inside AND {words('top', PHISH_WORDS)} THEN 1 WHEN inside AND {words('top', HAM_WORDS)} THEN 0"
    return (f"WITH f AS (SELECT doc_id, source, {pick(FOLDERS, 'doc_id')} AS folder FROM documents), "
            f"p AS (SELECT doc_id, CASE WHEN folder = '' THEN doc_id || '.eml' ELSE folder || '/' || coalesce(source, 'x') || '/' || "
            f"CASE WHEN doc_id % 7 = 0 THEN 'Inbox/' ELSE '' END || doc_id || '.eml' END AS path FROM f), "
            f"w AS (SELECT *, lower(path) AS low, lower(split_part(path, '/', 1)) AS top, contains(path, '/') AS inside FROM p) "
            f"SELECT doc_id, path, {label} END AS folder_label, {label} WHEN NOT inside THEN 1 END AS flat_label, "
            f"CASE WHEN contains(low, 'spam') THEN 1 WHEN contains(low, 'ham') THEN 0 END AS archive_label, "
            f"CASE WHEN contains(low, 'spam') THEN 1 WHEN contains(low, 'ham') OR contains(low, 'inbox') THEN 0 END AS component_label FROM w")


_URG = f"round(urgency_score * {D(0.4)} + authority_score * {D(0.3)} + pressure_score * {D(0.3)}, 4)"
def _mean4(x: str) -> str:
    return f"(floor((2 * sum(CAST(round(({x}) * 10000) AS BIGINT)) + count(*)) / (2 * count(*))) / 10000.0::DOUBLE)"


_KPI = ("SELECT count(*) AS total_analyzed, count(*) FILTER (WHERE verdict = 'phishing') AS phishing_count, "
        "count(*) FILTER (WHERE verdict = 'suspicious') AS suspicious_count, "
        "count(*) FILTER (WHERE verdict = 'legitimate') AS legitimate_count, "
        "coalesce(round(count(*) FILTER (WHERE verdict = 'phishing') / count(*) * 100, 1), 0.0::DOUBLE) AS phishing_rate, "
        f"coalesce({_mean4('confidence')}, 0.0::DOUBLE) AS avg_confidence, "
        f"{_mean4('url_score')} AS suspicious_urls_mean, {_mean4(_URG)} AS urgency_language_mean, "
        f"{_mean4('header_score')} AS header_anomalies_mean, {_mean4('grammar_score')} AS grammatical_anomalies_mean, "
        f"{_mean4('html_score')} AS html_suspicious_mean FROM final")

_EXPORT = ("SELECT email_id AS id, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_minutes(email_id), '%Y-%m-%dT%H:%M:%SZ') AS timestamp, "
           "'eml' AS input_type, subject, '' AS sender, verdict, round(confidence * 100, 2) AS confidence, "
           "recommended_action, round(url_score * 100, 2) AS suspicious_urls_score, "
           f"round({_URG} * 100, 2) AS urgency_language_score, round(header_score * 100, 2) AS header_anomalies_score, "
           "round(grammar_score * 100, 2) AS grammatical_anomalies_score, round(html_score * 100, 2) AS html_suspicious_score "
           "FROM final WHERE email_id <> 0")


def _audit_sql(key: str, select: str) -> str:
    return (f"WITH s AS (SELECT event_id AS id, ts, sha256(CAST({key} AS VARCHAR)) AS body_hash, event_id % 2 AS submitted_label, "
            f"least(value / {D(50)}, {D(1)}) AS conf FROM events), f AS (SELECT *, submitted_label = 0 AND conf > 0.7 AS flagged FROM s), "
            f"w AS (SELECT *, coalesce(sum(CASE WHEN flagged THEN 1 ELSE 0 END) OVER (PARTITION BY body_hash ORDER BY ts, id "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior, "
            f"sum(CASE WHEN flagged THEN 1 ELSE 0 END) OVER (PARTITION BY body_hash) AS nflag FROM f) {select}")


_AUDIT_SUMMARY = ("SELECT count(*) AS n_submissions, count(*) FILTER (WHERE flagged) AS n_flagged, "
                  "count(*) FILTER (WHERE flagged AND prior = 0) AS n_held, "
                  "count(*) FILTER (WHERE flagged AND prior >= 1) AS n_confirmed_at_insert, "
                  "count(*) FILTER (WHERE flagged AND (prior >= 1 OR nflag >= 2)) AS n_confirmed, "
                  "count(*) FILTER (WHERE NOT (flagged AND prior = 0)) AS n_admitted FROM w")
_AUDIT_ROWS = ("SELECT id, flagged AS suspicious_flagged, flagged AND prior = 0 AS held, flagged AND prior >= 1 AS confirmed_at_insert, "
               "flagged AND (prior >= 1 OR nflag >= 2) AS confirmed FROM w")

_RATE = ("SELECT client, kind, strftime(minute, '%Y-%m-%d %H:%M:%S') AS minute_start, count(*) AS n_requests, "
         "CASE WHEN kind = 'train' THEN 5 ELSE 30 END AS max_per_minute, "
         "count(*) > CASE WHEN kind = 'train' THEN 5 ELSE 30 END AS violation FROM ("
         "SELECT user_id % 10 AS client, CASE WHEN event_type = 'signup' THEN 'train' ELSE 'analyse' END AS kind, "
         "date_trunc('minute', ts) AS minute FROM events) GROUP BY client, kind, minute")


def _system_sql() -> str:
    from baitscope.operators.metrics import BASELINE_SYSTEMS
    rows = ", ".join("(" + ", ".join([q(r[0])] + [("NULL::DOUBLE" if v is None else D(v)) for v in r[1:]]) + ")"
                     for r in BASELINE_SYSTEMS)
    return with_chain_plus(f"{PREDS}, {CM}, m AS ({_metrics_select('cm')}), {AUC}",
                           f"SELECT * FROM (VALUES {rows}) t(system, accuracy, fpr, fnr, f1, auc) UNION ALL "
                           "SELECT 'this_run', accuracy, fpr, fnr, macro_f1, (SELECT roc_auc FROM auc) FROM m")


MORE_ORACLE = {
    "evaluation_metrics": lambda: with_chain_plus(f"{PREDS}, {CM}", _metrics_select("cm")),
    "roc_auc": lambda: with_chain_plus(f"{PREDS}, {AUC}", "SELECT * FROM auc"),
    "roc_curve": lambda: with_chain_plus(
        f"{PREDS}, {GSCORE}",
        "SELECT score AS threshold, round(CASE WHEN sum(neg) OVER () <> 0 THEN CAST(sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / sum(neg) OVER () ELSE 0.0::DOUBLE END, 6) AS fpr, "
        "round(CASE WHEN sum(pos) OVER () <> 0 THEN CAST(sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING "
        "AND CURRENT ROW) AS DOUBLE) / sum(pos) OVER () ELSE 0.0::DOUBLE END, 6) AS tpr FROM g"),
    "indicator_fire_counts": lambda: with_chain_plus(_FLAGS_CTE, _UNPIV),
    "fn_by_category": lambda: with_chain_plus(
        PREDS, f"SELECT {_dominant()} AS dominant_category, count(*) AS n_false_negatives FROM preds "
               "WHERE label = 1 AND pred = 0 GROUP BY ALL"),
    "distributions": lambda: with_chain_plus(
        PREDS, "SELECT 'verdict' AS kind, verdict AS value, count(*) AS n FROM preds GROUP BY verdict "
               "UNION ALL SELECT 'method', 'heuristic', count(*) FROM preds"),
    "run_summary": lambda: with_chain_plus(
        PREDS, "SELECT count(*) AS n_total, count(*) FILTER (WHERE email_id NOT IN (SELECT vec_id FROM embeddings)) AS n_degraded, 0::BIGINT AS n_errors, round(avg(confidence), 4) AS avg_confidence, "
               "round(coalesce(avg(confidence) FILTER (WHERE pred = 1), 0.0::DOUBLE), 4) AS avg_conf_phishing, "
               "round(coalesce(avg(confidence) FILTER (WHERE pred = 0), 0.0::DOUBLE), 4) AS avg_conf_legit FROM preds"),
    "system_comparison": _system_sql,
    "bootstrap_ci": _bootstrap_sql,
    "embedding_modes": _modes_sql,
    "mode_vectors": _vectors_sql,
    "training_failures": lambda: _FAILURES,
    "corpus_breakdown": lambda: (f"WITH {_CORPORA} SELECT corpus, count(*) AS total, CAST(sum(label) AS BIGINT) AS phishing, "
                                 "count(*) - CAST(sum(label) AS BIGINT) AS legit, "
                                 "round(CAST(sum(label) AS BIGINT) * 100.0::DOUBLE / count(*), 1) AS phishing_pct "
                                 "FROM corp GROUP BY ROLLUP (corpus)"),
    "corpus_dedup": lambda: f"WITH {_CORPORA} SELECT row_id, corpus, label FROM dedup",
    "stratified_split": _split_sql,
    "balanced_sample": _sample_sql,
    "scan_kpi": lambda: with_chain(_KPI),
    "small_sample": _small_sample_sql,
    "corpus_chain": lambda: _split_rows_sql(),
    "path_labels": lambda: _paths_sql(),
    "class_weights": lambda: with_chain(
        "SELECT label, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight, true AS gate FROM emails GROUP BY label"),
    "history_appended": lambda: with_chain(f"SELECT id, email_id, verdict, confidence, recommended_action FROM {_SCANS}"),
    "scan_lookup": lambda: with_chain(f"SELECT id, verdict, 1::BIGINT AS n FROM {_SCANS} WHERE id = 18 "
        f"UNION ALL SELECT id, verdict, 2::BIGINT FROM (SELECT * FROM {_SCANS} WHERE id <> 17 ORDER BY id DESC LIMIT 3) "
        f"UNION ALL SELECT -1, 'left', count(*) FROM {_SCANS} WHERE id <> 17"),
    "history_page": lambda: with_chain("SELECT email_id AS id, verdict, confidence, recommended_action FROM final "
                                       "ORDER BY email_id DESC LIMIT 20 OFFSET 10"),
    "history_export": lambda: with_chain(_EXPORT),
    "training_counts": lambda: with_chain("SELECT count(*) AS total_samples, count(*) FILTER (WHERE label = 1) AS phishing_samples, "
                                          "count(*) FILTER (WHERE label = 0) AS legitimate_samples FROM emails"),
    "label_audit": lambda: _audit_sql("user_id % 20", _AUDIT_SUMMARY),
    "label_audit_by_user": lambda: _audit_sql("user_id", _AUDIT_ROWS),
    "rate_violations": lambda: _RATE,
}

def oracle_queries() -> dict[str, str]:
    out = {k: with_chain(v) for k, v in _ORACLE_SELECT.items()}
    out.update({k: f() for k, f in MORE_ORACLE.items()})
    return out


# ---------------------------------------------------------------------------
# text, URL-model and OCR twins
# ---------------------------------------------------------------------------

def _label_sql() -> str:
    from baitscope.functions.text import NEGATIVE_LOOSE, NEGATIVE_STRICT, POSITIVE_LOOSE, POSITIVE_STRICT
    from baitscope.plans.queries import RAW_LABELS

    def num(s):
        return (f"(CASE WHEN NOT isnan(TRY_CAST({s} AS DOUBLE)) AND CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS BIGINT) IN (0, 1) "
                f"THEN CAST(trunc(TRY_CAST({s} AS DOUBLE)) AS INTEGER) END)")
    st = strip("raw")
    lo = f"lower({st})"
    return (f"SELECT doc_id, raw AS raw_label, "
            f"CASE WHEN {st} IN ({', '.join(q(x) for x in POSITIVE_STRICT)}) THEN 1 "
            f"WHEN {st} IN ({', '.join(q(x) for x in NEGATIVE_STRICT)}) THEN 0 ELSE {num(st)} END AS label_strict, "
            f"CASE WHEN {lo} IN ({', '.join(q(x) for x in POSITIVE_LOOSE)}) THEN 1 "
            f"WHEN {lo} IN ({', '.join(q(x) for x in NEGATIVE_LOOSE)}) THEN 0 ELSE {num(lo)} END AS label_loose "
            f"FROM (SELECT doc_id, {pick(RAW_LABELS, 'doc_id')} AS raw FROM documents)")


def _strip_tags(x: str) -> str:
    t = f"regexp_replace({x}, '(?is)<style[^>]*>.*?</style>', '', 'g')"
    t = f"regexp_replace({t}, '(?is)<script[^>]*>.*?</script>', '', 'g')"
    t = f"regexp_replace({t}, '<[^>]+>', ' ', 'g')"
    return strip(f"regexp_replace({t}, '\\s+', ' ', 'g')")


def _strip_corpus(x: str) -> str:
    t = f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"
    for a, b in [("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")]:
        t = f"replace({t}, {q(a)}, {q(b)})"
    return strip(f"regexp_replace({t}, '\\s+', ' ', 'g')")


_TEXT_PARSE = (
    "SELECT page_id, subject, CASE WHEN is_html THEN " + _strip_tags("b") + " ELSE b END AS body_text, is_html AS has_html, "
    "CASE WHEN subject = '' AND (CASE WHEN is_html THEN " + _strip_tags("b") + " ELSE b END) = '' "
    "THEN 'Both subject and body are empty' END AS parse_error, " + _strip_corpus("html") + " AS corpus_text FROM ("
    "SELECT page_id, html, " + strip("CASE WHEN page_id % 5 = 0 THEN '' ELSE coalesce(url, '') END") + " AS subject, "
    + strip("coalesce(html, '')") + " AS b, " + strip("coalesce(html, '')") + " <> '' AND contains(lower("
    + strip("coalesce(html, '')") + "), '<html') AS is_html FROM pages)")


def _tokens_sql() -> str:
    from baitscope.functions.urls import URL_VOCAB
    return ("SELECT page_id, url, array_to_string(list_transform(list_concat(list_transform(string_split(coalesce(url, ''), '')[1:200], "
            f"lambda ch: CASE WHEN length(ch) = 1 THEN instr({q(URL_VOCAB)}, ch) ELSE 0 END), "
            "list_transform(range(greatest(200 - len(string_split(coalesce(url, ''), '')[1:200]), 0)), lambda i: 0))[1:200], "
            "lambda t: CAST(t AS VARCHAR)), ',') AS tokens FROM pages")


_BLEND = (
    "mrows AS (SELECT e.email_id, unnest(CASE WHEN coalesce(e.body_html, '') <> '' THEN list_distinct(list_concat(u.t_urls, u.h_urls)) "
    "ELSE u.t_urls END) AS url FROM emails e JOIN u0 u USING (email_id)), "
    "b AS (SELECT m.email_id, m.url, (length(m.url) % 100) / 100.0::DOUBLE AS p, r.risk_score AS rule_risk FROM mrows m "
    "LEFT JOIN url_rows r ON r.email_id = m.email_id AND r.url = m.url), "
    "b2 AS (SELECT *, CASE WHEN rule_risk IS NOT NULL THEN round(0.6::DOUBLE * p + 0.4::DOUBLE * rule_risk, 4) ELSE round(p, 4) END AS risk, "
    "CASE WHEN p >= 0.7 THEN 'high' WHEN p >= 0.5 THEN 'medium' ELSE 'low' END AS band FROM b)")
_BLEND_SELECT = ("SELECT email_id, count(*) AS url_count, round(0.7::DOUBLE * max(risk) + 0.3::DOUBLE * (sum(risk) / count(*)), 4) AS url_score, "
                 "count(*) FILTER (WHERE band = 'high') AS n_high, count(*) FILTER (WHERE band = 'medium') AS n_medium FROM b2 GROUP BY email_id")

_OCR_LINES = ("lines AS (SELECT doc_id AS image_id, unnest(string_split(text, chr(10))) AS line, "
              "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), "
              "words AS (SELECT image_id, line_no, unnest(string_split(line, ' ')) AS word, "
              "generate_subscripts(string_split(line, ' '), 1) AS word_no FROM lines), "
              "wc AS (SELECT *, (row_number() OVER (PARTITION BY image_id ORDER BY line_no, word_no) - 1) % 101 - 1 AS conf FROM words)")
_OCR_SUBJ = ("WITH lines AS (SELECT doc_id AS image_id, unnest(string_split(text, chr(10))) AS line, "
             "generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents), "
             f"s AS (SELECT image_id, line_no, {strip('line')} AS line FROM lines), "
             "s2 AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY line_no) AS rn FROM s WHERE line <> ''), "
             "s3 AS (SELECT * FROM s2 WHERE rn <= 5), "
             "h AS (SELECT image_id, arg_min(CASE WHEN starts_with(lower(line), 'subject:') THEN "
             f"{strip('substr(line, 9)')} ELSE line END, rn) AS v FROM s3 WHERE starts_with(lower(line), 'subject:') "
             "OR starts_with(lower(line), 're:') OR starts_with(lower(line), 'fw:') GROUP BY image_id), "
             "f AS (SELECT image_id, arg_min(substr(line, 1, 100), rn) AS first FROM s3 GROUP BY image_id) "
             "SELECT f.image_id, coalesce(h.v, f.first) AS subject FROM f LEFT JOIN h USING (image_id)")

MORE_ORACLE.update({
    "label_normalize": _label_sql,
    "text_input_parse": lambda: _TEXT_PARSE,
    "url_tokens": _tokens_sql,
    "url_blend": lambda: with_chain_plus(_BLEND, _BLEND_SELECT),
    "url_training_pairs": lambda: with_chain("SELECT unnest(t_urls) AS url, e.label FROM u0 JOIN emails e USING (email_id)"),
    "ocr_confidence": lambda: f"WITH {_OCR_LINES} SELECT image_id, round(avg(conf) FILTER (WHERE conf > 0) / 100.0::DOUBLE, 6) AS ocr_confidence FROM wc GROUP BY image_id",
    "ocr_subject": lambda: _OCR_SUBJ,
})
