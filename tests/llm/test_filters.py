"""Operators 3, 4, 6 and 9."""

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from baitscope.llm import langid, quality, urlfilter, warc
from baitscope.llm.queries import QUERIES

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    got = QUERIES["op9_langid"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id").collect()
    assert len(got) == 1000
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in got if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97


def test_language_edges(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got}
    for k in (3, 4, 5, 7):
        assert (by[k].lang_pred, by[k].score) == ("und", 0.0)
    assert by[1].held_out == (zlib.crc32(b"1") % 4 == 2) and not by[None].held_out
    assert langid.identify(no_docs).count() == 0
    unknown = odd_docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in langid.identify(unknown).collect()} == {"und"}


def test_gram_counts_do_not_depend_on_spans(monkeypatch):
    text = "the quick brown fox 日本 über " * 40
    want = langid.gram_counts(text)
    for span in (7, 64, 333):
        monkeypatch.setattr(langid, "SPAN", span)
        assert (langid.gram_counts(text) == want).all()
    assert want.sum() == sum(len(text) - n + 1 for n in langid.ORDERS)


def test_quality_held_out(spark):
    got = QUERIES["op3_quality"](spark, DATA).join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert held and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_quality_edges(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, None), (2, 0, None), (None, 1, 1), (6, None, 0), (99, 1, 0), (2, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    scorer = quality.fit(odd_docs, labels)
    got = quality.score_documents(odd_docs, scorer).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    empty = {round(r.score, 12) for r in got if r.doc_id in (3, 4, 5)}
    assert len(empty) == 1
    blank = quality.fit(odd_docs, labels.limit(0))
    assert {r.score for r in quality.score_documents(odd_docs, blank).collect()} == {0.5}
    assert quality.score_documents(no_docs, scorer).count() == 0


def test_scores_do_not_depend_on_the_cache(monkeypatch):
    import numpy as np
    logit = np.random.default_rng(1).normal(size=quality.BUCKETS)
    texts = [f"word{k} other{k % 7} the the" for k in range(60)] + ["", None]
    want = quality.QualityScorer(logit).scores(texts)
    monkeypatch.setattr(quality, "CACHE_WORDS", 3)
    small = quality.QualityScorer(logit)
    assert [small.scores([t])[0] for t in texts] == pytest.approx(want)


PAGES = [(1, "http://a/\r\nx", "é" * 70000), (2, None, "é" * 70000), (3, "u", None), (4, "u", ""), (5, "u", "x" * 99), (6, "u", "x" * 99),
         (7, "u", "y" * 100), (8, "u", "y" * 100), (8, "u", "y" * 100), (None, "u", "y" * 100), (9, "u", "WARC/1.1\r\n\r\n" * 9000)]


@pytest.mark.parametrize("chunk", [64 << 10, 1000])
def test_warc_round_trip(spark, chunk):
    df = spark.createDataFrame([(*r, "z") for r in PAGES], "page_id long, url string, html string, digest string")
    got = warc.archive_digests(df, chunk_bytes=chunk).collect()
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", PAGES)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, got)) == sorted(map(key, con.execute(warc.ORACLE_SQL).fetchall()))
    assert warc.archive_digests(df.limit(0)).count() == 0


def test_warc_chunks_carry_running_digests(spark):
    import hashlib

    from baitscope.llm.common import scratch
    df = spark.createDataFrame([(1, "u", "abc" * 1000)], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_archives(df, path, chunk_bytes=700)
    rows = warc.read_chunks(spark, path).orderBy("chunk_no").collect()
    assert [r.n_bytes for r in rows] == [700, 700, 700, 700, 200] and [r["last"] for r in rows] == [False] * 4 + [True]
    whole = b"abc" * 1000
    for k, r in enumerate(rows):
        assert r.running_sha256 == hashlib.sha256(whole[:700 * (k + 1)]).hexdigest()
    assert b"".join(bytes(r.data) for r in rows) == whole


def test_url_rules(spark):
    rows = [(1, "http://Shop.Example.COM/en/a?x", "shop.example.com", "/en/a", "example.com/en/", "block"),
            (2, "https://www.example.com/en/#f", "www.example.com", "/en/", "www.example.com/en/", "allow"),
            (3, "https://a.www.example.com/en/", "a.www.example.com", "/en/", "www.example.com/en/", "allow"),
            (4, "http://x.com", "x.com", "", None, None), (5, "http://x.com?q=/", "x.com", "", None, None),
            (6, "http://x.com/", "x.com", "/", "com/", "allow"), (7, "http://y.net/es/1", "y.net", "/es/1", "net/es/", "block"),
            (8, "http://notcom/", "notcom", "/", None, None), (9, None, "", "", None, None), (10, "x.com/en/", "", "", None, None),
            (11, "http://ÀX.net/fr/é?", "Àx.net", "/fr/é", "net/fr/", "block"), (11, "http://ÀX.net/fr/é?", "Àx.net", "/fr/é", "net/fr/", "block")]
    df = spark.createDataFrame([(r[0], r[1], "z", "z") for r in rows], "page_id long, url string, verdict string, gram string")
    got = urlfilter.judge(df, urlfilter.RULES).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r for r in got}
    for k, _, host, path, rule, verdict in rows:
        assert (by[k].host, by[k].path, by[k].rule) == (host, path, rule)
        assert by[k].verdict == verdict if verdict else by[k].verdict in ("allow", "block")
    assert urlfilter.judge(df.limit(0), urlfilter.RULES).count() == 0
    only = urlfilter.judge(df.where("page_id in (4, 6)"), urlfilter.RULES).collect()
    assert {r.verdict for r in only} == {"allow"}


def test_url_model_against_plain_python(spark):
    import math
    from collections import Counter, defaultdict
    pages = spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")
    got = {r.page_id: r.ratio for r in urlfilter.judge(pages, urlfilter.RULES).where("ratio IS NOT NULL").collect()}
    fold = {r.url: r.f for r in pages.select("url", (F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(5)) == 0).alias("f")).collect()}
    host, path = urlfilter.host_and_path(F.col("url"))
    decided = {r.url: r.v for r in pages.select("url", urlfilter.by_rule(host, path, urlfilter.RULES)[1].alias("v")).collect()}
    n = urlfilter.ORDER
    grams = lambda u: [(urlfilter.START * n + u + urlfilter.END)[i:i + n + 1] for i in range(len(u) + 1)]
    models, letters = {}, set()
    for kind in ("allow", "block"):
        counts, follow = Counter(), defaultdict(set)
        for u, v in decided.items():
            if v == kind and not fold[u]:
                for g in grams(u):
                    for k in range(n + 1):
                        counts[g[n - k:]] += 1
                        counts["ctx", g[n - k:n]] += 1
                        follow[g[n - k:n]].add(g[n])
                    letters.add(g[n])
        models[kind] = (counts, follow)

    def logp(kind, g):
        counts, follow = models[kind]
        p = 1 / (len(letters) + 1)
        for k in range(n + 1):
            context = g[n - k:n]
            total, kinds = counts["ctx", context], len(follow[context])
            if total:
                p = (counts[g[n - k:]] + kinds * p) / (total + kinds)
        return math.log(p)

    urls = {r.page_id: r.url for r in pages.collect()}
    assert got
    for k, ratio in got.items():
        gs = grams(urls[k])
        want = sum(logp("allow", g) - logp("block", g) for g in gs) / len(gs)
        assert ratio == pytest.approx(want, abs=1e-9)
