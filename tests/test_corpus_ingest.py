"""Corpus operators (properties) and file sources on small generated files."""

import os
import tempfile

from pyspark.sql import functions as F

from baitscope.operators import corpus as CO
from baitscope.sources import files as FS

SF = "/root/testdata/sf0.001"


def test_split_conserves_rows_and_shares(spark):
    corp = CO.all_phishing_rule(CO.corpora(spark, SF))
    sp = CO.stratified_split(corp)
    assert sp.count() == corp.count()
    counts = {(r.label, r.split): r.n for r in sp.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label in (0, 1):
        n = sum(v for (lab, _), v in counts.items() if lab == label)
        assert abs(counts.get((label, "train"), 0) - 0.70 * n) <= 1


def test_dedup_keeps_first_and_unique_bodies(spark):
    corp = CO.corpora(spark, SF)
    d = CO.dedup_bodies(corp)
    assert d.count() == corp.select("body").distinct().count()


def test_balanced_sample_size(spark):
    corp = CO.corpora(spark, SF)
    smp = CO.balanced_sample(corp, 50)
    assert smp.count() == 50 and smp.select("row_id").distinct().count() == 50
    assert CO.remainder(corp, smp).count() == corp.count() - 50


def test_all_phishing_rule(spark):
    df = spark.createDataFrame([(1, "a", 0, "nazario"), (2, "b", 0, "nazario"), (3, "c", 0, "enron")],
                               "row_id long, body string, label int, corpus string")
    out = {r.row_id: r.label for r in CO.all_phishing_rule(df).collect()}
    assert out == {1: 1, 2: 1, 3: 0}


def test_folder_labels(spark):
    rows = [("/r/easy_ham/1", 0, 0, 0), ("/r/spam_2/x/1", 1, 1, 1), ("/r/phishing_corpus/1", 1, None, None),
            ("/r/a+b/inbox/1", None, None, 0), ("/r/plain.eml", None, None, None), ("/r/SAFE/spam.eml", 0, 1, 1)]
    df = spark.createDataFrame([(r[0],) for r in rows], "path string")
    got = {r.path: r.label for r in FS.labelled_mail(df, "/r").collect()}
    assert got == {r[0]: r[1] for r in rows if r[1] is not None}
    got = df.select("path", FS.archive_label(F.col("path")).alias("a"), FS.component_label(F.col("path")).alias("c")).collect()
    assert [(r.path, r.a, r.c) for r in got] == [(r[0], r[2], r[3]) for r in rows]
    flat = spark.createDataFrame([("file:/x.(y/1.eml",), ("file:/x.(y/2.eml",)], "path string")
    assert [r.label for r in FS.labelled_mail(flat, "file:/x.(y").collect()] == [1, 1]


def test_mail_bodies(spark):
    df = spark.createDataFrame([("plain", "<p>no</p>"), ("", "<p>See you at noon</p>"), (None, None)], "body_text string, body_html string")
    assert [r.body_text for r in FS.mail_bodies(df).collect()] == ["plain", "See you at noon", ""]


def test_bodies_are_kept_whole(spark):
    df = spark.createDataFrame([("s" * 900, "b" * 20000, "1")], "subject string, body string, label string")
    for out in (FS.corpus_rows(df, "subject", "body", "label", "x"), FS.detect_layout(df), FS.trainer_csv(df)):
        r = out.first()
        assert (len(r.subject), len(r.body)) == (900, 20000)
    assert len(FS.trainer_csv(df, max_body=3000).first().body) == 3000


def test_seeded_order_is_not_the_id_order(spark):
    df = spark.range(4000).withColumnRenamed("id", "row_id").withColumn("label", (F.col("row_id") % 2).cast("int"))
    a = {r.row_id: r._rank for r in CO.ranked(df, None, seed=42).collect()}
    b = {r.row_id: r._rank for r in CO.ranked(df, None, seed=43).collect()}
    assert sorted(a.values()) == list(range(1, 4001))
    n, mean = 4000, 2000.5
    corr = lambda x, y: sum((x[i] - mean) * (y[i] - mean) for i in x) / (n * (n * n - 1) / 12)
    ids = {i: i + 1 for i in a}
    assert abs(corr(a, ids)) < 0.06 and abs(corr(a, b)) < 0.06 and a != b
    text = spark.createDataFrame([("x%d" % i, 0) for i in range(50)], "row_id string, label int")
    assert sorted(r._rank for r in CO.ranked(text, "label").collect()) == list(range(1, 51))


def test_single_class_sample(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), F.lit(1).alias("label"))
    assert CO.balanced_sample(df, 40, top_up=False).count() == 40
    assert CO.balanced_sample(df, 40).count() == 40


def test_csv_and_layouts(spark):
    d = tempfile.mkdtemp(prefix="csv-", dir="/tmp")
    path = os.path.join(d, "enron_sample.csv")
    with open(path, "w") as f:
        f.write('subject,body,label\n"Hi","multi\nline body",ham\n"Win","prize now",spam\n"x","y",7\n')
    df = FS.read_csv(spark, path)
    rows = FS.corpus_rows(df, "subject", "body", "label", "enron").collect()
    assert [(r.subject, r.label) for r in rows] == [("Hi", 0), ("Win", 1)]
    assert rows[0].body == "multi\nline body"
    p2 = os.path.join(d, "val.csv")
    with open(p2, "w") as f:
        f.write('Email Text,Email Type\n"free money",Phishing Email\n"meeting",Safe Email\n')
    lay = FS.detect_layout(FS.read_csv(spark, p2)).collect()
    assert [(r.body, r.label) for r in lay] == [("free money", 1), ("meeting", 0)]
    disc = {r.corpus: r.path for r in FS.discover_corpora(spark, d).collect()}
    assert "enron" in disc


def test_raw_bytes_fallback(spark):
    df = spark.createDataFrame([("", bytearray(b"raw body")), ("kept", bytearray(b"x"))], "body string, content binary")
    out = [r.body for r in FS.raw_bytes_body_fallback(df).collect()]
    assert out == ["raw body", "kept"]
