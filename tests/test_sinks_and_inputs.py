"""Sinks, views and inputs that no registered query reads."""

import math
import random

import pytest
from pyspark.sql import functions as F

from baitscope.functions.text import nfkc, truncate
from baitscope.operators import audit as A
from baitscope.operators import corpus as CO
from baitscope.operators import history as H
from baitscope.operators import metrics as M
from baitscope.operators import ml as ML
from baitscope.sources import files as FI


def test_truncate_trims_first(spark):
    df = spark.createDataFrame([("  abcdef ",), (None,), ("ab",), ("　é日本x",)], "t string")
    assert [r[0] for r in df.select(truncate(F.col("t"), 3)).collect()] == ["abc", "", "ab", "é日本"]


def test_nfkc_only_touches_other_than_ascii(spark):
    df = spark.createDataFrame([("plain ~ text",), ("ｆｕｌｌ ﬁ ①",), ("",), (None,), ("é",)], "t string")
    assert [r[0] for r in df.select(nfkc("t")).collect()] == ["plain ~ text", "full fi 1", "", None, "é"]


def test_client_address(spark):
    df = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9.9.9.9"), ("", "9.9.9.9"), (None, None), ("8.8.8.8", None)], "x string, p string")
    assert [r[0] for r in df.select(A.client_ip(F.col("x"), F.col("p"))).collect()] == ["1.2.3.4", "9.9.9.9", "unknown", "8.8.8.8"]


def test_semicolon_csv_with_mark(spark, tmp_path):
    f = tmp_path / "t.csv"
    f.write_bytes("﻿subject;body;label\nHello;a b;1\n;;0\nx;;0\ny;z;2\n w ; v ;0 \nq;r;1.0\n".encode())
    got = [tuple(r) for r in FI.semicolon_training_csv(spark, str(f)).collect()]
    assert sorted(got) == [("Hello", "a b", 1), ("w", "v", 0), ("x", "", 0)]


def test_splits_are_written_and_read_back(spark, tmp_path):
    rows = spark.createDataFrame([(i, "s", f"body {i}", i % 2) for i in range(200)], "row_id long, subject string, body string, label int")
    split = CO.stratified_split(rows)
    CO.write_splits(split, str(tmp_path / "s"))
    back = spark.read.option("header", True).csv(str(tmp_path / "s"))
    assert {(r.split, int(r.row_id)) for r in back.collect()} == {(r.split, r.row_id) for r in split.collect()}
    assert {p.name for p in (tmp_path / "s").iterdir() if p.is_dir()} == {"split=train", "split=val", "split=test"}


def test_metrics_predictions_and_export_are_written(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "quoted", body\nwith a break', .5), (2, None, .25)], "email_id long, body_text string, confidence double")
    H.write_predictions(rows, str(tmp_path / "p"), max_body=8)
    back = spark.read.option("header", True).option("multiLine", True).option("escape", "\\").csv(str(tmp_path / "p")).orderBy("email_id").collect()
    assert [(r.email_id, r.body_text, r.confidence) for r in back] == [("1", 'a "quote', "0.5"), ("2", None, "0.25")]
    H.write_metrics(rows.agg(F.avg("confidence").alias("mean")), str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m")).first()["mean"] == .375
    H.write_export(rows, str(tmp_path / "e"))
    assert spark.read.option("header", True).option("multiLine", True).csv(str(tmp_path / "e")).count() == 2


def test_public_view_hides_the_raw_record(spark):
    rows = spark.createDataFrame([(1, "{}")], "id long, raw_features string")
    assert H.public_view(rows).columns == ["id"] and H.public_view(rows, expose_raw=True).columns == ["id", "raw_features"]


def test_feature_importance_first_ten_and_top(spark):
    rng = random.Random(2)
    rows = [(i % 2, [rng.random() for _ in range(14)] + [float(i % 2)]) for i in range(80)]
    x = ML.to_vector(spark.createDataFrame(rows, "label int, v array<double>"), "v")
    model = ML.forest(num_trees=8, max_depth=3, weighted=False).fit(x)
    first, top = ML.feature_importance(model), ML.feature_importance(model, first_k=False)
    assert [n for n, _ in first] == [f"feature_{i}" for i in range(10)]
    assert top[0][0] == "feature_14" and [v for _, v in top] == sorted((v for _, v in top), reverse=True)


@pytest.mark.parametrize("scale", [1, 1000])
def test_roc_over_unrounded_scores(spark, scale):
    """Scores of any precision and range, with ties, against counting all pairs."""
    rng = random.Random(scale)
    rows = [(rng.randint(0, 1), scale * (rng.random() - .3 if rng.random() < .8 else round(rng.random(), 1))) for _ in range(400)]
    df = spark.createDataFrame(rows, "label int, roc_score double")
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    want = sum((p > n) + .5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(M.roc_auc(df).first()["roc_auc"] - want) < 5.1e-5
    curve = {r.threshold: (r.fpr, r.tpr) for r in M.roc_curve(df).collect()}
    assert set(curve) == {s for _, s in rows}
    for t, (fpr, tpr) in curve.items():
        assert abs(fpr - sum(n >= t for n in neg) / len(neg)) < 1e-6 and abs(tpr - sum(p >= t for p in pos) / len(pos)) < 1e-6
    assert math.isnan(M.roc_auc(df.where("label = 1")).first()["roc_auc"])
