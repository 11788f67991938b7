"""Queries over scores: the scores are computed once, whatever reads them."""

import pytest

import __spark_entry__ as E
from baitscope.operators import metrics as M
from baitscope.operators import ml as ML

SF = "/root/testdata/sf0.001"


class Seen(Exception):
    pass


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def given(monkeypatch, owner, name, spark, query):
    """The rows that ``query`` hands to ``owner.name``."""
    rows = []

    def stop(df, *args, **kwargs):
        rows.append(df)
        raise Seen

    monkeypatch.setattr(owner, name, stop)
    with pytest.raises(Seen):
        E.queries()[query](spark, SF)
    return rows[0]


def test_indicator_models_read_stored_rows(spark, monkeypatch):
    df = given(monkeypatch, ML, "fit_indicator_models", spark, "indicator_model_accuracy")
    assert "ArrowEvalPython" not in plan(df) and df.count() == 200


def test_email_forest_reads_stored_training_rows(spark, monkeypatch):
    seen = []

    class Forest:
        def fit(self, df):
            seen.append(df)
            raise Seen

    monkeypatch.setattr(ML, "forest", lambda **args: Forest())
    with pytest.raises(Seen):
        E.queries()["email_model_scores"](spark, SF)
    assert not any(x in plan(seen[0]) for x in ("ArrowEvalPython", "Exchange"))
    assert 130 < seen[0].count() < 150


def test_class_weights_do_not_deal_rows_by_label(spark):
    df = spark.createDataFrame([(k, k % 2) for k in range(100)] + [(100, None)], "row_id int, label int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = ML.class_weights(df)
        assert "BroadcastHashJoin" in plan(out) and "SortMergeJoin" not in plan(out)
        # A null label is a class of its own in the counts, and its rows drop out.
        assert {(r.label, round(r.weight, 6)) for r in out.collect()} == {(0, 0.673333), (1, 0.673333)} and out.count() == 100
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_system_comparison_scores_once(spark):
    assert "ArrowEvalPython" not in plan(E.queries()["system_comparison"](spark, SF))


def test_roc_auc_reads_its_input_once(spark):
    assert plan(E.queries()["roc_auc"](spark, SF)).count("ArrowEvalPython") == 1


def test_roc_auc_counts_every_pair(spark):
    """Against all pairs, with ties, null and NaN scores, scores of one cell, and null labels."""
    nan = float("nan")
    rows = [(k * 7 % 5 % 2, (k * 37 % 23) / 22000 + k % 3 / 3) for k in range(120)]
    rows += [(1, None), (0, None), (1, nan), (0, nan), (0, nan), (None, 0.5), (1, -0.25), (0, 3.5)]
    spark.createDataFrame(rows, "label int, roc_score double").createOrReplaceTempView("auc_rows")
    # Spark orders null before all numbers, and NaN after them.
    key = "named_struct('a', {0} IS NOT NULL, 'b', coalesce({0}, 0))"
    a, b = key.format("x.roc_score"), key.format("y.roc_score")
    pairs = spark.sql(f"""SELECT avg(CASE WHEN {a} > {b} THEN 1 WHEN {a} = {b} THEN 0.5 ELSE 0 END) FROM auc_rows x JOIN auc_rows y
                          ON x.label = 1 AND y.label = 0""").first()[0]
    got = M.roc_auc(spark.table("auc_rows")).first()
    assert abs(got.roc_auc - float(pairs)) <= 5.1e-5
    assert (got.n_pos, got.n_neg) == (sum(r[0] == 1 for r in rows), sum(r[0] == 0 for r in rows))


def test_bootstrap_draws_once_from_stored_scores(spark, monkeypatch):
    df = E.queries()["bootstrap_ci"](spark, SF)
    assert "ArrowEvalPython" not in plan(df) and plan(df).count("Generate explode") == 1
    # The draws are made behind the exchange by replicate, and nothing but whole replicates leaves it.
    assert "REPARTITION_BY_NUM" in plan(df) and plan(df).index("md5") < plan(df).index("REPARTITION_BY_NUM")
    assert plan(df).count("Exchange") == 2 + 1


def test_all_phishing_rule_does_not_deal_rows_by_corpus(spark):
    from baitscope.operators import corpus as CO
    rows = [(k, ["enron", "nazario", "nigerian", None, "ling"][k % 5], int(k == 2)) for k in range(50)]
    df = spark.createDataFrame(rows, "row_id int, corpus string, label int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = CO.all_phishing_rule(df)
        assert "SortMergeJoin" not in plan(out)
        assert out.columns == ["corpus", "row_id", "label"] and out.count() == 50
        assert {r.row_id for r in out.collect() if r.label == 1} == {2} | {k for k in range(50) if k % 5 == 1}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_ocr_shuffles_texts_not_words(spark):
    for name in ("ocr_subject", "ocr_confidence"):
        text = plan(E.queries()[name](spark, SF))
        assert text.count("Exchange hashpartitioning") == 1
        # Plans are printed from the result down: the exchange is below the explosion of words.
        assert text.rindex("Generate posexplode") < text.index("Exchange hashpartitioning"), text


def test_url_model_is_fitted_on_few_parts(spark, monkeypatch):
    """Gradients of all features come from each part: their number must not follow the input's."""
    seen = []

    class Model:
        def fit(self, df):
            seen.append(df)
            raise Seen

    monkeypatch.setattr(ML, "url_model", Model)
    pairs = spark.createDataFrame([(f"http://a.example/{k}", k % 2) for k in range(2000)], "url string, label int").repartition(500)
    with pytest.raises(Seen):
        ML.train_url_model(pairs)
    assert seen[0].rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and 1700 < seen[0].count() < 1900


def test_adversarial_variants_share_their_analyses(spark):
    """Texts are read for two stored analyses; the counts are those of four separate scorings, also where ids repeat."""
    from pyspark.sql import functions as F

    from baitscope.operators.scoring import EmailColumns, score_emails
    from baitscope.sources.fixtures import emails

    df = E.queries()["adversarial_evaluation"](spark, SF)
    assert "ArrowEvalPython" not in plan(df) and "documents.parquet" not in plan(df)
    e = emails(spark, SF).withColumnRenamed("x_mailer", "raw_mailer")
    variants = {"base": e, "no_subject": e.withColumn("subject", F.lit("")), "no_html": e.withColumn("body_html", F.lit("")),
                "no_headers": e.withColumn("received_hops", F.lit(None).cast("int"))}
    hits = {n: {r.email_id for r in score_emails(v, EmailColumns(x_mailer="raw_mailer")).where("verdict = 'phishing'").select("email_id").collect()}
            for n, v in variants.items()}
    want = {(n, 200, len(hits["base"]), len(hits[n]), len(hits["base"] - hits[n])) for n in variants if n != "base"}
    assert {tuple(r)[:5] for r in df.collect()} == want
