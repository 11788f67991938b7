"""Embedding join, vector modes and stored models."""

import random

import pytest
from pyspark.sql import functions as F

from baitscope.operators import embeddings as E

DIM = 12


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    out = []
    for i in range(160):
        label = i % 2
        emb = None if i % 5 == 0 else [rng.gauss(label, .4) for _ in range(DIM)]
        out.append((i, label, [rng.gauss(label, .5)] * 20, [rng.gauss(0, 1)] * 50, emb, .1, .1, .1, .1))
    return spark.createDataFrame(out, "email_id long, label int, rule_vector array<double>, structural_vector array<double>, "
                                 "embedding array<double>, semantic_score double, url_score double, header_score double, html_score double")


def test_join_keeps_every_email_once(spark):
    emails = spark.createDataFrame([(1,), (2,), (3,), (4,), (None,)], "email_id long")
    emb = spark.createDataFrame([(1, [1., 2.]), (1, [0., 5.]), (2, [None, 1.]), (3, [float("nan"), 1.]), (None, [1., 1.]), (4, []), (9, [1.])],
                                "vec_id long, embedding array<double>")
    got = {r.email_id: r.embedding for r in E.join_embeddings(emails, emb).collect()}
    assert got == {1: [0., 5.], 2: None, 3: None, 4: None, None: None}


@pytest.mark.parametrize(("has", "reduced", "dims", "want"), [
    (True, True, 84, ("pca_bert", False)), (False, True, 84, ("rule_only", True)), (True, False, 40, ("rule_structural", False)),
    (False, False, 40, ("rule_structural", True)), (True, False, 70, ("rule_only", True)), (True, False, 84, ("rule_only", True)),
    (True, False, 818, ("bert_structural", False)), (False, False, 818, ("rule_structural", True)),
    (True, False, None, ("heuristic", False)), (False, False, None, ("heuristic", True))])
def test_modes(spark, has, reduced, dims, want):
    got = spark.range(1).select(E.feature_mode(F.lit(has), reduced, dims).alias("m")).first()["m"]
    assert tuple(got) == want


def test_vectors_are_padded_and_cut(rows):
    x = rows.withColumn("reduced", F.array(*[F.lit(float(i)) for i in range(4)])).limit(1)
    r = x.first()
    got = x.select(*[E.feature_vector(F.lit(m), n).alias(m) for m, n in
                     (("pca_bert", 24), ("rule_structural", 44), ("rule_only", 30), ("bert_structural", 62))]).first()
    assert got["pca_bert"] == [0., 1., 2., 3.] + r.rule_vector
    assert got["rule_structural"] == r.rule_vector + r.structural_vector[:20] + [0.] * 4
    assert got["rule_only"] == r.rule_vector + r.structural_vector[:10]
    assert r.embedding is None or got["bert_structural"] == r.embedding + r.structural_vector


def test_model_is_stored_whole_and_modes_follow_rows(spark, rows, tmp_path):
    model = E.fit(rows, components=3, num_trees=5, max_depth=3)
    assert model.dims == 23 and 0 < model.explained_variance <= 1
    # The reduction is fitted on rows with embeddings only.
    assert len(model.reduction.stages[0].mean) == DIM
    model.save(str(tmp_path / "m"))
    back = E.Model.load(spark, str(tmp_path / "m"))
    scores = [{r.email_id: (r.verdict, r.confidence, r.feature_mode, r.degraded_mode, r.method) for r in E.classify(rows, m).collect()} for m in (model, back)]
    assert scores[0] == scores[1]
    assert all(s[2:] == (("rule_only", True, "random_forest") if i % 5 == 0 else ("pca_bert", False, "random_forest")) for i, s in scores[0].items())
    right = sum((s[0] == "phishing") == (i % 2 == 1) for i, s in scores[0].items())
    assert right > 140
    plain = E.classify(E.without_embeddings(rows), back).select("feature_mode", "degraded_mode").distinct().collect()
    assert [tuple(r) for r in plain] == [("rule_only", True)]
    odd = rows.withColumn("embedding", F.slice("embedding", 1, 5))  # another length: as if there were none
    assert {r.feature_mode for r in E.classify(odd, back).select("feature_mode").distinct().collect()} == {"rule_only"}


def test_too_few_embeddings_give_a_degraded_model(rows):
    model = E.fit(rows, components=90, num_trees=3, max_depth=2)
    assert model.reduction is None and model.dims == 40
    got = {tuple(r) for r in E.classify(rows, model).select("feature_mode", "degraded_mode").distinct().collect()}
    assert got == {("rule_structural", True), ("rule_structural", False)}
    heuristic = E.classify(rows, None).select("method", "feature_mode", "degraded_mode").distinct().collect()
    assert {tuple(r) for r in heuristic} == {("heuristic", "heuristic", True), ("heuristic", "heuristic", False)}


def test_failing_rows_are_dropped_and_counted(spark, rows):
    bad = spark.createDataFrame([(900, None, [0.] * 20, [0.] * 50), (901, 2, [0.] * 20, [0.] * 50), (902, 1, None, [0.] * 50),
                                 (903, 1, [0.] * 19 + [float("nan")], [0.] * 50), (904, 0, [0.] * 20, [None] * 50)],
                                "email_id long, label int, rule_vector array<double>, structural_vector array<double>")
    kept, out = E.training_rows(rows.unionByName(bad, allowMissingColumns=True))
    assert kept.count() == 160
    assert {r.reason: r.n_rows for r in out.collect()} == {"label": 2, "rule_vector": 2, "structural_vector": 1}
