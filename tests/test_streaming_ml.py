"""Streaming jobs agree with their batch forms; ML operators run end to end."""

import os
import tempfile

from pyspark.sql import functions as F

from baitscope.operators import audit as A
from baitscope.streaming import jobs as J

SF = "/root/testdata/sf0.001"


def _scratch(prefix):
    return tempfile.mkdtemp(prefix=prefix, dir="/tmp")


def _later(path, seconds):
    """File streams take older files first."""
    for d, _, names in os.walk(path):
        for x in names:
            t = os.path.getmtime(os.path.join(d, x)) + seconds
            os.utime(os.path.join(d, x), (t, t))


def _audited(df):
    return sorted(tuple(r) for r in df.select("id", "suspicious_flagged", "held", "confirmed_at_insert", "confirmed").collect())


def test_quarantine_stream_matches_batch_and_replay(spark):
    subs = A.label_submissions(spark, SF).withColumnRenamed("_conf", "confidence_raw")
    d = _scratch("subs-")
    times = sorted(r.timestamp for r in subs.select("timestamp").collect())
    middle = times[len(times) // 2]
    subs.filter(F.col("timestamp") < F.lit(middle)).coalesce(1).write.parquet(os.path.join(d, "in", "p0"))
    subs.filter(F.col("timestamp") >= F.lit(middle)).coalesce(1).write.parquet(os.path.join(d, "in", "p1"))
    _later(os.path.join(d, "in", "p1"), 60)
    out, state = os.path.join(d, "out"), os.path.join(d, "state")
    want = _audited(A.audit_labels(subs.withColumnRenamed("confidence_raw", "_conf")))
    # The second run has a new checkpoint, so it replays batches 0 and 1 over the written state.
    for run in ("first", "replay"):
        J.quarantine_stream(spark, os.path.join(d, "in", "*"), subs.schema, out, state,
                            name=f"q{run}{os.getpid()}", max_files=1).awaitTermination()
        got = spark.read.parquet(out)
        assert got.select("batch_id").distinct().count() == 2
        assert _audited(J.confirmed_labels(got)) == want


def test_held_stream_keyed_state(spark):
    subs = A.label_submissions(spark, SF).withColumnRenamed("_conf", "confidence_raw")
    d = _scratch("held-")
    q = [r.timestamp for r in subs.orderBy("timestamp").select("timestamp").collect()]
    cuts = [q[0], q[len(q) // 3], q[2 * len(q) // 3], None]
    for k in range(3):
        part = subs.filter(F.col("timestamp") >= F.lit(cuts[k]))
        part = part if cuts[k + 1] is None else part.filter(F.col("timestamp") < F.lit(cuts[k + 1]))
        part.coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))
        _later(os.path.join(d, "in", f"p{k}"), 60 * k)

    def run(out, name, **more):
        J.held_stream(spark, os.path.join(d, "in", "*"), subs.schema, os.path.join(d, out), f"{name}{os.getpid()}",
                      max_files=1, **more).awaitTermination()
        return spark.read.parquet(os.path.join(d, out))

    held = run("out", "held")
    want = A.audit_labels(subs.withColumnRenamed("confidence_raw", "_conf"))
    assert _audited(J.confirmed_labels(J.audited_labels(subs, held))) == _audited(want)
    # A second run of the same stream finds nothing new; a run from nothing (a replay) gives the same rows.
    n = held.count()
    assert n == want.filter("held").count() > 0 and run("out", "held").count() == n
    assert sorted(map(tuple, run("again", "heldagain").collect())) == sorted(map(tuple, held.collect()))
    # Without the stream's rows all flagged submissions are pending, none is confirmed.
    bare = J.audited_labels(subs, held.limit(0))
    assert bare.filter("confirmed_at_insert OR held").count() == 0 and bare.filter("pending").count() == bare.filter("suspicious_flagged").count()


def test_held_stream_expiry(spark):
    d = _scratch("expire-")
    schema = "id long, timestamp timestamp, body_hash string, submitted_label int, confidence_raw double"

    def add(k):
        spark.sql(f"SELECT {k}L AS id, timestamp'2024-01-01' AS timestamp, 'h' AS body_hash, 0 AS submitted_label, "
                  "CAST(0.9 AS DOUBLE) AS confidence_raw").coalesce(1).write.parquet(os.path.join(d, "in", f"p{k}"))

    def held(out, expiry):
        J.held_stream(spark, os.path.join(d, "in", "*"), schema, os.path.join(d, out), f"{out}{os.getpid()}",
                      expiry_ms=expiry).awaitTermination()
        return sorted(r.id for r in spark.read.parquet(os.path.join(d, out)).collect())

    add(1)
    assert held("short", 1) == [1] and held("long", 3_600_000) == [1]
    # A batch with other rows lets the short one expire; the next submission of the hash is held anew.
    spark.sql("SELECT 5L AS id, timestamp'2024-01-01' AS timestamp, 'other' AS body_hash, 0 AS submitted_label, "
              "CAST(0.9 AS DOUBLE) AS confidence_raw").coalesce(1).write.parquet(os.path.join(d, "in", "p5"))
    assert held("short", 1) == [1, 5] and held("long", 3_600_000) == [1, 5]
    add(7)
    assert held("short", 1) == [1, 5, 7] and held("long", 3_600_000) == [1, 5]


def test_rate_stream_matches_batch(spark):
    reqs = A.requests(spark, SF)
    d = _scratch("req-")
    # A far later request closes every window before it.
    last = reqs.agg(F.max("event_id").alias("event_id"), F.max("ts").alias("ts")).select(
        "event_id", (F.col("ts") + F.expr("interval 1 day")).alias("ts"), F.lit(0).cast("long").alias("client"), F.lit("analyse").alias("kind"))
    reqs.union(last.select(*[F.col(f.name).cast(f.dataType) for f in reqs.schema])).write.parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    J.rate_limit_stream(spark, os.path.join(d, "in"), reqs.schema, out, f"rate{os.getpid()}",
                        analyse_limit=1, train_limit=1).awaitTermination()
    got = spark.read.parquet(out).select("client", "kind", "n_requests").collect()
    want = A.rate_counts(reqs, 1, 1).filter("violation").select("client", "kind", "n_requests").collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_kpi_stream(spark):
    from baitscope.operators.history import scan_kpi, scan_records
    from baitscope.plans.queries import scored
    d = _scratch("hist-")
    scan_records(scored(spark, SF)).write.parquet(os.path.join(d, "in"))
    hist = spark.read.parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    J.kpi_stream(spark, os.path.join(d, "in"), hist.schema, out, f"kpi{os.getpid()}").awaitTermination()
    want = scan_kpi(hist).first().asDict()
    assert J.latest_kpi(spark, out).first().asDict() == want
    # A newer version is being written beside it: readers see whole versions only, and the newest of them.
    row = spark.read.parquet(out).withColumn("total_analyzed", F.lit(0).cast("long"))
    J._by_batch(row.withColumn("batch_id", F.lit(7).cast("long")), out)
    J._by_batch(row.withColumn("batch_id", F.lit(7).cast("long")), out)
    assert [r.total_analyzed for r in J.latest_kpi(spark, out).collect()] == [0] and spark.read.parquet(out).count() == 2


def test_retrain_trigger_keeps_counts(spark):
    """Ready only with enough samples of both classes; counts are carried from batch to batch and over a restart."""
    import time
    d, name, ready = os.path.join(_scratch("retrain-"), "in"), f"retrain{os.getpid()}", []
    schema = "id long, label int"

    def add(labels):
        spark.createDataFrame([(i, x) for i, x in enumerate(labels)], schema).coalesce(1).write.mode("append").parquet(d)
        time.sleep(1.1)

    def drain():
        J.retrain_trigger_stream(spark, d, spark.read.schema(schema).parquet(d).schema, lambda s: ready.append(s.count()), 6, name, max_files=1).awaitTermination()

    add([0, 0, 0, None])
    add([0, 0, 0])
    drain()
    assert ready == []
    add([1])
    drain()
    assert ready == [8]
    add([1, 0])
    add([0])
    drain()
    assert ready == [8, 11, 11]


def test_times_beyond_int(spark):
    from baitscope.sources.fixtures import received_at
    r = spark.createDataFrame([(3_000_000_000,)], "id long").select(received_at(F.col("id")).alias("t")).first()
    assert r.t.year >= 2024


def test_forest_cv_and_pca(spark):
    from baitscope.operators import ml as ML
    from baitscope.session import table
    emb = table(spark, SF, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                F.transform("embedding", lambda x: x.cast("double")).alias("emb"),
                                                (F.col("label") >= 5).cast("int").alias("label"))
    model, var = ML.fit_pca(emb, "emb", 8)
    assert model is not None and 0 < var <= 1.0
    x = model.transform(ML.to_vector(emb, "emb", "_v")).withColumnRenamed("pca", "features")
    assert ML.training_gate(x, 10)["success"]
    per_fold = ML.cross_validate(x.select("row_id", "label", "features"), k=3, num_trees=10, max_depth=5)
    s = ML.cv_summary(per_fold).first()
    assert 0 <= s.f1_mean <= 1


def test_url_model(spark):
    from baitscope.operators import ml as ML
    from baitscope.operators import urls as U
    from baitscope.sources.fixtures import emails
    pairs = U.url_training_pairs(emails(spark, SF).select(F.col("body_text").alias("body"), "label"))
    model, m = ML.train_url_model(pairs)
    scored = ML.score_urls(model, pairs.select("url").distinct())
    assert scored.filter(~F.col("probability").between(0, 1)).count() == 0


def test_scoring_stream_matches_batch(spark):
    from baitscope.operators.history import scan_records
    from baitscope.operators.scoring import score_emails
    from baitscope.sources.fixtures import emails
    e = emails(spark, SF)
    d = _scratch("emails-")
    e.write.parquet(os.path.join(d, "in"))
    out = os.path.join(d, "out")
    q = J.scoring_stream(spark, os.path.join(d, "in"), e.schema, out, name=f"score{os.getpid()}")
    q.awaitTermination()
    got = spark.read.parquet(out).select("id", "verdict", "confidence")
    want = scan_records(score_emails(e)).select("id", "verdict", "confidence")
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_brand_keyword_table(spark):
    from baitscope.resources.brands import brand_keywords
    from baitscope.sources.brands import brand_table, keyword_table
    got = {r.keyword: (list(r.domains), r.brand_ordinal) for r in keyword_table(brand_table(spark)).collect()}
    want = {kw: doms for _, kw, doms in brand_keywords()}
    assert set(got) == set(want)
    assert all(got[k][0] == want[k] for k in want)


def test_bootstrap_brackets_point_estimates(spark):
    from baitscope.operators import metrics as M
    from baitscope.plans.queries import scored
    p = M.predictions(scored(spark, SF)).cache()
    point = M.evaluation_metrics(p).first()
    auc = M.roc_auc(p).first().roc_auc
    ci = {r.metric: (r.ci_low, r.ci_high) for r in M.bootstrap_ci(p, 200).collect()}
    for k, v in [("accuracy", point.accuracy), ("macro_f1", point.macro_f1), ("fpr", point.fpr),
                 ("fnr", point.fnr), ("roc_auc", auc)]:
        lo, hi = ci[k]
        assert lo <= v + 0.02 and v - 0.02 <= hi, (k, lo, v, hi)


def test_model_url_list_duplicates(spark):
    from baitscope.functions.urls import extract_urls_model
    df = spark.createDataFrame([("a http://x.io/p b http://x.io/p", ""),
                                ("a http://x.io/p b http://x.io/p", '<a href="http://y.io">y</a>')],
                               "body string, html string")
    out = [r[0] for r in df.select(extract_urls_model(F.col("body"), F.col("html"))).collect()]
    assert out[0] == ["http://x.io/p", "http://x.io/p"]
    assert sorted(out[1]) == ["http://x.io/p", "http://y.io"]
