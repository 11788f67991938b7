"""Plan shape guards: scoring adds no shuffle and pruning reaches the scan."""

from pyspark.sql import functions as F

from baitscope.operators.scoring import score_emails


def test_scoring_has_no_exchange(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = docs.select(F.col("doc_id").alias("email_id"), F.lit("").alias("subject"), F.col("text").alias("body_text"))
    plan = score_emails(df).select("email_id", "verdict")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def _scans(df, name):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("ReadSchema:")[-1] for line in plan.split("\n") if name in line]


def test_headers_prune_text(spark):
    from baitscope.sources.fixtures import emails
    df = score_emails(emails(spark, "/root/testdata/sf0.001")).select("email_id", "header_score", "x_mailer_suspicious")
    scans = _scans(df, "documents.parquet")
    assert scans and all("text" not in s for s in scans)


def test_queries_prune_what_they_do_not_read(spark):
    import __spark_entry__ as E
    df = E.queries()["header_features"](spark, "/root/testdata/sf0.001")
    scans = _scans(df, "documents.parquet")
    assert scans and all("text" not in s for s in scans)
    assert "ArrowEvalPython" not in df._jdf.queryExecution().executedPlan().toString()


def test_phrases_are_found_once(spark):
    """One pass of the automaton, also with columns of several lists."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = score_emails(docs.select(F.col("doc_id").alias("email_id"), F.lit("").alias("subject"), F.col("text").alias("body_text")))
    plan = df.select("email_id", "verdict", "explanation", "urgency_matches")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_building_queries_over_scores_starts_no_job(spark):
    import __spark_entry__ as E
    sc = spark.sparkContext
    sc.setJobGroup("build-only", "building queries")
    for name in ("verdict_summary", "email_scores", "scan_kpi", "evaluation_metrics", "roc_auc", "history_export"):
        E.queries()[name](spark, "/root/testdata/sf0.001")
    jobs = list(sc.statusTracker().getJobIdsForGroup("build-only"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    # Spark reads a file's footer in a job of its own for the schema of each table; nothing else runs.
    assert all(len(sc.statusTracker().getJobInfo(i).stageIds) == 1 for i in jobs) and len(jobs) <= 12


def test_scores_follow_their_input(spark, tmp_path):
    import __spark_entry__ as E
    for name in ("documents", "pages"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    count = lambda: E.queries()["verdict_summary"](spark, str(tmp_path)).agg(F.sum("n_emails")).first()[0]
    whole = count()
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 10").write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert (whole, count()) == (200, 10)


def test_building_a_score_plan_starts_no_job(spark):
    from baitscope.sources.fixtures import emails
    sc = spark.sparkContext
    rows = emails(spark, "/root/testdata/sf0.001")  # reads the files' schemas
    sc.setJobGroup("plan-only", "building a plan")
    df = score_emails(rows)
    assert "verdict" in df.columns
    assert list(sc.statusTracker().getJobIdsForGroup("plan-only")) == []
    plan = df.select("email_id", "verdict")._jdf.queryExecution().executedPlan().toString()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert "RoundRobin" not in plan


def test_export_reads_all_rows(spark):
    import __spark_entry__ as E
    plan = E.queries()["history_export"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Limit" not in plan and "Sort" not in plan
