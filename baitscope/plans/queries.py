"""Registered queries: one per operator group, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or tables Spark derives from them) in
full.  Array-valued results are rendered as ``' | '``-joined strings so they
compare exactly against the DuckDB twins in ``baitscope.plans.oracle``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.operators import audit as A
from baitscope.operators import corpus as CO
from baitscope.operators import embeddings as E
from baitscope.operators import history as H
from baitscope.operators import metrics as M
from baitscope.operators import urls as U
from baitscope.operators.history_table import HistoryTable
from baitscope.operators.scoring import STRUCTURAL, EmailColumns, score_emails, semantic_stage, structural_stage
from baitscope.session import ensure_checkpoint_dir, table
from baitscope.sources import ocr as OCR
from baitscope.resources import lexicons as L
from baitscope.sources.fixtures import emails

c = F.col
SEP = " | "
CATS = [n for n, _ in L.CATEGORIES]


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored emails, as a plan: each query computes the columns that it reads."""
    # The header analysis adds a column of this name.
    rows = emails(spark, sf_dir).withColumnRenamed("x_mailer", "raw_mailer")
    return score_emails(rows, EmailColumns(x_mailer="raw_mailer")).drop("body_html", "raw_mailer")


def j(col) -> F.Column:
    return F.array_join(col if not isinstance(col, str) else c(col), SEP)


def verdict_summary(spark, sf_dir):
    """Flagship: emails per verdict and action with mean confidence."""
    return (scored(spark, sf_dir).groupBy("verdict", "recommended_action")
            .agg(F.count("*").alias("n_emails"), F.round(F.avg("confidence"), 4).alias("avg_confidence")))


def email_scores(spark, sf_dir):
    """CLS-01..03, CLS-12, FUS-05: component scores, confidence, verdict, action."""
    return scored(spark, sf_dir).select(
        "email_id", "label", "semantic_score", "url_count", "url_score", "header_score", "html_score",
        "structural_score", "confidence", "verdict", "recommended_action")


def semantic_matches(spark, sf_dir):
    """LEX-01..16."""
    s = scored(spark, sf_dir)
    cols = ["email_id"]
    for n in CATS:
        cols += [c(f"{n}_count"), c(f"{n}_score"), j(f"{n}_matches").alias(f"{n}_matches")]
    cols += [j("brand_mentions").alias("brand_mentions"), j("grammar_issues").alias("grammar_issues"),
             "grammar_score", "semantic_score", "dominant_category",
             j("semantic_details").alias("semantic_details")]
    return s.select(*cols)


def url_features(spark, sf_dir):
    """URL-01..17: one row per distinct URL of each email."""
    s = scored(spark, sf_dir).select("email_id", F.explode("urls").alias("u"))
    return s.select(
        "email_id", c("u.url").alias("url"), c("u.is_ip_based").alias("is_ip_based"),
        c("u.uses_shortener").alias("uses_shortener"), c("u.uses_free_hosting").alias("uses_free_hosting"),
        c("u.free_hosting_platform").alias("free_hosting_platform"),
        c("u.suspicious_tld").alias("suspicious_tld"), c("u.long_domain").alias("long_domain"),
        c("u.has_at_symbol").alias("has_at_symbol"), c("u.excessive_subdomains").alias("excessive_subdomains"),
        c("u.excessive_hyphens").alias("excessive_hyphens"), c("u.uses_https").alias("uses_https"),
        F.round(c("u.typosquatting_score"), 6).alias("typosquatting_score"),
        c("u.typosquatting_target").alias("typosquatting_target"),
        F.array_join(c("u.suspicious_path_keywords"), ", ").alias("path_keywords"),
        F.round(c("u.risk_score"), 6).alias("risk_score"))


def url_rollup(spark, sf_dir):
    """URL-18/19: per-email URL count, score and detail lines."""
    return scored(spark, sf_dir).select("email_id", "url_count", "url_score",
                                        j("url_details").alias("url_details"))


def header_features(spark, sf_dir):
    """PRJ-10..12, HDR-01..10."""
    return scored(spark, sf_dir).select(
        "email_id", "spf_result", "dkim_result", "dmarc_result", "from_email", "from_domain",
        "reply_to_email", "reply_to_mismatch", "display_name_mismatch", "brand_mismatch_keyword",
        "x_mailer_suspicious", "missing_message_id", "missing_date", "suspicious_received_chain",
        "received_hop_count", "header_score", j("header_details").alias("header_details"))


def html_features(spark, sf_dir):
    """HTM-01..09."""
    return scored(spark, sf_dir).select(
        "email_id", "hidden_element_count", "external_form_count", "tracking_pixel_count",
        "external_image_count", "iframe_count", "has_obfuscated_js", "base64_content_count",
        "html_score", j("html_details").alias("html_details"))


def explanations(spark, sf_dir):
    """CLS-03, EXP-01, EXP-02."""
    return scored(spark, sf_dir).select("email_id", "verdict", "confidence", "recommended_action",
                                        "action_description", "explanation", "education_note")


def threat_indicators(spark, sf_dir):
    """EXP-03 and FUS-06."""
    s = scored(spark, sf_dir)
    out = ["email_id"]
    for k in ["suspicious_urls", "urgency_language", "header_anomalies", "grammatical_anomalies", "html_suspicious"]:
        out += [c(f"threat_indicators.{k}.score").alias(f"{k}_score"),
                j(c(f"threat_indicators.{k}.details")).alias(f"{k}_details")]
    out += [j("structural_details").alias("structural_details")]
    return s.select(*out)


def indicator_flags(spark, sf_dir):
    """FUS-07: the 20 indicator flags."""
    return scored(spark, sf_dir).select("email_id", *L.INDICATOR_NAMES)


def feature_vector(spark, sf_dir):
    """FUS-01, FUS-02, FUS-03 (70-d rule + structural vector), one column per entry."""
    s = scored(spark, sf_dir).select("email_id", F.concat("rule_vector", "structural_vector").alias("v"))
    return s.select("email_id", *[F.round(c("v")[i], 6).alias(f"f{i:02d}") for i in range(70)])


def _preds(spark, sf_dir):
    return M.predictions(scored(spark, sf_dir))


def evaluation_metrics(spark, sf_dir):
    """AGG-05..09: confusion counts and derived metrics."""
    return M.evaluation_metrics(_preds(spark, sf_dir))


def roc_auc(spark, sf_dir):
    """AGG-10."""
    return M.roc_auc(_preds(spark, sf_dir))


def roc_curve(spark, sf_dir):
    """AGG-12."""
    return M.roc_curve(_preds(spark, sf_dir))


def indicator_fire_counts(spark, sf_dir):
    """AGG-13."""
    return M.indicator_fire_counts(_preds(spark, sf_dir))


def fn_by_category(spark, sf_dir):
    """AGG-14 (LEX-16 categories)."""
    return M.fn_by_category(_preds(spark, sf_dir))


def distributions(spark, sf_dir):
    """AGG-15."""
    return M.distributions(_preds(spark, sf_dir))


def run_summary(spark, sf_dir):
    """AGG-16/17: degraded is a row without an embedding."""
    return M.run_summary(M.predictions(_embedded(spark, sf_dir)))


def _embedded(spark, sf_dir):
    """JOI-08: emails with their embeddings (about half have one), scored."""
    rows = E.join_embeddings(emails(spark, sf_dir).withColumnRenamed("x_mailer", "raw_mailer"), table(spark, sf_dir, "embeddings"))
    return score_emails(rows, EmailColumns(x_mailer="raw_mailer")).drop("body_html", "raw_mailer")


#: Lengths of models that an email's vector is asked for: none, reduced, degraded, older, and with whole embeddings.
MODELS = {"heuristic": (False, None), "reduced": (True, 84), "degraded": (False, 40), "older": (False, 70), "padded": (False, 84), "whole": (False, 114)}


def embedding_modes(spark, sf_dir):
    """JOI-08, CLS-04, FUS-03: the mode of every email for each kind of model, and whether it is degraded."""
    rows = _embedded(spark, sf_dir).select("email_id", c("embedding").isNotNull().alias("has"))
    for name, (reduced, dims) in MODELS.items():
        rows = rows.withColumn(name, E.feature_mode(c("has"), reduced, dims))
    return rows.select("email_id", "has", *[c(f"{n}.{x}").alias(f"{n}_{x}") for n in MODELS for x in ("mode", "degraded")])


def mode_vectors(spark, sf_dir):
    """FUS-03, FUS-04: degraded vector (40), older vector cut to 60 and padded to 84, and embedding with structural features (114)."""
    rows = _embedded(spark, sf_dir).withColumn("reduced", F.lit(None).cast("array<double>"))

    def vec(name, dims):
        reduced, length = MODELS[name]
        return E.feature_vector(E.feature_mode(c("embedding").isNotNull(), reduced, length)["mode"], dims)

    def text(v):
        # Ten-thousandths as whole numbers, so that both engines write them alike.
        return F.array_join(F.transform(v, lambda x: F.round(x * 10000).cast("long").cast("string")), ",")

    return rows.select("email_id", text(vec("degraded", 40)).alias("degraded_40"), text(vec("older", 60)).alias("older_60"),
                       text(vec("padded", 84)).alias("older_84"), text(F.slice(vec("whole", 114), 1, 64)).alias("whole_head"),
                       text(F.slice(vec("whole", 114), 65, 50)).alias("whole_tail"))


def training_failures(spark, sf_dir):
    """CLS-13: rows whose label is not 0 or 1 are dropped from training and counted, among all rows."""
    rows = _stored(scored(spark, sf_dir).select("email_id", "label", "rule_vector", "structural_vector"), "training")
    rows = rows.withColumn("label", F.when(c("email_id") % 10 == 3, F.lit(2)).when(c("email_id") % 10 == 7, F.lit(None)).otherwise(c("label")))
    kept, left_out = E.training_rows(rows)
    return left_out.unionByName(kept.groupBy(F.lit("kept").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows")))


def _model_rows(spark, sf_dir):
    """What training, scoring and evaluation read, computed once."""
    return _stored(_embedded(spark, sf_dir).select(
        "email_id", "label", "rule_vector", "structural_vector", "embedding", "semantic_score", "url_score", "header_score", "html_score",
        "dominant_category", *L.INDICATOR_NAMES), "model-rows")


def _trained(rows, **options):
    """A model of the training split of (email_id, label, vectors, embedding)."""
    keyed = rows.select(c("email_id").alias("row_id"), "label", "rule_vector", "structural_vector", "embedding")
    return E.fit(CO.stratified_split(keyed).where("split = 'train'"), components=16, num_trees=50, max_depth=10, **options)


def embedding_model_scores(spark, sf_dir):
    """CLS-04/05/08, SNK-07 (rows-only): reduction and forest of the training split, stored, read back and applied to every email."""
    rows = _model_rows(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    _trained(rows).save(path)
    out = E.classify(rows, E.Model.load(spark, path))
    return out.select("email_id", "label", "method", "feature_mode", "degraded_mode", "verdict", "confidence", "recommended_action")


def mode_comparison(spark, sf_dir):
    """AGG-20 (rows-only): the model with embeddings against the pass without them."""
    rows = _model_rows(spark, sf_dir)
    model = _trained(rows)
    full, plain = (M.evaluation_metrics(M.predictions(E.classify(x, model))) for x in (rows, E.without_embeddings(rows)))
    return M.mode_comparison(full, plain, "full", "rule_only")


def _stored_preds(spark, sf_dir):
    """Label, prediction and score of every email, scored once for what reads them more than once."""
    return _stored(_preds(spark, sf_dir).select("label", "predicted_label", "roc_score"), "predictions")


def system_comparison(spark, sf_dir):
    """AGG-21."""
    p = _stored_preds(spark, sf_dir)
    return M.system_comparison(spark, M.evaluation_metrics(p), M.roc_auc(p))


def _corpora(spark, sf_dir):
    return CO.all_phishing_rule(CO.corpora(spark, sf_dir))


def corpus_breakdown(spark, sf_dir):
    """SRC-10, SET-01, AGG-01: per-corpus totals with a grand total row."""
    return CO.corpus_breakdown(_corpora(spark, sf_dir))


def corpus_dedup(spark, sf_dir):
    """SET-02: rows surviving exact-body dedup."""
    return CO.dedup_bodies(_corpora(spark, sf_dir)).select("row_id", "corpus", "label")


def stratified_split(spark, sf_dir):
    """SET-07 over the deduplicated corpus: rows per split and label."""
    sp = CO.stratified_split(CO.dedup_bodies(_corpora(spark, sf_dir)))
    return sp.groupBy("split", "label").agg(F.count("*").alias("n_rows"), F.sum("row_id").alias("id_sum"))


def balanced_sample(spark, sf_dir):
    """SET-04/05/08: balanced sample of 500 with top-up, and the remainder size."""
    corp = _corpora(spark, sf_dir)
    smp = CO.balanced_sample(corp, 500)
    rem = CO.remainder(corp, smp)
    return smp.select("row_id", "label", F.lit("sample").alias("part")).unionByName(
        rem.select("row_id", "label", F.lit("remainder").alias("part")))


# FIXED VALUES (test input): folders and file names of a derived path column.
FOLDERS = ["easy_ham", "spam_2", "phishing_corpus", "Legit-Mail", "nazario", "inbox", "misc", "SAFE_box", "nigerian419", ""]


def path_labels(spark, sf_dir):
    """SRC-06, SRC-07, SRC-08: labels by first folder, by whole name and by any component of a derived path."""
    from baitscope.sources import files as FI
    from baitscope.sources.fixtures import _pick
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    folder = _pick(FOLDERS, c("doc_id"))
    name = F.concat(F.coalesce(c("source"), F.lit("x")), F.lit("/"), F.when(c("doc_id") % 7 == 0, "Inbox/").otherwise(""),
                    c("doc_id").cast("string"), F.lit(".eml"))
    path = F.when(folder == "", F.concat(c("doc_id").cast("string"), F.lit(".eml"))).otherwise(F.concat(folder, F.lit("/"), name))
    return d.select("doc_id", path.alias("path"), FI.folder_label(path).alias("folder_label"),
                    FI.folder_label(path, True).alias("flat_label"), FI.archive_label(path).alias("archive_label"),
                    FI.component_label(path).alias("component_label"))


def corpus_chain(spark, sf_dir):
    """SET-01, SRC-10, SET-02, SET-07: corpora stacked by name from their parts, relabelled, deduplicated and split."""
    rows = CO.corpora(spark, sf_dir)
    parts = [rows.where(c("corpus") == n) for n in CO.CORPORA]
    # The parts differ in their columns, as files do; the union fills the gaps.
    parts[0] = parts[0].drop("subject")
    whole = CO.all_phishing_rule(CO.union_corpora(parts))
    return CO.stratified_split(CO.dedup_bodies(whole)).select("row_id", "corpus", "label", "split", (c("subject").isNull()).alias("no_subject"))


def small_sample(spark, sf_dir):
    """SET-04/05/06: a request above what one class holds (top-up), and one from a single class."""
    corp = _corpora(spark, sf_dir)
    n = corp.count()
    one = corp.where("label = 1")
    return (CO.balanced_sample(corp, n - 10).select("row_id", F.lit("top_up").alias("part"))
            .union(CO.balanced_sample(one, 60, top_up=False).select("row_id", F.lit("single").alias("part"))))


def class_weights(spark, sf_dir):
    """CLS-06, CLS-11: balanced weights by label, and the training gate."""
    from baitscope.operators import ml as ML
    rows = emails(spark, sf_dir).select("email_id", "label")
    gate = ML.training_gate(rows, 10)
    return (ML.class_weights(rows).groupBy("label").agg(F.count("*").alias("n"), F.round(F.first("weight"), 6).alias("weight"))
            .withColumn("gate", F.lit(gate["success"])))


def _stored(df, name):
    """The rows as a table of their own, for what is read several times."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _history_table(spark, sf_dir):
    """SNK-01, WIN-06: the scans of even emails appended first, then those of odd ones."""
    rows = _stored(_history(spark, sf_dir).withColumnRenamed("id", "email_id").select(
        "email_id", "timestamp", "verdict", "confidence", "recommended_action", "analysis_time_seconds"), "scans")
    history = HistoryTable(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/history-{uuid.uuid4().hex}")
    for batch in (0, 1):
        history.append(rows.where(c("email_id") % 2 == batch), batch)
    return history


def history_appended(spark, sf_dir):
    """SNK-01, WIN-06: surrogate ids after two appends."""
    return _history_table(spark, sf_dir).read().select("id", "email_id", "verdict", "confidence", "recommended_action")


def scan_lookup(spark, sf_dir):
    """ORD-02, ORD-03, ORD-01: two scans by id after one of them is deleted, the newest three, and the number of scans left."""
    history = _history_table(spark, sf_dir)
    history.delete(17)
    left = history.read().agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("id"), F.lit("left").alias("verdict"), "n")
    one = F.lit(1).cast("long").alias("n")
    found = history.lookup(17).unionByName(history.lookup(18)).select("id", "verdict", one)
    return found.union(history.page(3).select("id", "verdict", (one + 1).alias("n"))).union(left)


def scan_throughput(spark, sf_dir):
    """AGG-18 (rows-only): seconds and rate of each appended batch."""
    return _history_table(spark, sf_dir).throughput()


def _history(spark, sf_dir):
    return H.scan_records(scored(spark, sf_dir))


def scan_kpi(spark, sf_dir):
    """SNK-01, AGG-02/03: history KPIs, indicator means read back from JSON."""
    return H.scan_kpi(_history(spark, sf_dir))


def history_page(spark, sf_dir):
    """ORD-01/04: newest 20 scans after skipping 10."""
    return H.history_page(_history(spark, sf_dir), 20, 10).select("id", "verdict", "confidence", "recommended_action")


def history_export(spark, sf_dir):
    """SNK-04 (ORD-03 applied first: scan 0 deleted)."""
    return H.export_history(H.delete_scan(_history(spark, sf_dir), 0))


def training_counts(spark, sf_dir):
    """SNK-02, SRC-18, AGG-04."""
    return H.training_counts(H.load_training_samples(H.training_samples(scored(spark, sf_dir))))


def label_audit(spark, sf_dir):
    """STR-02 batch form (WIN-02, JOI-06/07): audit totals."""
    return A.audit_summary(A.audit_labels(A.label_submissions(spark, sf_dir)))


def label_audit_by_user(spark, sf_dir):
    """STR-02 keyed by plain user_id: per-row audit flags."""
    a = A.audit_labels(A.label_submissions(spark, sf_dir, key="user_id"))
    return a.select("id", "suspicious_flagged", "held", "confirmed_at_insert", "confirmed")


def rate_violations(spark, sf_dir):
    """STR-03 batch form: requests per client, kind and minute vs limits."""
    r = A.rate_counts(A.requests(spark, sf_dir))
    return r.select("client", "kind", F.date_format("minute_start", "yyyy-MM-dd HH:mm:ss").alias("minute_start"),
                    "n_requests", c("limit").alias("max_per_minute"), "violation")


# FIXED VALUES (test input): raw label spellings assigned to documents by id.
RAW_LABELS = ["1", "0", "spam", "ham", "phishing", "legit", "Phishing Email", "Safe Email", "1.0", "0.0",
              "2", "abc", " phish ", "Not Phishing", "SAFE", "legitimate", "0.5", "-1", "", "Spam"]


def label_normalize(spark, sf_dir):
    """PRJ-07a/b over raw label strings assigned to documents."""
    from baitscope.functions.text import normalize_label_loose, normalize_label_strict
    from baitscope.sources.fixtures import _pick
    d = table(spark, sf_dir, "documents").select("doc_id")
    raw = _pick(RAW_LABELS, c("doc_id"))
    return d.select("doc_id", raw.alias("raw_label"), normalize_label_strict(raw).alias("label_strict"),
                    normalize_label_loose(raw).alias("label_loose"))


def text_input_parse(spark, sf_dir):
    """PRJ-02..05/08: pages as text input (HTML bodies detected and stripped),
    plus the corpus stripper (PRJ-03)."""
    from baitscope.functions.html import strip_html_corpus
    from baitscope.functions.text import parse_text_input
    p = table(spark, sf_dir, "pages")
    subj = F.when(c("page_id") % 5 == 0, F.lit("")).otherwise(c("url"))
    parsed = parse_text_input(subj, c("html"), normalize=False)
    return p.select("page_id", parsed["subject"].alias("subject"), parsed["body_text"].alias("body_text"),
                    (parsed["body_html"] != "").alias("has_html"), parsed["parse_error"].alias("parse_error"),
                    strip_html_corpus(c("html")).alias("corpus_text"))


def url_tokens(spark, sf_dir):
    """URL-22 over every page URL."""
    t = U.url_tokens(table(spark, sf_dir, "pages").select("page_id", "url"))
    return t.select("page_id", "url", F.array_join(F.transform("tokens", lambda x: x.cast("string")), ",").alias("tokens"))


def url_blend(spark, sf_dir):
    """URL-03b, URL-20, JOI-05: model-score blend per email."""
    e = emails(spark, sf_dir)
    rows = U.model_url_rows(e)
    return U.blend_url_scores(rows, U.derived_model_scores(rows), U.analyzed_rows(e))


def url_training_pairs(spark, sf_dir):
    """URL-21: (url, label) for every URL in every email body."""
    e = emails(spark, sf_dir).select(c("body_text").alias("body"), "label")
    return U.url_training_pairs(e)


def ocr_confidence(spark, sf_dir):
    """SRC-16 over OCR words derived from documents."""
    return OCR.ocr_confidence(OCR.ocr_words(spark, sf_dir))


def ocr_subject(spark, sf_dir):
    """SRC-17: subject line from OCR text lines."""
    return OCR.ocr_subject(OCR.ocr_lines(OCR.ocr_words(spark, sf_dir)))


def bootstrap_ci(spark, sf_dir):
    """AGG-11 (rows-only): Poisson bootstrap intervals, 1000 replicates."""
    return M.bootstrap_ci(_stored_preds(spark, sf_dir), 1000)


def _embedding_training(spark, sf_dir):
    from baitscope.operators import ml as ML
    emb = table(spark, sf_dir, "embeddings").select(
        c("vec_id").alias("row_id"), F.transform("embedding", lambda x: x.cast("double")).alias("emb"),
        (c("label") >= 5).cast("int").alias("label"))
    pca, _ = ML.fit_pca(emb, "emb", 16)
    return pca.transform(ML.to_vector(emb, "emb", "_v")).select("row_id", "label", c("pca").alias("features"))


def forest_cross_validation(spark, sf_dir):
    """CLS-05/06/08/10/11 (rows-only): PCA-16 embeddings, weighted forest, 5 stratified folds."""
    from baitscope.operators import ml as ML
    x = _embedding_training(spark, sf_dir)
    if not ML.training_gate(x, 10)["success"]:
        raise ValueError("training gate failed")
    return ML.cross_validate(x, k=5, num_trees=50, max_depth=10)


def email_model_scores(spark, sf_dir):
    """CLS-04/05/09/13 (rows-only): forest on the 70-d email feature vector
    (train split), applied to every email with the heuristic as fallback."""
    from baitscope.operators import ml as ML
    s = _stored(scored(spark, sf_dir).select("email_id", "label", F.concat("rule_vector", "structural_vector").alias("features")), "email-rows")
    train = CO.stratified_split(s.select(c("email_id").alias("row_id"), "label", "features")).filter(c("split") == "train")
    # The fit reads its rows several times: split and weights are made once.
    train = _stored(ML.class_weights(train), "email-training")
    s = ML.to_vector(s, "features", "features")
    model = ML.forest(num_trees=50, max_depth=10).fit(ML.to_vector(train, "features", "features"))
    out = ML.classify_with_model(s.select("email_id", "label", "features"), model)
    return out.select("email_id", "label", "method", "model_verdict", "model_confidence", "model_action")


def url_model_eval(spark, sf_dir):
    """URL-21/23 (rows-only): n-gram URL model, test-split metrics."""
    from baitscope.operators import ml as ML
    e = emails(spark, sf_dir).select("email_id", c("body_text").alias("body"), "label")
    # Fit and test read the pairs; a coalesce over the texts themselves would cut them in few tasks.
    _, m = ML.train_url_model(_stored(U.url_training_pairs(e), "url-pairs"))
    return m


def adversarial_evaluation(spark, sf_dir):
    """AGG-22 (rows-only): signal-stripping variants of the given emails
    (subject removed, HTML removed, header block removed) against the baseline."""
    # What a variant does not change is analyzed once for all, and only the small results of the analyses are stored.
    cols = EmailColumns(x_mailer="raw_mailer")
    e = emails(spark, sf_dir).withColumnRenamed("x_mailer", "raw_mailer")
    made = {"semantic": semantic_stage(e)} | {x: structural_stage(e, cols, parts=(x,)) for x in STRUCTURAL}
    made = {x: [n for n in df.columns if n not in e.columns] for x, df in made.items()}

    def pack(df, variant, names):
        given = [n for x in names for n in made[x]]
        return df.select("*", *[F.struct(*made[x]).alias(f"{x}_{variant}") for x in names]).drop(*given)

    rows = pack(structural_stage(semantic_stage(e), cols), "base", list(made))
    rows = pack(semantic_stage(rows.withColumn("subject", F.lit(""))), "no_subject", ["semantic"])
    rows = pack(structural_stage(rows.withColumn("body_html", F.lit("")), cols, parts=("urls", "html")), "no_html", ["urls", "html"])
    rows = pack(structural_stage(rows.withColumn("received_hops", F.lit(None).cast("int")), cols, parts=("headers",)), "no_headers", ["headers"])
    changed = {"no_subject": ["semantic"], "no_html": ["urls", "html"], "no_headers": ["headers"]}
    rows = _stored(rows.select("email_id", "label", *[f"{x}_{v}" for v, names in [("base", made), *changed.items()] for x in names]), "analyzed")

    def predicted(name, names):
        analyses = [f"{x}_{name}.*" if x in names else f"{x}_base.*" for x in made]
        return M.predictions(score_emails(rows.select("email_id", "label", *analyses), analyzed=True))

    parts = [predicted(name, names).select("email_id", F.lit(name).alias("technique"), "predicted_label") for name, names in changed.items()]
    return M.adversarial_evaluation(predicted("base", []), CO.union_corpora(parts))


def indicator_model_accuracy(spark, sf_dir):
    """CLS-07, AGG-19 (rows-only): 20 indicator forests on the 70-d vector,
    per-indicator agreement with the rule flags."""
    from baitscope.operators import ml as ML
    # Scored once: every fit and the prediction read the stored rows.
    rows = _stored(scored(spark, sf_dir).select("email_id", F.concat("rule_vector", "structural_vector").alias("fv"), *L.INDICATOR_NAMES), "indicator-rows")
    base = ML.to_vector(rows, "fv", "features").drop("fv")
    models = ML.fit_indicator_models(base, num_trees=20, max_depth=8)
    pred = ML.predict_indicators(base, models)
    pf = pred.select("email_id", *[c(f"pred_{n}").alias(n) for n in L.INDICATOR_NAMES])
    return M.per_indicator_accuracy(pf, base.select("email_id", *L.INDICATOR_NAMES))


QUERIES = {
    "verdict_summary": verdict_summary,
    "email_scores": email_scores,
    "semantic_matches": semantic_matches,
    "url_features": url_features,
    "url_rollup": url_rollup,
    "header_features": header_features,
    "html_features": html_features,
    "explanations": explanations,
    "threat_indicators": threat_indicators,
    "indicator_flags": indicator_flags,
    "feature_vector": feature_vector,
    "evaluation_metrics": evaluation_metrics,
    "roc_auc": roc_auc,
    "roc_curve": roc_curve,
    "indicator_fire_counts": indicator_fire_counts,
    "fn_by_category": fn_by_category,
    "distributions": distributions,
    "run_summary": run_summary,
    "embedding_modes": embedding_modes,
    "mode_vectors": mode_vectors,
    "training_failures": training_failures,
    "embedding_model_scores": embedding_model_scores,
    "mode_comparison": mode_comparison,
    "system_comparison": system_comparison,
    "corpus_breakdown": corpus_breakdown,
    "corpus_dedup": corpus_dedup,
    "stratified_split": stratified_split,
    "balanced_sample": balanced_sample,
    "small_sample": small_sample,
    "corpus_chain": corpus_chain,
    "path_labels": path_labels,
    "class_weights": class_weights,
    "scan_lookup": scan_lookup,
    "history_appended": history_appended,
    "scan_throughput": scan_throughput,
    "scan_kpi": scan_kpi,
    "history_page": history_page,
    "history_export": history_export,
    "training_counts": training_counts,
    "label_audit": label_audit,
    "label_audit_by_user": label_audit_by_user,
    "rate_violations": rate_violations,
    "label_normalize": label_normalize,
    "text_input_parse": text_input_parse,
    "url_tokens": url_tokens,
    "url_blend": url_blend,
    "url_training_pairs": url_training_pairs,
    "ocr_confidence": ocr_confidence,
    "ocr_subject": ocr_subject,
    "bootstrap_ci": bootstrap_ci,
    "forest_cross_validation": forest_cross_validation,
    "email_model_scores": email_model_scores,
    "url_model_eval": url_model_eval,
    "adversarial_evaluation": adversarial_evaluation,
    "indicator_model_accuracy": indicator_model_accuracy,
}
