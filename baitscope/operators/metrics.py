"""Evaluation metrics as aggregations (AGG-05 .. AGG-21).

Predictions first collapse to tiny tables (four confusion cells, or one row
per distinct score and label), so every metric is a global aggregate over a
bounded input: partial aggregation runs map-side and only a handful of rows
reach the final aggregate, whatever the number of predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.resources import lexicons as L

c = F.col


def predictions(scored: DataFrame) -> DataFrame:
    """Prediction rows: predicted_label = 1 only for a phishing verdict
    (suspicious and errors count as 0)."""
    return scored.select(
        "email_id", "label", "verdict", "confidence", "method", "feature_mode", "degraded_mode",
        "dominant_category", *L.INDICATOR_NAMES,
        F.when(c("verdict") == "phishing", 1).otherwise(0).alias("predicted_label"),
        c("confidence").alias("roc_score"),
        F.lit(None).cast("string").alias("error"),
    )


def confusion(preds: DataFrame) -> DataFrame:
    """AGG-05: tp, tn, fp, fn in one pass."""
    y, p = c("label"), c("predicted_label")
    return preds.agg(
        F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
        F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"),
    )


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(dbl(0.0))


def metrics_from_counts(cm: DataFrame) -> DataFrame:
    """AGG-06 .. AGG-09 from confusion counts (columns tp, tn, fp, fn)."""
    tp, tn, fp, fn = [c(x).cast("double") for x in ("tp", "tn", "fp", "fn")]
    n = tp + tn + fp + fn
    p_ph, r_ph = _div(tp, tp + fp), _div(tp, tp + fn)
    f_ph = _div(2 * tp, 2 * tp + fp + fn)
    p_lg, r_lg = _div(tn, tn + fn), _div(tn, tn + fp)
    f_lg = _div(2 * p_lg * r_lg, p_lg + r_lg)
    f_lg_macro = _div(2 * tn, 2 * tn + fn + fp)
    po = _div(tp + tn, n)
    pe = _div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), n * n)
    kappa = _div(po - pe, dbl(1.0) - pe)
    r4 = lambda x: F.round(x, 4)
    return cm.select(
        n.cast("long").alias("n_total"), (tp + fn).cast("long").alias("n_phishing"),
        (tn + fp).cast("long").alias("n_legit"),
        "tp", "tn", "fp", "fn",
        r4(po).alias("accuracy"),
        r4((p_ph + p_lg) / 2).alias("macro_precision"), r4((r_ph + r_lg) / 2).alias("macro_recall"),
        r4((f_ph + f_lg_macro) / 2).alias("macro_f1"),
        r4(_div(f_ph * (tp + fn) + f_lg_macro * (tn + fp), n)).alias("weighted_f1"),
        r4(_div(fp, fp + tn)).alias("fpr"), r4(_div(fn, fn + tp)).alias("fnr"),
        r4(kappa).alias("cohen_kappa"),
        r4(p_ph).alias("phishing_precision"), r4(r_ph).alias("phishing_recall"), r4(f_ph).alias("phishing_f1"),
        r4(p_lg).alias("legit_precision"), r4(r_lg).alias("legit_recall"), r4(f_lg).alias("legit_f1"),
    )


def evaluation_metrics(preds: DataFrame) -> DataFrame:
    return metrics_from_counts(confusion(preds))


def score_label_counts(preds: DataFrame, score: str = "roc_score") -> DataFrame:
    """One row per distinct score: positives and negatives at that score."""
    return preds.groupBy(c(score).alias("score")).agg(
        F.count_if(c("label") == 1).alias("pos"), F.count_if(c("label") == 0).alias("neg"))


#: Scores of one cell lie within one part in so many of a unit.
SCORE_CELLS = 4096


def _cell() -> F.Column:
    """The cell of neighbouring scores that a score lies in, in score order."""
    return F.when(F.isnan("score"), F.lit(1 << 53)).otherwise(F.floor(c("score") * SCORE_CELLS).cast("long"))


def _with_counts_before(g: DataFrame, descending: bool) -> DataFrame:
    """Rows (score, pos, neg) with the counts before each in score order (pos_before, neg_before) and in all (P, N).

    Sums run inside cells of neighbouring scores, on top of the sums of the
    cells before; the one window over all of them sees a row for each cell
    (about ``SCORE_CELLS`` for probabilities), never all distinct scores.
    ``g`` is read twice."""
    def order(x: str) -> F.Column:
        return c(x).desc() if descending else c(x).asc()

    g = g.withColumn("_cell", _cell())
    before = Window.orderBy(order("_at")).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(order("_at")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = g.groupBy(c("_cell").alias("_at")).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    cells = cells.select("_at", *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(f"{x}_before") for x in ("_p", "_n")],
                         F.sum("_p").over(every).alias("P"), F.sum("_n").over(every).alias("N"))
    inside = Window.partitionBy("_cell").orderBy(order("score")).rowsBetween(Window.unboundedPreceding, -1)
    rows = g.select("*", *[F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_{x}") for x in ("pos", "neg")])
    return rows.join(cells, c("_cell").eqNullSafe(c("_at"))).select(
        "score", "pos", "neg", (c("_pos") + c("_p_before")).alias("pos_before"), (c("_neg") + c("_n_before")).alias("neg_before"), "P", "N")


def roc_auc(preds: DataFrame, score: str = "roc_score") -> DataFrame:
    """AGG-10: ROC-AUC with tied scores averaged (Mann-Whitney); NaN with one class.

    A cell's pairs are counted inside it, and against the negatives of the
    cells before by a window over one row for each cell; ``preds`` is read once."""
    inside = Window.partitionBy("_cell").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    before = Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    rows = score_label_counts(preds, score).withColumn("_cell", _cell()).withColumn("_neg", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    cells = rows.groupBy("_cell").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"),
                                      F.sum(c("pos") * (c("_neg") + c("neg") * dbl(0.5))).alias("U"))
    cells = cells.withColumn("U", c("U") + c("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0)))
    agg = cells.agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"), F.sum("U").alias("U"))
    return agg.select(F.when((c("P") > 0) & (c("N") > 0), F.round(c("U") / (c("P") * c("N")), 4))
                      .otherwise(F.lit(float("nan"))).alias("roc_auc"),
                      c("P").alias("n_pos"), c("N").alias("n_neg"))


def roc_curve(preds: DataFrame, score: str = "roc_score") -> DataFrame:
    """AGG-12: (threshold, fpr, tpr) at every distinct score, highest first."""
    g = _with_counts_before(score_label_counts(preds, score), descending=True)
    return g.select(c("score").alias("threshold"),
                    F.round(_div((c("neg_before") + c("neg")).cast("double"), c("N")), 6).alias("fpr"),
                    F.round(_div((c("pos_before") + c("pos")).cast("double"), c("P")), 6).alias("tpr"))


def indicator_fire_counts(preds: DataFrame) -> DataFrame:
    """AGG-13: per indicator, rows where it fired and the share in percent."""
    stack = "stack({n}, {pairs}) as (indicator, fired)".format(
        n=len(L.INDICATOR_NAMES), pairs=", ".join(f"'{x}', `{x}`" for x in L.INDICATOR_NAMES))
    long = preds.selectExpr(stack)
    return long.groupBy("indicator").agg(
        F.sum("fired").cast("long").alias("fires"),
        F.round(F.sum("fired") * dbl(100.0) / F.count("*"), 2).alias("pct"))


def fn_by_category(preds: DataFrame) -> DataFrame:
    """AGG-14: false negatives by dominant semantic category."""
    g = preds.groupBy("dominant_category").agg(
        F.count_if((c("label") == 1) & (c("predicted_label") == 0)).alias("n_false_negatives"))
    return g.filter(c("n_false_negatives") > 0)


def distributions(preds: DataFrame) -> DataFrame:
    """AGG-15: verdict and method distributions in one table."""
    v = preds.groupBy(F.lit("verdict").alias("kind"), c("verdict").alias("value")).agg(F.count("*").alias("n"))
    m = preds.groupBy(F.lit("method").alias("kind"), c("method").alias("value")).agg(F.count("*").alias("n"))
    return v.unionByName(m)


def run_summary(preds: DataFrame) -> DataFrame:
    """AGG-16/17: degraded and error counts, mean confidence overall and per
    predicted class (0 when the class is empty)."""
    p = c("predicted_label")
    return preds.agg(
        F.count("*").alias("n_total"),
        F.count_if(c("degraded_mode")).alias("n_degraded"),
        F.count_if(c("error").isNotNull()).alias("n_errors"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.coalesce(F.avg(F.when(p == 1, c("confidence"))), dbl(0.0)), 4).alias("avg_conf_phishing"),
        F.round(F.coalesce(F.avg(F.when(p == 0, c("confidence"))), dbl(0.0)), 4).alias("avg_conf_legit"),
    )


_COMPARE_KEYS = ["accuracy", "macro_f1", "fpr", "fnr", "cohen_kappa"]


def _long_metrics(m: DataFrame, run: str) -> DataFrame:
    stack = "stack({n}, {pairs}) as (metric, value)".format(
        n=len(_COMPARE_KEYS), pairs=", ".join(f"'{k}', CAST({k} AS DOUBLE)" for k in _COMPARE_KEYS))
    return m.selectExpr(stack).withColumn("run", F.lit(run))


def mode_comparison(full: DataFrame, other: DataFrame, label_full="full", label_other="rule_only") -> DataFrame:
    """AGG-20: metric rows of two runs side by side with the delta in points."""
    both = _long_metrics(full, label_full).unionByName(_long_metrics(other, label_other))
    g = both.groupBy("metric").agg(
        F.max(F.when(c("run") == label_full, c("value"))).alias(label_full),
        F.max(F.when(c("run") == label_other, c("value"))).alias(label_other))
    return g.withColumn("delta_pp", F.round((c(label_full) - c(label_other)) * 100, 1))


# FIXED VALUES: published comparison rows (accuracy, fpr, fnr, f1, auc; NULL = not published).
BASELINE_SYSTEMS = [
    ("SpamAssassin", 0.973, 0.027, 0.026, None, None),
    ("earlier_system", 0.750, 0.150, 0.250, None, None),
    ("embedding_rf", 0.824, 0.103, 0.158, 0.823, 0.891),
]


def system_comparison(spark: SparkSession, ours: DataFrame, auc: DataFrame) -> DataFrame:
    """AGG-21: the fixed baseline rows plus this run (one-row inputs combined
    by a union and a global aggregate)."""
    schema = "system string, accuracy double, fpr double, fnr double, f1 double, auc double"
    fixed = spark.createDataFrame(BASELINE_SYSTEMS, schema)
    a = ours.select(c("accuracy").cast("double"), c("fpr").cast("double"), c("fnr").cast("double"),
                    c("macro_f1").cast("double").alias("f1"), F.lit(None).cast("double").alias("auc"))
    b = auc.select(*[F.lit(None).cast("double").alias(x) for x in ("accuracy", "fpr", "fnr", "f1")],
                   c("roc_auc").cast("double").alias("auc"))
    mine = a.unionByName(b).agg(*[F.max(x).alias(x) for x in ("accuracy", "fpr", "fnr", "f1", "auc")]) \
        .select(F.lit("this_run").alias("system"), "accuracy", "fpr", "fnr", "f1", "auc")
    return fixed.unionByName(mine)


def per_indicator_accuracy(pred_flags: DataFrame, true_flags: DataFrame, key: str = "email_id") -> DataFrame:
    """AGG-19: agreement of predicted and rule indicator flags, per indicator."""
    both = pred_flags.select(key, *[c(n).alias(f"p_{n}") for n in L.INDICATOR_NAMES]).join(
        true_flags.select(key, *[c(n).alias(f"t_{n}") for n in L.INDICATOR_NAMES]), key)
    one = both.agg(*[F.round(F.avg((c(f"p_{n}") == c(f"t_{n}")).cast("double")), 4).alias(n) for n in L.INDICATOR_NAMES])
    pairs = ", ".join(f"'{n}', `{n}`" for n in L.INDICATOR_NAMES)
    return one.selectExpr(f"stack({len(L.INDICATOR_NAMES)}, {pairs}) as (indicator, accuracy)")


def bootstrap_ci(preds: DataFrame, n_boot: int = 1000, seed: int = 42, score: str = "roc_score") -> DataFrame:
    """AGG-11: 95 % bootstrap intervals (2.5 / 97.5 percentiles) for accuracy,
    macro F1, ROC-AUC, FPR and FNR; NaN replicates dropped.

    Poisson bootstrap: a row's replicate weight is Poisson(1), so a group of
    m identical (label, prediction, score) rows gets one Poisson(m) draw per
    replicate.  Work is bounded by distinct groups x replicates, whatever
    the number of rows (draws: inverse CDF at every m, started ten standard
    deviations below the mean; uniforms come from a seeded hash)."""
    g = preds.groupBy("label", "predicted_label", c(score).alias("score")).agg(F.count("*").alias("m"))
    rep = g.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    # Replicates are dealt to all tasks before they are drawn: the groups are few and come in one or two parts.
    conf = preds.sparkSession.conf
    rep = rep.repartition(min(n_boot, int(conf.get("spark.sql.shuffle.partitions"))), "b")

    # MD5 of seed, replicate and group: other engines draw the same numbers from it.
    points = F.round(c("score") * 1_000_000_000).cast("long")
    name = F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in (c("b"), c("label"), c("predicted_label"), points)])
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    rep = rep.withColumn("u1", u)
    m = c("m").cast("double")
    # Inverse CDF over the ten standard deviations around the mean (what lies outside has a probability under 1e-20).
    reach = 10 * F.sqrt(m) + 10
    low = F.floor(F.greatest(dbl(0.0), m - reach))
    k0 = low.cast("double")
    stirling = (k0 + 0.5) * F.log(k0) - k0 + 0.9189385332046728 + 1 / (12 * k0) - 1 / (360 * k0 * k0 * k0)
    log_factorial = F.when(k0 <= 20, F.log(F.factorial(F.least(low, F.lit(20)).cast("int")).cast("double"))).otherwise(stirling)
    drawn = F.aggregate(
        F.sequence(low, F.ceil(m + reach)),
        F.struct(F.lit(-1).cast("long").alias("k"), dbl(0.0).alias("cdf"), F.exp(-m + k0 * F.log(m) - log_factorial).alias("p")),
        lambda acc, k: F.when(acc["k"] >= 0, acc).otherwise(
            F.when(acc["cdf"] + acc["p"] >= c("u1"), F.struct(k.alias("k"), (acc["cdf"] + acc["p"]).alias("cdf"), acc["p"].alias("p")))
            .otherwise(F.struct(F.lit(-1).cast("long").alias("k"), (acc["cdf"] + acc["p"]).alias("cdf"), (acc["p"] * m / (k + 1)).alias("p")))),
        lambda acc: F.when(acc["k"] < 0, F.ceil(m + reach)).otherwise(acc["k"]))
    rep = rep.withColumn("w", drawn.cast("long"))
    y, p = c("label"), c("predicted_label")
    # All counts of a replicate come from its counts by score, where it was drawn.
    sc = rep.groupBy("b", "score").agg(
        F.sum(F.when(y == 1, c("w")).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, c("w")).otherwise(0)).alias("neg"),
        F.sum(F.when((y == 1) & (p == 1), c("w")).otherwise(0)).alias("tp"),
        F.sum(F.when((y == 0) & (p == 0), c("w")).otherwise(0)).alias("tn"),
        F.sum(F.when((y == 0) & (p == 1), c("w")).otherwise(0)).alias("fp"),
        F.sum(F.when((y == 1) & (p == 0), c("w")).otherwise(0)).alias("fn"))
    w = Window.partitionBy("b").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    sc = sc.withColumn("neg_below", F.coalesce(F.sum("neg").over(w), F.lit(0)))
    cm = sc.groupBy("b").agg(*[F.sum(x).alias(x) for x in ("tp", "tn", "fp", "fn")], F.sum("pos").alias("P"), F.sum("neg").alias("N"),
                             F.sum(c("pos") * (c("neg_below") + c("neg") * dbl(0.5))).alias("U"))
    # per-replicate metrics, replicate id kept
    tp, tn, fp, fn = [c(x).cast("double") for x in ("tp", "tn", "fp", "fn")]
    n = tp + tn + fp + fn
    f_ph, f_lg = _div(2 * tp, 2 * tp + fp + fn), _div(2 * tn, 2 * tn + fn + fp)
    allm = cm.select("b", _div(tp + tn, n).alias("accuracy"), ((f_ph + f_lg) / 2).alias("macro_f1"),
                     _div(fp, fp + tn).alias("fpr"), _div(fn, fn + tp).alias("fnr"),
                     F.when((c("P") > 0) & (c("N") > 0), c("U") / (c("P") * c("N"))).alias("roc_auc"))
    out = []
    for k in ["accuracy", "macro_f1", "roc_auc", "fpr", "fnr"]:
        q = F.percentile(F.when(~F.isnan(c(k)), c(k)), F.array(F.lit(0.025), F.lit(0.975)))
        out.append(F.transform(q, lambda x: F.round(x, 4)).alias(k))
    return allm.agg(*out).selectExpr(
        "stack(5, 'accuracy', accuracy[0], accuracy[1], 'macro_f1', macro_f1[0], macro_f1[1], "
        "'roc_auc', roc_auc[0], roc_auc[1], 'fpr', fpr[0], fpr[1], 'fnr', fnr[0], fnr[1]) as (metric, ci_low, ci_high)")


def adversarial_evaluation(baseline: DataFrame, variants: DataFrame) -> DataFrame:
    """AGG-22: per technique, how many emails detected as phishing in the
    baseline are no longer detected in their variant (evasion success).
    ``variants`` carries (email_id, technique, predicted_label); both inputs
    are given tables, joined on email_id."""
    b = baseline.select("email_id", c("predicted_label").alias("base_pred"), "label")
    j = variants.select("email_id", "technique", c("predicted_label").alias("var_pred")).join(b, "email_id")
    detected = c("base_pred") == 1
    return j.groupBy("technique").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(detected).alias("baseline_detected"),
        F.count_if(c("var_pred") == 1).alias("variant_detected"),
        F.count_if(detected & (c("var_pred") == 0)).alias("evasions"),
    ).withColumn("evasion_rate", F.round(_div(c("evasions").cast("double"), c("baseline_detected")), 4))
