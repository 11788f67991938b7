"""Model operators on Spark ML (CLS-04 .. CLS-11, URL-23).

Forests, PCA and logistic regression are Spark ML estimators: training data
stays distributed and the fitted model is broadcast to score.  The driver
only loops over folds and the 20 indicator targets (a fixed, small number of
fits), never over rows.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, HashingTF, NGram, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.functions.fusion import heuristic_confidence, recommended_action
from baitscope.operators.corpus import ranked
from baitscope.operators.metrics import metrics_from_counts
from baitscope.resources import lexicons as L

c = F.col


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """CLS-06: balanced weights n / (k * n_class), joined back by label (the
    weight table has one row per class, and is broadcast: rows dealt by label
    would meet in one task per class)."""
    from pyspark.sql import Window
    counts = df.groupBy(label).agg(F.count("*").alias("_nc"))
    every = Window.partitionBy()  # over the per-class counts: one row per class
    w = counts.select(label, (F.sum("_nc").over(every) / (F.count("*").over(every) * c("_nc"))).alias("weight"))
    return df.join(F.broadcast(w), label)


def training_gate(df: DataFrame, min_samples: int = 10, label: str = "label") -> dict:
    """CLS-11: at least ``min_samples`` rows and both classes (one aggregate)."""
    row = df.agg(F.count("*").alias("n"), F.count_if(c(label) == 1).alias("pos"),
                 F.count_if(c(label) == 0).alias("neg")).first()
    ok = row["n"] >= min_samples and row["pos"] > 0 and row["neg"] > 0
    return {"success": ok, "sample_count": row["n"], "phishing": row["pos"], "legitimate": row["neg"]}


def pad_features(df: DataFrame, col: str, n: int) -> DataFrame:
    """FUS-04 for ragged training vectors: zero-pad / cut to ``n``."""
    v = F.slice(F.concat(c(col), F.array_repeat(dbl(0.0), n)), 1, n)
    return df.withColumn(col, v)


def forest(num_trees: int = 100, max_depth: int = 15, seed: int = 42, weighted: bool = True,
           features: str = "features", label: str = "label") -> RandomForestClassifier:
    """CLS-05: forest settings (min split size has no Spark equivalent; leaf
    size 2 is ``minInstancesPerNode``)."""
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth, minInstancesPerNode=2,
                                featureSubsetStrategy="sqrt", seed=seed, featuresCol=features, labelCol=label)
    if weighted:
        rf = rf.setWeightCol("weight")
    return rf


def to_vector(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    return df.withColumn(out, array_to_vector(c(array_col)))


def fold_column(df: DataFrame, k: int, seed: int = 42, key: str = "row_id") -> DataFrame:
    """CLS-10: stratified folds: rank within label in hash order, modulo k."""
    return ranked(df, "label", key, seed).withColumn("fold", ((c("_rank") - 1) % k).cast("int")).drop("_rank", "_n")


def cross_validate(df: DataFrame, k: int = 5, seed: int = 42, **rf_args) -> DataFrame:
    """CLS-10: per-fold accuracy, precision, recall and F1 of the phishing
    class, and their mean and standard deviation."""
    folds = fold_column(df, k, seed)
    rows = []
    for f in range(k):
        train = class_weights(folds.filter(c("fold") != f))
        model = forest(seed=seed, **rf_args).fit(train)
        pred = model.transform(folds.filter(c("fold") == f))
        y, p = c("label"), c("prediction").cast("int")
        cm = pred.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                      F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))
        rows.append(metrics_from_counts(cm).select(F.lit(f).alias("fold"), "accuracy",
                                                   c("phishing_precision").alias("precision"),
                                                   c("phishing_recall").alias("recall"), c("phishing_f1").alias("f1")))
    per_fold = rows[0]
    for r in rows[1:]:
        per_fold = per_fold.unionByName(r)
    return per_fold


def cv_summary(per_fold: DataFrame) -> DataFrame:
    aggs = []
    for m in ["accuracy", "precision", "recall", "f1"]:
        aggs += [F.round(F.avg(m), 4).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 4).alias(f"{m}_std")]
    return per_fold.agg(*aggs)


def fit_pca(df: DataFrame, array_col: str, k: int, min_rows: int | None = None):
    """CLS-08: mean-centre then PCA to ``k`` components; returns (model,
    explained variance total).  Under ``min_rows`` rows (2k by default) it
    raises a ValueError."""
    min_rows = min_rows if min_rows is not None else 2 * k
    n = df.count()
    if n < min_rows:
        raise ValueError(f"PCA to {k} components needs at least {min_rows} rows; there are {n}")
    vec = to_vector(df, array_col, "_v")
    pipe = Pipeline(stages=[StandardScaler(inputCol="_v", outputCol="_centred", withMean=True, withStd=False),
                            PCA(k=k, inputCol="_centred", outputCol="pca")])
    model = pipe.fit(vec)
    return model, float(sum(model.stages[-1].explainedVariance))


def feature_importance(model, k: int = 10, first_k: bool = True) -> list[tuple[str, float]]:
    """CLS-09: the first ten importances (as the original reports them), or
    the true top ``k`` with ``first_k=False``."""
    imp = list(model.featureImportances.toArray())
    pairs = [(f"feature_{i}", round(float(v), 4)) for i, v in enumerate(imp)]
    return pairs[:k] if first_k else sorted(pairs, key=lambda p: -p[1])[:k]


def classify_with_model(scored: DataFrame, model, features: str = "features") -> DataFrame:
    """CLS-04: forest probability when a model is given, else the heuristic;
    verdict thresholds .40/.22 before rounding; method and mode columns."""
    if model is None:
        raw = heuristic_confidence(c("semantic_score"), c("url_score"), c("header_score"), c("html_score"))
        out = scored.withColumn("_p", raw).withColumn("method", F.lit("heuristic"))
    else:
        out = model.transform(scored).withColumn("_p", vector_to_array(c("probability")).getItem(1)) \
            .withColumn("method", F.lit("random_forest")).drop("rawPrediction", "probability", "prediction")
    v = F.when(c("_p") >= 0.40, F.lit("phishing")).when(c("_p") >= 0.22, F.lit("suspicious")).otherwise(F.lit("legitimate"))
    out = out.withColumn("model_verdict", v).withColumn("model_confidence", F.round(c("_p"), 4))
    return out.withColumn("model_action", recommended_action(c("model_verdict"), c("model_confidence"))).drop("_p")


def fit_indicator_models(df: DataFrame, features: str = "features", **rf_args) -> dict:
    """CLS-07: one forest per indicator flag column; a flag that never varies
    is kept as its constant."""
    models = {}
    stats = df.agg(*[F.min(n).alias(f"{n}__min") for n in L.INDICATOR_NAMES],
                   *[F.max(n).alias(f"{n}__max") for n in L.INDICATOR_NAMES]).first()
    for n in L.INDICATOR_NAMES:
        lo, hi = stats[f"{n}__min"], stats[f"{n}__max"]
        if lo == hi:
            models[n] = int(lo or 0)
        else:
            models[n] = forest(weighted=False, features=features, label=n, **rf_args) \
                .setPredictionCol(f"{n}__pred").setProbabilityCol(f"{n}__prob") \
                .setRawPredictionCol(f"{n}__raw").fit(df)
    return models


def predict_indicators(df: DataFrame, models: dict) -> DataFrame:
    out = df
    for n, m in models.items():
        if isinstance(m, int):
            out = out.withColumn(f"pred_{n}", F.lit(m))
        else:
            out = m.transform(out).withColumn(f"pred_{n}", c(f"{n}__pred").cast("int")) \
                .drop(f"{n}__pred", f"{n}__prob", f"{n}__raw")
    return out


def url_model(max_iter: int = 50, num_features: int = 1 << 16) -> Pipeline:
    """URL-23: character n-grams of widths 3, 5 and 7, hashed, then a
    logistic regression (stands in for the character CNN)."""
    stages, outs = [], []
    for n in (3, 5, 7):
        stages += [NGram(n=n, inputCol="_chars", outputCol=f"_ng{n}"),
                   HashingTF(numFeatures=num_features, inputCol=f"_ng{n}", outputCol=f"_tf{n}")]
        outs.append(f"_tf{n}")
    stages += [VectorAssembler(inputCols=outs, outputCol="features"),
               LogisticRegression(maxIter=max_iter, labelCol="label", featuresCol="features")]
    return Pipeline(stages=stages)


def url_chars(df: DataFrame, col: str = "url") -> DataFrame:
    return df.withColumn("_chars", F.split(F.lower(c(col)), ""))


def train_url_model(pairs: DataFrame, seed: int = 42, split_keys: tuple[str, ...] = ("url",)):
    """URL-23: 90/10 split by a hash of ``split_keys``, fit, and test metrics.

    Every step of the regression sums a gradient of all features from each part
    of the training rows: they come in as many parts as tasks run at a time,
    so that these sums do not grow with the input."""
    x = url_chars(pairs.withColumn("_h", F.pmod(F.xxhash64(*split_keys, F.lit(seed)), F.lit(10))))
    train = x.filter(c("_h") != 0).coalesce(pairs.sparkSession.sparkContext.defaultParallelism)
    model = url_model().fit(train)
    test = model.transform(x.filter(c("_h") == 0))
    y, p = c("label"), (vector_to_array(c("probability")).getItem(1) >= 0.5).cast("int")
    cm = test.agg(F.count_if((y == 1) & (p == 1)).alias("tp"), F.count_if((y == 0) & (p == 0)).alias("tn"),
                  F.count_if((y == 0) & (p == 1)).alias("fp"), F.count_if((y == 1) & (p == 0)).alias("fn"))
    return model, metrics_from_counts(cm)


def score_urls(model: PipelineModel, urls: DataFrame, col: str = "url") -> DataFrame:
    """URL-23: phishing probability per URL."""
    out = model.transform(url_chars(urls, col))
    return out.select(*urls.columns, vector_to_array(c("probability")).getItem(1).alias("probability"))


def save_model(model, path: str) -> None:
    """SNK-07: Spark ML persistence."""
    model.write().overwrite().save(path)


def load_pipeline(path: str) -> PipelineModel:
    return PipelineModel.load(path)
