"""Scoring with embeddings and a trained model (JOI-08, FUS-03, FUS-04, CLS-04, CLS-08, CLS-13, SNK-07).

Embeddings come in as a table and are joined to emails by key.  The vector of
an email depends on what it has and on the model: reduced embedding and rule
scores where both the embedding and the reduction exist, else rule scores and
the first structural features; a model of another length gets one of the older
vectors instead, padded or cut.  Each row carries the mode it was scored in and
whether that is a degraded one.

``fit`` learns the reduction and the forest from the training split alone, and
keeps them together, so that scoring never mixes the parts of two runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassificationModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from baitscope.functions.core import dbl
from baitscope.functions.fusion import fit_length, heuristic_confidence, recommended_action, verdict
from baitscope.operators import ml as ML

c = F.col
# FIXED VALUES: names of the vector modes, and of the scoring methods.
REDUCED, RULE_STRUCTURAL, RULE_ONLY, FULL_EMBEDDING, HEURISTIC = "pca_bert", "rule_structural", "rule_only", "bert_structural", "heuristic"
FOREST = "random_forest"
#: Rule features, structural features of the degraded vector, and the longest vector of a model without whole embeddings.
RULE, STRUCTURAL, OLD_MODEL = 20, 20, 100


def join_embeddings(emails: DataFrame, embeddings: DataFrame, key: str = "email_id", vec_id: str = "vec_id") -> DataFrame:
    """JOI-08: ``emails`` with an ``embedding`` column, null where there is none or it has a missing or non-finite entry.

    Of several embeddings of one email the least is taken, so the join adds no rows.
    """
    vec = c("embedding").cast("array<double>")
    sound = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(vec) > 0)
    one = (embeddings.where(F.coalesce(sound, F.lit(False)) & c(vec_id).isNotNull())
           .groupBy(c(vec_id).alias("_vec_id")).agg(F.min(vec).alias("embedding")))
    return emails.drop("embedding").join(one, c(key) == c("_vec_id"), "left").drop("_vec_id")


def feature_mode(has_embedding: Column, reduced: bool, dims: int | None) -> Column:
    """Struct (mode, degraded) of an email for a model of ``dims`` features; ``dims`` None: no model, so the heuristic.

    ``reduced``: a fitted reduction goes with the model; its length is ``dims`` less the rule features.
    """
    def of(mode: str, degraded: Column | bool) -> Column:
        return F.struct(F.lit(mode).alias("mode"), (degraded if isinstance(degraded, Column) else F.lit(degraded)).alias("degraded"))

    if dims is None:
        return of(HEURISTIC, ~has_embedding)
    plain = of(RULE_STRUCTURAL, ~has_embedding)
    if dims != RULE + STRUCTURAL:  # the length does not fit the degraded vector
        older = of(RULE_ONLY, True)
        plain = older if dims <= OLD_MODEL else F.when(has_embedding, of(FULL_EMBEDDING, False)).otherwise(plain)
    return F.when(has_embedding, of(REDUCED, False)).otherwise(plain) if reduced else plain


def feature_vector(mode: Column, dims: int) -> Column:
    """FUS-03/04: the vector of a mode, padded with zeros or cut to ``dims``.

    Reads rule_vector, structural_vector, embedding and (for the reduced mode) reduced.
    """
    rule, structural = c("rule_vector"), c("structural_vector")
    vec = (F.when(mode == REDUCED, F.concat("reduced", rule))
           .when(mode == FULL_EMBEDDING, F.concat("embedding", structural))
           .when(mode == RULE_ONLY, F.concat(rule, structural))
           .otherwise(F.concat(rule, fit_length(structural, STRUCTURAL))))
    return fit_length(vec, dims)


@dataclass
class Model:
    """A forest with the reduction that was fitted on the same rows, or without any."""

    forest: RandomForestClassificationModel
    reduction: PipelineModel | None
    explained_variance: float | None = None

    @property
    def dims(self) -> int:
        return self.forest.numFeatures

    def save(self, path: str) -> None:
        """SNK-07: both parts under one folder."""
        ML.save_model(self.forest, f"{path}/forest")
        if self.reduction is not None:
            ML.save_model(self.reduction, f"{path}/reduction")
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(self.reduction is not None, self.explained_variance)], "reduced boolean, explained_variance double") \
            .write.mode("overwrite").parquet(f"{path}/parts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Model:
        parts = spark.read.parquet(f"{path}/parts").first()
        reduction = PipelineModel.load(f"{path}/reduction") if parts["reduced"] else None
        return cls(RandomForestClassificationModel.load(f"{path}/forest"), reduction, parts["explained_variance"])


def _with_reduced(rows: DataFrame, reduction: PipelineModel | None) -> DataFrame:
    """``rows`` with the array ``reduced``; it means something only where the embedding has the reduction's length."""
    if reduction is None:
        return rows.withColumn("reduced", F.lit(None).cast("array<double>"))
    size = len(reduction.stages[0].mean)
    usable = F.when(F.size("embedding") == size, c("embedding"))
    rows = rows.withColumn("_v", array_to_vector(F.coalesce(usable, F.array_repeat(dbl(0.0), size))))
    return reduction.transform(rows).withColumn("reduced", F.when(usable.isNotNull(), vector_to_array("pca"))).drop("_v", "_centred", "pca")


def training_rows(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """CLS-13: rows to learn from, and how many were left out and why.

    A row fails if its label is not 0 or 1, or a feature is missing or not a number.
    """
    def unsound(v: str) -> Column:
        return F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x)), F.lit(True))

    reason = (F.when(F.coalesce(~c("label").isin(0, 1), F.lit(True)), "label")
              .when(unsound("rule_vector"), "rule_vector").when(unsound("structural_vector"), "structural_vector"))
    rows = scored.withColumn("_reason", reason)
    left_out = rows.where("_reason IS NOT NULL").groupBy(c("_reason").alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.where("_reason IS NULL").drop("_reason"), left_out


def fit(train: DataFrame, components: int = 64, use_embeddings: bool = True, **forest) -> Model:
    """CLS-05, CLS-08: reduction and forest, both from ``train`` (label, rule_vector, structural_vector, embedding).

    The reduction needs twice as many embeddings as components; below that, or
    with ``use_embeddings`` off, the model is a degraded one without it.
    """
    rows, _ = training_rows(train)
    reduction = variance = None
    if use_embeddings:
        try:
            reduction, variance = ML.fit_pca(rows.where("embedding IS NOT NULL"), "embedding", components)
        except ValueError:
            pass  # too few embeddings
    dims = RULE + components if reduction is not None else RULE + STRUCTURAL
    rows = _with_reduced(rows, reduction)
    # In training a row without an embedding keeps the degraded vector, padded.
    mode = F.when(c("reduced").isNotNull(), REDUCED).otherwise(RULE_STRUCTURAL)
    rows = ML.to_vector(rows.withColumn("features", feature_vector(mode, dims)), "features")
    model = ML.forest(**forest).fit(ML.class_weights(rows.select("label", "features")))
    return Model(model, reduction, variance)


def classify(scored: DataFrame, model: Model | None) -> DataFrame:
    """CLS-04: verdict, confidence, action, method, feature_mode and degraded_mode of every row of ``scored``.

    Replaces the columns of these names.  Without a model the heuristic decides.
    """
    kept = scored.drop("verdict", "confidence", "recommended_action", "method", "feature_mode", "degraded_mode", "reduced")
    if model is None:
        p = heuristic_confidence(c("semantic_score"), c("url_score"), c("header_score"), c("html_score"))
        rows = kept.withColumn("_mode", feature_mode(c("embedding").isNotNull(), False, None)).withColumn("_p", p)
        method = HEURISTIC
    else:
        rows = _with_reduced(kept, model.reduction)
        # The reduction is there, but not for an embedding of another length.
        has = c("reduced").isNotNull() if model.reduction is not None else c("embedding").isNotNull()
        rows = rows.withColumn("_mode", feature_mode(has, model.reduction is not None, model.dims))
        rows = ML.to_vector(rows.withColumn("features", feature_vector(c("_mode.mode"), model.dims)), "features")
        rows = model.forest.transform(rows).withColumn("_p", vector_to_array("probability").getItem(1))
        rows = rows.drop("features", "rawPrediction", "probability", "prediction", "reduced")
        method = FOREST
    rows = rows.select("*", verdict(c("_p")).alias("verdict"), F.round("_p", 4).alias("confidence"), F.lit(method).alias("method"),
                       c("_mode.mode").alias("feature_mode"), c("_mode.degraded").alias("degraded_mode")).drop("_p", "_mode")
    return rows.withColumn("recommended_action", recommended_action(c("verdict"), c("confidence")))


def without_embeddings(scored: DataFrame) -> DataFrame:
    """The rows as the rule-only pass sees them (AGG-20)."""
    return scored.withColumn("embedding", F.lit(None).cast("array<double>"))
