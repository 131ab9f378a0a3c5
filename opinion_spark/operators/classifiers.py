"""The two classifiers, on Spark ML, and the models they give."""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL
from opinion_spark.functions.columns import lookup, named, sql_text
from opinion_spark.operators.tfidf import Tfidf

# Model names as users choose them.
LOGISTIC = "Logistic Regression"
BAYES = "Naive Bayes"

def class_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Balanced class weights: rows / (classes * rows of the class)."""
    sizes = df.filter(named(label).isNotNull()).groupBy(named(label)).agg(F.count(F.lit(1)).alias("n"))
    # One row per class is left for the one-task window.
    every = Window.partitionBy(F.lit(0))
    per_class = F.sum("n").over(every) / F.count(F.lit(1)).over(every)
    return sizes.select(named(label), "n", (per_class / F.col("n")).alias("weight"))


def balanced_weights(counts: Mapping[Hashable, int]) -> dict[Hashable, float]:
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def class_index(label: Column, classes: Sequence[Hashable]) -> Column:
    """The position of a label in the class list, as Spark ML wants it."""
    return lookup(label, {c: float(i) for i, c in enumerate(classes)})


@dataclass(frozen=True)
class FittedModel:
    """A classifier with the features it was trained on.

    ``classifier`` maps vectors to predictions, ``pipeline`` text to
    predictions; both end with the ``prediction`` column holding labels.
    """

    name: str
    classes: tuple
    text: str
    classifier: PipelineModel
    pipeline: PipelineModel
    accuracy: float | None = None
    log_prior: tuple[float, ...] | None = field(default=None)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` to a table of texts."""
        helper = ("tokens", "terms", "term_counts", "term_weights", "features", "raw_score", "probability", "class_position")
        return self.pipeline.transform(df).drop(*helper)

    def predict_vectors(self, df: DataFrame, scores: bool = False) -> DataFrame:
        """Add ``prediction`` to a table of vectors, and per-class ``scores`` if asked."""
        out = self.classifier.transform(df)
        if scores:
            raw = vector_to_array("raw_score")
            shift = self._score_shift()
            out = out.withColumn("scores", F.array(*(raw[i] + F.lit(s) for i, s in enumerate(shift))))
        return out.drop("raw_score", "probability", "class_position")

    def _score_shift(self) -> list[float]:
        if self.log_prior is None:
            return [0.0] * len(self.classes)
        fitted = self.classifier.stages[0].pi.toArray()
        return [float(own - pi) for own, pi in zip(self.log_prior, fitted)]


def fit_logistic(
    vectors: DataFrame,
    tfidf: Tfidf,
    counts: Mapping[Hashable, int],
    label: str = LABEL,
    max_iter: int = 1000,
    c: float = 1.0,
    tol: float = 1e-6,
    tasks: int | None = None,
) -> FittedModel:
    """L2 logistic regression with balanced class weights, softmax for three classes.

    The penalty 1/2 |w|^2 against C times the summed losses is, after division
    by C times the summed weights (which equal the row count when balanced),
    Spark's penalty with regParam = 1 / (C * rows). Training passes over the
    vectors hundreds of times, in their partitions or merged to ``tasks``.
    """
    classes = tuple(counts)
    weights = {float(i): w for i, w in enumerate(balanced_weights(counts).values())}
    train = (vectors if tasks is None else vectors.coalesce(tasks)).select("features", class_index(named(label), classes).alias("class_index")).withColumn(
        "weight", lookup(F.col("class_index"), weights)
    )
    model = LogisticRegression(
        featuresCol="features", labelCol="class_index", weightCol="weight", predictionCol="class_position",
        rawPredictionCol="raw_score", probabilityCol="probability", family="auto", maxIter=max_iter,
        regParam=1.0 / (c * sum(counts.values())), elasticNetParam=0.0, standardization=False, tol=tol,
    ).fit(train)
    return _fitted(LOGISTIC, classes, tfidf, model)


def fit_naive_bayes(
    vectors: DataFrame,
    tfidf: Tfidf,
    counts: Mapping[Hashable, int],
    label: str = LABEL,
    alpha: float = 1.0,
) -> FittedModel:
    """Multinomial naive Bayes on the weights, class shares as unsmoothed priors.

    Spark smooths the prior too. Its thresholds divide each class probability
    before the best class is taken, so the quotient of both priors gives the
    predictions under the unsmoothed one, and is stored with the model.
    """
    classes = tuple(counts)
    total = sum(counts.values())
    shares = [n / total for n in counts.values()]
    smoothed = [(n + alpha) / (total + alpha * len(counts)) for n in counts.values()]
    model = NaiveBayes(
        featuresCol="features", labelCol="class_index", predictionCol="class_position", rawPredictionCol="raw_score",
        probabilityCol="probability", modelType="multinomial", smoothing=alpha,
        thresholds=[s / p for s, p in zip(smoothed, shares)],
    ).fit(vectors.select("features", class_index(named(label), classes).alias("class_index")))
    return _fitted(BAYES, classes, tfidf, model, tuple(math.log(p) for p in shares))


def naive_bayes_parameters(spark: SparkSession, model: FittedModel, tfidf: Tfidf) -> DataFrame:
    """Log likelihood of each term and log prior, per class (classes * vocabulary rows)."""
    theta = model.classifier.stages[0].theta.toArray()
    k, v = theta.shape
    table = pd.DataFrame({
        "label": np.repeat(np.asarray(model.classes), v),
        "term": np.tile(np.asarray(tfidf.terms, dtype=object), k),
        "log_theta": theta.reshape(-1),
        "log_prior": np.repeat(np.asarray(model.log_prior), v),
    })
    return spark.createDataFrame(table).withColumn("label", F.col("label").cast("int"))


def _fitted(name: str, classes: tuple, tfidf: Tfidf, model: Transformer, log_prior=None) -> FittedModel:
    listed = ", ".join(sql_text(c) if isinstance(c, str) else str(c) for c in classes)
    to_label = SQLTransformer(
        statement=f"SELECT *, element_at(array({listed}), CAST(class_position AS INT) + 1) AS prediction FROM __THIS__"
    )
    return FittedModel(
        name=name, classes=classes, text=tfidf.text, classifier=PipelineModel([model, to_label]),
        pipeline=PipelineModel([*tfidf.stages(), model, to_label]), log_prior=log_prior,
    )
