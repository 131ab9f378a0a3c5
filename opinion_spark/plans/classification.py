"""Train and compare classifiers on a table of labelled texts."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL, SEED
from opinion_spark.functions.display import fixed
from opinion_spark.functions.stop_words import FEATURE
from opinion_spark.operators.classifiers import BAYES, LOGISTIC, FittedModel, fit_logistic, fit_naive_bayes
from opinion_spark.operators.metrics import classification_report, confusion_matrix, pair_counts
from opinion_spark.operators.sampling import allocate_test, class_sizes, stratified_split
from opinion_spark.operators.statistics import complete_cases
from opinion_spark.operators.tfidf import Tfidf, fit_tfidf
from opinion_spark.session import stage
from opinion_spark.sources.bundle import save_model

TRAINERS = {LOGISTIC: fit_logistic, BAYES: fit_naive_bayes}

SUMMARY_SCHEMA = (
    "model string, accuracy double, train_size bigint, test_size bigint, train_percent double, "
    "test_percent double, training_time double, error string, model_order int"
)
PAIRS_SCHEMA = "model string, actual int, predicted int, n bigint"


@dataclass(frozen=True)
class TrainingData:
    """Staged vectors of both sides of a split, with what they were built from."""

    vectors: DataFrame
    tfidf: Tfidf
    train_counts: dict
    test_counts: dict
    test_size: float

    @property
    def train(self) -> DataFrame:
        return self.vectors.filter(~F.col("is_test"))

    @property
    def test(self) -> DataFrame:
        return self.vectors.filter(F.col("is_test"))


@dataclass(frozen=True)
class ClassificationResult:
    """What a run gives: fitted models, and small tables built from one count per model."""

    spark: SparkSession
    data: TrainingData
    models: dict[str, FittedModel]
    rows: list[tuple]
    pairs: list[tuple]

    @property
    def summary(self) -> DataFrame:
        """One row per chosen model; a failed one has its error and no accuracy."""
        return self.spark.createDataFrame(self.rows, SUMMARY_SCHEMA)

    @property
    def confusion(self) -> DataFrame:
        return self._per_model(confusion_matrix)

    @property
    def report(self) -> DataFrame:
        return self._per_model(classification_report)

    def _per_model(self, metric) -> DataFrame:
        out: DataFrame | None = None
        for name in self.models:
            counts = self.spark.createDataFrame([p for p in self.pairs if p[0] == name], PAIRS_SCHEMA)
            table = metric(counts, "actual", "predicted", weight="n").withColumn("model", F.lit(name))
            out = table if out is None else out.unionByName(table)
        if out is None:
            raise RuntimeError("no model could be trained")
        return out.select("model", *[c for c in out.columns if c != "model"])

    @property
    def best(self) -> FittedModel | None:
        """The model with the highest accuracy above 0, the first of equals."""
        best: FittedModel | None = None
        for model in self.models.values():
            if model.accuracy > (best.accuracy if best else 0):
                best = model
        return best


def prepare_training(
    df: DataFrame,
    key: str,
    text: str,
    label: str = LABEL,
    test_size: float = 0.2,
    seed: int = SEED,
    stop_words: Sequence[str] = FEATURE,
    **features,
) -> TrainingData:
    """Clean, split, fit the vocabulary on the train side and stage the vectors.

    Rows are written once, so that counts and cuts read keys and labels only
    and the texts twice: for the vocabulary and for the vectors. Vectors are
    written once too: training reads them in every iteration.
    """
    clean = stage(complete_cases(df, text, label, keep=[key]), "complete-cases")
    counts = class_sizes(clean.select(label), label)
    if len(counts) < 2:
        raise ValueError("the table must hold at least 2 classes")
    test_counts = allocate_test(counts, test_size)
    train_counts = {c: n - test_counts[c] for c, n in counts.items()}
    split = stratified_split(clean, key, label, test_size, seed, counts=counts)
    tfidf = fit_tfidf(
        split.filter(~F.col("is_test")), text, stop_words, n_docs=sum(train_counts.values()), **features
    )
    vectors = tfidf.vectors(split).select(key, label, "is_test", "features")
    return TrainingData(stage(vectors, "vectors"), tfidf, train_counts, test_counts, test_size)


def run_classification(
    df: DataFrame,
    text: str,
    key: str,
    label: str = LABEL,
    test_size: float = 0.2,
    models: Sequence[str] = (LOGISTIC, BAYES),
    save_to: str | None = None,
    seed: int = SEED,
    stop_words: Sequence[str] = FEATURE,
    max_iter: int = 1000,
) -> ClassificationResult:
    """Split the table, train the chosen models on one side, measure them on the other, save the best."""
    data = prepare_training(df, key, text, label, test_size, seed, stop_words)
    result = train_models(data, label, models, max_iter)
    if save_to and result.best is not None:
        save_model(result.best, save_to)
    return result


def train_models(
    data: TrainingData, label: str = LABEL, models: Sequence[str] = (LOGISTIC, BAYES), max_iter: int = 1000, tasks: int | None = None
) -> ClassificationResult:
    """Train and measure the chosen models on prepared data.

    Unknown model names are ignored. A model that fails leaves its error in
    the summary and the others go on.
    """
    options = {LOGISTIC: {"max_iter": max_iter, "tasks": tasks}, BAYES: {}}
    sizes = (
        sum(data.train_counts.values()), sum(data.test_counts.values()),
        round((1 - data.test_size) * 100, 2), round(data.test_size * 100, 2),
    )
    fitted: dict[str, FittedModel] = {}
    rows: list[tuple] = []
    pairs: list[tuple] = []
    for order, (name, train) in enumerate(TRAINERS.items()):
        if name not in models:
            continue
        start = time.perf_counter()
        try:
            model = train(data.train, data.tfidf, data.train_counts, label, **options[name])
            counted = pair_counts(model.predict_vectors(data.test), label).collect()
        except Exception as error:  # noqa: BLE001 - reported in the summary
            rows.append((name, None, *sizes, None, str(error), order))
            continue
        hits = sum(r.n for r in counted if r.actual == r.predicted)
        accuracy = hits / max(1, sum(r.n for r in counted))
        fitted[name] = replace(model, accuracy=accuracy)
        rows.append((name, accuracy, *sizes, round(time.perf_counter() - start, 2), None, order))
        pairs += [(name, r.actual, r.predicted, r.n) for r in counted]
    return ClassificationResult(data.vectors.sparkSession, data, fitted, rows, pairs)


def compare_models(summary: DataFrame) -> DataFrame:
    """Accuracy of the models that were trained, as number and as shown."""
    return (
        summary.filter(F.col("error").isNull())
        .select("model", "accuracy", fixed(F.col("accuracy"), 3).alias("accuracy_text"), "model_order")
        .orderBy("model_order")
    )


def best_model(summary: DataFrame) -> DataFrame:
    """The model with the highest accuracy, the first of equals."""
    return (
        summary.filter(F.col("error").isNull())
        .orderBy(F.desc("accuracy"), F.asc("model_order"))
        .limit(1)
        .select("model", "accuracy", fixed(F.col("accuracy"), 4).alias("accuracy_text"))
    )


def split_sizes(df: DataFrame, test_size: float) -> DataFrame:
    """Rows per side of a split table, and the percentages that were asked for."""
    return df.agg(
        F.count_if(~F.col("is_test")).alias("train_size"), F.count_if(F.col("is_test")).alias("test_size")
    ).select(
        "train_size", "test_size",
        F.lit(round((1 - test_size) * 100, 2)).alias("train_percent"),
        F.lit(round(test_size * 100, 2)).alias("test_percent"),
    )
