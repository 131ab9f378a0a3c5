"""Views of a frozen evaluation: metrics, their display, and wrong predictions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL
from opinion_spark.functions.display import fixed, percent, thousands
from opinion_spark.operators.metrics import (
    accuracy, classification_report, confusion_matrix, error_examples, report_scores,
)
from opinion_spark.operators.statistics import prediction_distribution
from opinion_spark.sources.snapshot import frozen_settings


@dataclass(frozen=True)
class EvaluationReport:
    distribution: DataFrame
    accuracy: DataFrame
    report: DataFrame
    confusion: DataFrame
    errors: DataFrame


def evaluation_report(scored: DataFrame, text: str | None = None, size: int | None = None, label: str = LABEL) -> EvaluationReport:
    """All views of scored sample rows; pass frozen rows, each view reads them once.

    Frozen rows know their text column and sample size.
    """
    if text is None or size is None:
        known_size, known_text = frozen_settings(scored)
        text, size = text or known_text, size or known_size
    return EvaluationReport(
        distribution=prediction_distribution(scored, "hf_mapped", size=size),
        accuracy=accuracy(scored, label, "hf_mapped"),
        report=classification_report(scored, label, "hf_mapped"),
        confusion=confusion_matrix(scored, label, "hf_mapped"),
        errors=error_examples(scored, label, "hf_mapped", text),
    )


def headline_metrics(scored: DataFrame, label: str = LABEL, prediction: str = "hf_mapped") -> DataFrame:
    """Accuracy over all rows, macro F1 and macro precision, in one row and one pass."""
    return report_scores(scored, label, prediction).select(
        "accuracy", F.col("macro_f1_score").alias("macro_f1"), "macro_precision"
    )


def format_summary(metrics: DataFrame) -> DataFrame:
    """Headline metrics as they are shown, beside the numbers."""
    return metrics.select(
        "accuracy", "macro_f1", "macro_precision",
        fixed(F.col("accuracy"), 4).alias("accuracy_4"),
        fixed(F.col("accuracy"), 3).alias("accuracy_3"),
        percent(F.col("accuracy"), 2).alias("accuracy_percent"),
        percent(F.col("macro_f1"), 2).alias("macro_f1_percent"),
        percent(F.col("macro_precision"), 1).alias("macro_precision_percent"),
    )


def format_report(report: DataFrame) -> DataFrame:
    """A classification report as it is shown: three decimals in every number cell, supports with commas beside."""
    numbers = ("precision", "recall", "f1_score", "support")
    kept = [c for c in report.columns if c not in numbers]
    return report.select(*kept, *(fixed(F.col(c), 3).alias(c) for c in numbers), thousands(F.col("support")).alias("rows"))
