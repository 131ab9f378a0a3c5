"""Quality of predictions. Each metric is one aggregation over the table.

Every function takes ``weight``, the name of a count column, so that a table
already counted per (label, prediction) gives the same result without
another pass over the predictions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import CLASS_NAMES, CLASSES, LABEL
from opinion_spark.functions.columns import named, ratio
from opinion_spark.functions.display import preview_text
from opinion_spark.functions.labels import label_name
from opinion_spark.operators.statistics import first_rows


MEASURES = ("precision", "recall", "f1_score")


def pair_counts(df: DataFrame, label: str = LABEL, prediction: str = "prediction") -> DataFrame:
    """Rows per (actual, predicted) pair; at most classes squared rows."""
    return df.groupBy(named(label).alias("actual"), named(prediction).alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def accuracy(df: DataFrame, label: str = LABEL, prediction: str = "prediction", weight: str | None = None) -> DataFrame:
    hit = named(label) == named(prediction)
    return df.agg(_rows(hit, weight).alias("hits"), _rows(F.lit(True), weight).alias("n")).select(
        ratio(F.col("hits"), F.col("n")).alias("accuracy"), "n"
    )


def confusion_matrix(
    df: DataFrame,
    label: str = LABEL,
    prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
    weight: str | None = None,
) -> DataFrame:
    """All cells of the matrix in class order, zeros included; other labels are left out."""
    cells = [(a, p) for a in classes for p in classes]
    counts = df.agg(*(
        _rows((named(label) == a) & (named(prediction) == p), weight).alias(f"n{i}") for i, (a, p) in enumerate(cells)
    ))
    rows = [
        F.struct(F.lit(a).alias("actual"), F.lit(p).alias("predicted"), F.col(f"n{i}").alias("n"))
        for i, (a, p) in enumerate(cells)
    ]
    return counts.select(F.inline(F.array(*rows)))


def report_scores(
    df: DataFrame,
    label: str = LABEL,
    prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
    weight: str | None = None,
) -> DataFrame:
    """All measures in one row, from one aggregation.

    Columns ``precision{i}, recall{i}, f1_score{i}, support{i}`` per class,
    the same as ``micro_*, macro_*, weighted_*``, and ``accuracy`` over all
    rows, ``outside`` for rows with a label or prediction not in ``classes``.
    """
    y, p = named(label), named(prediction)
    listed = y.isin(*classes) & p.isin(*classes)
    every = range(len(classes))
    counts = df.agg(
        _rows(F.lit(True), weight).alias("rows"),
        _rows(y == p, weight).alias("hits"),
        _rows(~F.coalesce(listed, F.lit(False)), weight).alias("outside"),
        *(_rows((y == c) & (p == c), weight).alias(f"tp{i}") for i, c in enumerate(classes)),
        *(_rows(y == c, weight).alias(f"support{i}") for i, c in enumerate(classes)),
        *(_rows(p == c, weight).alias(f"predicted{i}") for i, c in enumerate(classes)),
    )
    totals = counts.select(
        "*", *(_total(part, every).alias(part) for part in ("tp", "support", "predicted"))
    )
    scores = totals.select(
        "*", ratio(F.col("hits"), F.col("rows")).alias("accuracy"),
        *(m.alias(f"{name}{i}") for i in every for name, m in _measures(f"tp{i}", f"predicted{i}", f"support{i}").items()),
        *(m.alias(f"micro_{name}") for name, m in _measures("tp", "predicted", "support").items()),
    )
    return scores.select(
        "*",
        *((_total(m, every) / len(classes)).alias(f"macro_{m}") for m in MEASURES),
        *(
            ratio(sum((F.col(f"{m}{i}") * F.col(f"support{i}") for i in every), F.lit(0.0)), F.col("support")).alias(f"weighted_{m}")
            for m in MEASURES
        ),
    )


def classification_report(
    df: DataFrame,
    label: str = LABEL,
    prediction: str = "prediction",
    classes: Sequence[int] = CLASSES,
    names: Mapping[int, str] = CLASS_NAMES,
    weight: str | None = None,
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    Listed classes that do not occur count as 0, as does a division by zero.
    Where labels outside ``classes`` occur, the accuracy row becomes a micro
    average over the listed ones. The accuracy row repeats the accuracy and
    carries the total support.
    """
    def row(name: Column, pattern: str, support: str) -> Column:
        measures = [F.col(pattern.format(m)).alias(m) for m in MEASURES]
        return F.struct(name.alias("class"), *measures, F.col(support).cast("bigint").alias("support"))

    rows = [row(F.lit(names.get(c, str(c))), "{}" + str(i), f"support{i}") for i, c in enumerate(classes)]
    rows += [
        row(F.when(F.col("outside") > 0, "micro avg").otherwise("accuracy"), "micro_{}", "support"),
        row(F.lit("macro avg"), "macro_{}", "support"),
        row(F.lit("weighted avg"), "weighted_{}", "support"),
    ]
    return report_scores(df, label, prediction, classes, weight).select(F.inline(F.array(*rows)))


def error_examples(
    df: DataFrame,
    label: str,
    prediction: str,
    text: str,
    key: str = "eval_id",
    n: int = 10,
    width: int = 200,
) -> DataFrame:
    """The first ``n`` wrong predictions in key order, with class names and a text preview."""
    correct = named(label) == named(prediction)
    return first_rows(df.filter(~correct), key, n).select(
        named(key).alias(key),
        preview_text(named(text), width).alias("preview"),
        label_name(named(label)).alias("actual_name"),
        label_name(named(prediction)).alias("predicted_name"),
    )


def _rows(condition: Column, weight: str | None) -> Column:
    if weight is None:
        return F.count_if(condition)
    return F.coalesce(F.sum(F.when(condition, named(weight))), F.lit(0)).cast("bigint")


def _total(prefix: str, indexes) -> Column:
    return sum((F.col(f"{prefix}{i}") for i in indexes), F.lit(0))


def _measures(tp: str, predicted: str, support: str) -> dict[str, Column]:
    return {
        "precision": ratio(F.col(tp), F.col(predicted)),
        "recall": ratio(F.col(tp), F.col(support)),
        "f1_score": ratio(2 * F.col(tp), F.col(predicted) + F.col(support)),
    }
