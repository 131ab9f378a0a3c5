"""Labels: from ratings, from the raw output of a scorer, and for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import CLASS_NAMES, LABEL, RATING
from opinion_spark.functions.columns import lookup


def rating_to_label(rating: Column, null_policy: str = "positive") -> Column:
    """-1 up to two stars, 0 for three, else 1.

    A missing or NaN rating meets neither test and becomes 1;
    ``null_policy="drop"`` gives NULL instead, for the caller to filter.
    """
    if null_policy not in ("positive", "drop"):
        raise ValueError(f"unknown null_policy {null_policy!r}")
    label = F.when(rating <= 2, -1).when(rating == 3, 0).otherwise(1)
    if null_policy == "drop":
        label = F.when(rating.isNotNull() & ~F.isnan(rating.cast("double")), label)
    return label.cast("int")


def with_label(df: DataFrame, null_policy: str = "positive") -> DataFrame:
    """Add ``label`` from ``numeric_rating`` unless the table has it already."""
    if LABEL in df.columns or RATING not in df.columns:
        return df
    out = df.withColumn(LABEL, rating_to_label(F.col(RATING), null_policy))
    return out.filter(F.col(LABEL).isNotNull()) if null_policy == "drop" else out


# What a raw label must contain, in order of precedence.
RAW_LABEL_MARKS = ((-1, ("neg", "-1")), (0, ("neu", "0")), (1, ("pos", "+1")))
STAR_MARK = "star"
STAR_LABELS = {"1": -1, "2": -1, "3": 0, "4": 1, "5": 1}


def normalize_label(raw: Column) -> Column:
    """A scorer's own label as -1, 0 or 1; 0 when it is missing or unknown."""
    mark = F.lower(F.trim(raw.cast("string")))
    rules: list[tuple[Column, int]] = []
    for label, needles in RAW_LABEL_MARKS:
        rules += [(mark.contains(needle), label) for needle in needles]
    rules += [(mark.contains(STAR_MARK) & mark.contains(digit), label) for digit, label in STAR_LABELS.items()]
    chain = F.when(mark.isNull(), 0)
    for condition, label in rules:
        chain = chain.when(condition, label)
    return chain.otherwise(0).cast("int")


def label_name(label: Column) -> Column:
    return lookup(label, CLASS_NAMES)
