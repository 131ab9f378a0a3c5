"""Counts, distributions, histograms, top lists and previews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import CLASS_NAMES, CLASSES, LABEL, RATING
from opinion_spark.functions.columns import named
from opinion_spark.sources.roles import ReviewSchema


def review_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_reviews"))


def sentiment_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """All rows and the rows of each class, in one pass."""
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(named(label) == 1).alias("positive"),
        F.count_if(named(label) == 0).alias("neutral"),
        F.count_if(named(label) == -1).alias("negative"),
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Rows per value; NULL is not a value."""
    return df.filter(named(column).isNotNull()).groupBy(named(column)).agg(F.count(F.lit(1)).alias("n"))


def top_values(df: DataFrame, column: str, k: int = 10, names: tuple[str, str] = ("Pays", "Nombre")) -> DataFrame:
    """The ``k`` most frequent values; equal counts in value order."""
    value, count = names
    return (
        df.filter(named(column).isNotNull())
        .groupBy(named(column).alias(value))
        .agg(F.count(F.lit(1)).alias(count))
        .orderBy(F.desc(count), F.asc(value))
        .limit(k)
    )


def histogram(df: DataFrame, column: str = RATING, bins: int = 5) -> DataFrame:
    """Rows per equal-width bin over [min, max]; the last bin includes its right edge.

    Empty bins are listed. A constant column gets a range of one around its
    value. One pass finds the range, a second one fills all bins at once.
    """
    x = named(column).cast("double")
    values = df.select(x.alias("x")).filter(F.col("x").isNotNull() & ~F.isnan("x"))
    low, high = F.min("x"), F.max("x")
    pad = F.when(low == high, 0.5).otherwise(0.0)
    bounds = values.agg(F.struct((low - pad).alias("lo"), (high + pad).alias("hi")).alias("r")).select("r")
    placed = values.select("x", bounds.scalar().alias("r")).select(
        "x", F.col("r.lo").alias("lo"), F.col("r.hi").alias("hi"),
        ((F.col("r.hi") - F.col("r.lo")) / bins).alias("step"),
    )
    edge = [F.col("lo") + F.lit(float(i)) * F.col("step") for i in range(bins)] + [F.col("hi")]
    first, last = edge[:-1], edge[1:]
    counts = placed.agg(
        F.min("lo").alias("lo"), F.min("hi").alias("hi"), F.min("step").alias("step"),
        *(
            F.count_if((F.col("x") >= a) & (F.lit(True) if i == bins - 1 else F.col("x") < b)).alias(f"n{i}")
            for i, (a, b) in enumerate(zip(first, last))
        ),
    )
    rows = [
        F.struct(F.lit(i + 1).alias("bin"), a.alias("bin_start"), b.alias("bin_end"), F.col(f"n{i}").alias("n"))
        for i, (a, b) in enumerate(zip(first, last))
    ]
    return counts.select(F.inline(F.array(*rows)))


def class_count(df: DataFrame, label: str = LABEL) -> DataFrame:
    return df.agg(F.count_distinct(named(label)).alias("n_classes"))


def require_classes(df: DataFrame, label: str = LABEL, at_least: int = 2) -> int:
    """The count of classes; fails where there are fewer than needed."""
    found = class_count(df, label).first().n_classes
    if found < at_least:
        raise ValueError(f"the table has {found} classes, at least {at_least} are needed")
    return found


def prediction_distribution(
    df: DataFrame,
    column: str,
    denominator: str = "requested",
    size: int | None = None,
    classes: Sequence[int] = CLASSES,
) -> DataFrame:
    """Rows and share per predicted class in class order; absent classes have 0.

    ``requested`` divides by the sample size asked for, so shares need not add
    up to one when a class was too small; ``actual`` divides by all rows.
    """
    if denominator not in ("requested", "actual"):
        raise ValueError(f"unknown denominator {denominator!r}")
    if denominator == "requested" and not size:
        raise ValueError("the requested size is needed")
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count_if(named(column) == c).alias(f"n{i}") for i, c in enumerate(classes)),
    )
    base = F.lit(size).cast("double") if denominator == "requested" else F.col("rows").cast("double")
    rows = [
        F.struct(
            F.lit(c).alias("prediction"),
            F.lit(CLASS_NAMES.get(c, str(c))).alias("sentiment"),
            F.col(f"n{i}").alias("n"),
            F.coalesce(F.try_divide(F.col(f"n{i}").cast("double"), base), F.lit(0.0)).alias("share"),
        )
        for i, c in enumerate(classes)
    ]
    return counts.select(F.inline(F.array(*rows))).orderBy("prediction")


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows with the smallest keys, in key order.

    The cut is found on the key column alone, so that only rows at or below it
    are read in full; long texts of other rows never reach the sort.
    """
    smallest = df.select(named(key).alias("k")).filter(F.col("k").isNotNull()).orderBy("k").limit(n)
    cut = smallest.agg(F.max("k").alias("cut"))
    return df.filter(named(key) <= cut.scalar()).orderBy(named(key)).limit(n)


def preview(df: DataFrame, key: str, n: int = 30) -> DataFrame:
    return first_rows(df, key, n)


def cleaned_dataset(df: DataFrame, schema: ReviewSchema) -> DataFrame:
    """The columns of the cleaned table: text, title, rating, label, country."""
    return df.select(*(named(c) for c in schema.export_columns()))


def complete_cases(df: DataFrame, text: str, label: str = LABEL, keep: Sequence[str] = ()) -> DataFrame:
    """Text (as string) and label of the rows that have both; ``keep`` adds columns."""
    ready = df.select(*(named(c) for c in dict.fromkeys([*keep, text, label]))).dropna(subset=[text, label])
    return ready.withColumn(text, named(text).cast("string"))


def assert_aligned(*tables: DataFrame) -> int:
    """The common row count of tables that must run row by row alongside."""
    counts = [t.count() for t in tables]
    if len(set(counts)) > 1:
        raise AssertionError(f"row counts differ: {counts}")
    return counts[0]


def alignment(counts: dict[str, Column], df: DataFrame) -> DataFrame:
    """Row counts of one pass over ``df`` beside whether they all agree."""
    agg = df.agg(*(F.count_if(c).alias(name) for name, c in counts.items()))
    names = list(counts)
    equal = F.lit(True)
    for name in names[1:]:
        equal = equal & (F.col(names[0]) == F.col(name))
    return agg.withColumn("aligned", equal)
