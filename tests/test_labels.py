import math

import pytest
from pyspark.sql import functions as F

from opinion_spark.functions.display import fixed, percent, preview_text, round_even, short_name, thousands
from opinion_spark.functions.labels import label_name, normalize_label, rating_to_label, with_label

RATINGS = [(1.0, -1), (2.0, -1), (2.5, 1), (3.0, 0), (4.0, 1), (5.0, 1), (None, 1), (math.nan, 1)]

RAW = [
    (None, 0), (" Negative ", -1), ("non-negative", -1), ("neutral-positive", 0), ("LABEL_0", 0), ("LABEL_1", 0),
    ("LABEL_2", 0), ("+1", 1), ("-1 star", -1), ("1 star", -1), ("2 stars", -1), ("3 stars", 0), ("4 stars", 1),
    ("5 stars", 1), ("10 stars", 0), ("15 stars", -1), ("4.5 stars", 1), ("6 stars", 0), ("", 0), ("POSITIVE", 1),
    ("\tpos\n", 1), ("stars", 0), ("3 2 star", -1),
]


def test_rating_to_label(spark):
    df = spark.createDataFrame(RATINGS, "numeric_rating double, expected int")
    assert [r.label for r in with_label(df).collect()] == [e for _, e in RATINGS]


def test_rating_drop_policy(spark):
    df = spark.createDataFrame(RATINGS, "numeric_rating double, expected int")
    kept = with_label(df, "drop").collect()
    assert [r.label for r in kept] == [e for r, e in RATINGS if r is not None and not math.isnan(r)]
    with pytest.raises(ValueError):
        rating_to_label(F.lit(1.0), "other")


def test_existing_label_is_kept(spark):
    df = spark.createDataFrame([(5.0, -1)], "numeric_rating double, label int")
    assert with_label(df).first().label == -1
    bare = spark.createDataFrame([(1,)], "x int")
    assert with_label(bare).columns == ["x"]


def test_normalize_label(spark):
    df = spark.createDataFrame(RAW, "raw string, expected int")
    got = df.select("raw", normalize_label(F.col("raw")).alias("mapped")).collect()
    assert [(r.raw, r.mapped) for r in got] == RAW


def test_names_and_formats(spark):
    df = spark.createDataFrame([(-1, 0.125, "a/b/model-name"), (0, 0.5, "plain"), (1, 2 / 3, "x/y")], "label int, x double, m string")
    got = df.select(
        label_name(F.col("label")).alias("n"), round_even(F.col("x"), 2).alias("r"), fixed(F.col("x"), 4).alias("f"),
        percent(F.col("x"), 1).alias("p"), short_name(F.col("m"), 5).alias("s"), preview_text(F.col("m"), 3).alias("t"),
    ).collect()
    assert [r.n for r in got] == ["Négatif", "Neutre", "Positif"]
    assert [r.r for r in got] == [0.12, 0.5, 0.67]
    assert [r.f for r in got] == ["0.1250", "0.5000", "0.6667"]
    assert [r.p for r in got] == ["12.5%", "50.0%", "66.7%"]
    assert [r.s for r in got] == ["model", "plain", "y"]
    assert [r.t for r in got] == ["a/b...", "pla...", "x/y..."]


def test_display_rounds_the_exact_value(spark):
    """Decimal ties that no double holds, ties that it does, and small and negative numbers, as Python shows them."""
    values = [0.12345, 0.54325, 2.675, 0.125, 0.375, 0.00005, 0.0, 1.0, -0.0, -0.5, -2.675, 1e-30, 123.4565, 0.99995, 1 / 3, 5e-324, 99999.00005]
    values += [(k % 20000) / 20000 for k in range(0, 20000, 7)] + [k / 8 for k in range(-9, 40)] + [k / 65536 for k in range(1, 400)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 1, 2, 3, 4):
        got = df.select("x", fixed(F.col("x"), digits).alias("f"), round_even(F.col("x"), digits).alias("r")).collect()
        for r in got:
            want = f"{r.x:.{digits}f}"
            assert r.f in (want, want.replace("-", "") if float(want) == 0 else want, "-" + want if r.x < 0 and float(want) == 0 else want)
            assert r.r == float(want)


def test_thousands(spark):
    got = spark.range(1).select(thousands(F.lit(1234567)).alias("a"), thousands(F.lit(12)).alias("b")).first()
    assert (got.a, got.b) == ("1,234,567", "12")


def test_display_of_large_numbers_and_neighbours_of_ties(spark):
    """Where product and rest both count: near ties, and above 2^52, where the product has no fraction."""
    values = [2.0**52 - 0.5, 2.0**52 + 1, 2.0**53 - 1, 2.0**60, 4503599627370.49951, 9007199254.740992, 0.49999999999999994]
    values += [math.nextafter(k / 2000, to) for k in range(1, 4000, 37) for to in (0, 10)] + [(k + 0.5) / 1000 for k in range(0, 10**7, 99991)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    for digits in (0, 3, 4, 6):
        rows = df.filter(F.col("x") < 9e18 / 10**digits).select("x", fixed(F.col("x"), digits).alias("f")).collect()
        assert [r.f for r in rows] == [f"{r.x:.{digits}f}" for r in rows]


def test_rounding_needs_no_decimals(spark):
    plan = spark.range(9).select(round_even(F.col("id") / 8, 2))._jdf.queryExecution().executedPlan().toString()
    assert "decimal" not in plan.lower()
