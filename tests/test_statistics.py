import math

import numpy as np
import pytest
from conftest import rows

from opinion_spark.operators import statistics as st


@pytest.mark.parametrize("values", [
    [1.0, 2.0, 2.0, 3.5, 5.0], [3.0, 3.0, 3.0], [0.0, 10.0], [0.1 * i for i in range(11)], [-3.0, 7.5, 1e6],
])
def test_histogram_equals_numpy(spark, values):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (math.nan,)], "x double")
    got = st.histogram(df, "x", 5).orderBy("bin").collect()
    counts, edges = np.histogram(values, bins=5)
    assert [r.n for r in got] == counts.tolist()
    assert np.allclose([r.bin_start for r in got] + [got[-1].bin_end], edges)


def test_counts_and_distribution(spark):
    df = spark.createDataFrame([(1,), (1,), (0,), (-1,), (None,)], "label int")
    assert tuple(st.sentiment_counts(df).first()) == (5, 2, 1, 1)
    assert rows(st.distribution(df, "label")) == [(-1, 1), (0, 1), (1, 2)]
    assert st.review_count(df).first().n_reviews == 5


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "bbaaccd"] + [(None,)], "country string")
    assert [tuple(r) for r in st.top_values(df, "country", 3).collect()] == [("a", 2), ("b", 2), ("c", 2)]


def test_class_guard(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "label int")
    with pytest.raises(ValueError):
        st.require_classes(df)
    assert st.require_classes(df, at_least=1) == 1


def test_prediction_distribution_fills_zeros(spark):
    df = spark.createDataFrame([(1,), (1,), (-1,)], "hf_mapped int")
    got = st.prediction_distribution(df, "hf_mapped", size=10).collect()
    assert [(r.prediction, r.n, r.share) for r in got] == [(-1, 1, 0.1), (0, 0, 0.0), (1, 2, 0.2)]
    actual = st.prediction_distribution(df, "hf_mapped", "actual").collect()
    assert math.isclose(sum(r.share for r in actual), 1)
    with pytest.raises(ValueError):
        st.prediction_distribution(df, "hf_mapped")


def test_first_rows(spark):
    df = spark.range(100).selectExpr("(id * 37) % 101 AS k", "id")
    assert [r.k for r in st.first_rows(df, "k", 5).collect()] == [0, 1, 2, 3, 4]
    assert st.first_rows(df.limit(0), "k", 5).collect() == []


def test_alignment(spark):
    assert st.assert_aligned(spark.range(3), spark.range(3)) == 3
    with pytest.raises(AssertionError):
        st.assert_aligned(spark.range(3), spark.range(4))
