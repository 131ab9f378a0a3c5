from collections import Counter

import pytest

from opinion_spark.operators import gram_counts as g
from opinion_spark.operators import tfidf, words

LISTS = [["a", "b", "a", "b"], [], ["b"], None, ["a", "b", "c"], ["é", "a", "b"], ["a"] * 5, ["b"], ["a", "b"]]


@pytest.mark.parametrize("block", [1, 4, 1000])
@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 3), (1, 6)])
def test_grams_equal_brute_force(spark, sizes, block):
    df = spark.createDataFrame([(x,) for x in LISTS], "w array<string>").coalesce(1)
    held, total = Counter(), Counter()
    for x in filter(None, LISTS):
        grams = [" ".join(x[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(x) - n + 1)]
        total.update(grams)
        held.update(set(grams))
    found = g.count_grams(df, "w", sizes, block).groupBy("term").sum("df", "total_tf").collect()
    assert {r[0]: (r[1], r[2]) for r in found} == {t: (held[t], total[t]) for t in total}
    with pytest.raises(ValueError):
        g.count_grams(df, "w", (2, 1))


@pytest.mark.parametrize("block", [1, 4, 1000])
def test_successors_equal_brute_force(spark, block):
    df = spark.createDataFrame([(x,) for x in LISTS], "w array<string>").coalesce(1)
    expected = Counter(p for x in filter(None, LISTS) for p in zip(x, [*x[1:], None]))
    found = g.count_successors(df, "w", block).groupBy("first", "second").sum("n").collect()
    assert {(r[0], r[1]): r[2] for r in found} == expected


def test_occurrences_are_counted_before_the_aggregation(spark):
    """Rows that reach Spark's aggregation: distinct terms of a task, not occurrences."""
    many = spark.createDataFrame([("one two " * 50,)] * 20, "t string").coalesce(1)
    for df in (tfidf.term_statistics(many, "t", stop_words=()), words.count_words(many, "t", stop_words=())):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and "Generate" not in plan
    assert {r.term: (r.df, r.total_tf) for r in tfidf.term_statistics(many, "t", stop_words=()).collect()} == {
        "one": (20, 1000), "two": (20, 1000), "one two": (20, 1000), "two one": (20, 980)}
