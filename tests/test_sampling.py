import hashlib
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from opinion_spark.operators import sampling as s


def md5(key, salt=""):
    return hashlib.md5(f"{key}-42{salt}".encode()).hexdigest()


@given(some.dictionaries(some.integers(-5, 5), some.integers(2, 5000), min_size=2, max_size=6), some.integers(2, 10))
@settings(max_examples=200, deadline=None)
def test_allocation(counts, step):
    ratio = step * 5 / 100
    total = sum(counts.values())
    n_test = math.ceil(ratio * total)
    if min(n_test, total - n_test) < len(counts):
        with pytest.raises(ValueError):
            s.allocate_test(counts, ratio)
        return
    take = s.allocate_test(counts, ratio)
    assert sum(take.values()) == n_test
    for g, n in counts.items():
        assert abs((n - take[g]) - n * (total - n_test) / total) < 1


def test_allocation_errors():
    with pytest.raises(ValueError):
        s.allocate_test({0: 1, 1: 10}, 0.2)
    with pytest.raises(ValueError):
        s.allocate_test({0: 5, 1: 5}, 1.0)


@pytest.fixture(scope="module")
def labelled(spark):
    return spark.range(3000).select("id", F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 < 9, 0).otherwise(-1).alias("label"))


@pytest.mark.parametrize("ratio", [0.1, 0.25, 0.5])
def test_split_is_exact_and_by_hash_rank(labelled, ratio):
    got = s.stratified_split(labelled, "id", "label", ratio).collect()
    assert len(got) == 3000
    for label, n in ((1, 2100), (0, 600), (-1, 300)):
        ids = sorted((r.id for r in got if r.label == label), key=md5)
        k = round(n * ratio)
        assert {r.id for r in got if r.label == label and r.is_test} == set(ids[:k])


@pytest.mark.parametrize("few, spread", [(1, 6.0), (10, 6.0), (50, 0.0), (200, 0.01)])
def test_cuts_do_not_depend_on_the_search(labelled, few, spread):
    """Small limits and bad guesses force further rounds; the cut stays exact."""
    counts = s.class_sizes(labelled)
    take = {-1: 17, 0: 599, 1: 1000}
    cuts = s.hash_cuts(labelled, "id", F.col("label"), take, counts, few=few, spread=spread)
    ids = {-1: [i for i in range(3000) if i % 10 == 9], 0: [i for i in range(3000) if i % 10 in (7, 8)], 1: [i for i in range(3000) if i % 10 < 7]}
    for g, k in take.items():
        assert cuts[g] == sorted(map(md5, ids[g]))[k - 1]


def test_cuts_with_a_hot_key(spark):
    """A key with a third of all rows ends up on one side, or is refused where the cut would split it; the search ends."""
    df = spark.range(900).select(F.when(F.col("id") < 300, -7).otherwise(F.col("id")).alias("id"))
    hashes = sorted([md5(-7)] * 300 + [md5(i) for i in range(300, 900)])
    hot = hashes.index(md5(-7))
    for take in (hot, hot + 300, hot + 301):
        assert s.hash_cuts(df, "id", F.lit(0), {0: take}, {0: 900}, few=20)[0] == hashes[take - 1]
    with pytest.raises(ValueError, match="repeat"):
        s.hash_cuts(df, "id", F.lit(0), {0: hot + 150}, {0: 900}, few=20)


def test_nothing_and_everything(labelled):
    cuts = s.hash_cuts(labelled, "id", F.lit(0), {0: 0}, {0: 3000})
    assert s.with_draw(labelled, "id", None, cuts).filter("is_test").count() == 0
    cuts = s.hash_cuts(labelled, "id", F.lit(0), {0: 3000}, {0: 3000})
    assert s.with_draw(labelled, "id", None, cuts).filter("is_test").count() == 3000


def test_hash_mode(labelled):
    got = s.stratified_split(labelled, "id", test_size=0.25, mode="hash").filter("is_test").collect()
    assert {r.id for r in got} == {i for i in range(3000) if md5(i) < "4"}
    with pytest.raises(ValueError):
        s.stratified_split(labelled, "id", mode="other")


@pytest.mark.parametrize("size", [50, 400, 2000])
def test_stratified_sample(labelled, size):
    got = s.stratified_sample(labelled, "id", "label", size).collect()
    expected = {1: min(2100, size // 3), 0: min(600, size // 3), -1: min(300, size // 3)}
    assert {g: sum(r.label == g for r in got) for g in expected} == expected
    by_id = sorted(got, key=lambda r: r.eval_id)
    assert [r.eval_id for r in by_id] == list(range(len(got)))
    assert [r.id for r in by_id] == sorted((r.id for r in got), key=lambda i: md5(i, "-order"))


def test_sample_falls_back_without_classes(spark, labelled):
    one = labelled.withColumn("label", F.lit(1))
    assert s.stratified_sample(one, "id", "label", 120).count() == 120
    assert s.stratified_sample(labelled.drop("label"), "id", "label", 120).count() == 120
    got = {r.id for r in s.random_sample(labelled, "id", 100).collect()}
    assert got == set(sorted(range(3000), key=md5)[:100])
    assert s.random_sample(labelled.limit(10), "id", 100).count() == 10


def test_sample_ignores_missing_labels(spark):
    df = spark.range(30).select("id", F.when(F.col("id") < 10, 1).when(F.col("id") < 20, 0).alias("label"))
    assert {r.label for r in s.stratified_sample(df, "id", "label", 50).collect()} == {0, 1}


def test_sample_size_bounds():
    assert s.sample_size(10_000) == 500
    assert s.sample_size(300) == 300
    assert s.sample_size(10_000, 5000, most=5000) == 5000
    assert s.sample_size(20, 100) == 20
    for size in (5000, 10):
        with pytest.raises(ValueError, match="between 50 and 2000"):
            s.sample_size(10_000, size)


@pytest.mark.parametrize("draw", [
    lambda df: s.random_sample(df, "id", 150), lambda df: s.stratified_sample(df, "id", "label", 150), lambda df: s.stratified_split(df, "id"),
])
def test_null_keys_are_refused(spark, draw):
    df = spark.range(200).select(F.when(F.col("id") % 2 == 0, F.col("id")).alias("id"), (F.col("id") % 3).alias("label"))
    with pytest.raises(ValueError, match="NULL keys"):
        draw(df)


def test_search_ends_without_enough_keys(spark):
    df = spark.range(200).select(F.when(F.col("id") < 100, F.col("id")).alias("id"))
    with pytest.raises(ValueError, match="fewer keys"):
        s.hash_cuts(df, "id", F.lit(0), {0: 150}, {0: 200}, few=10)
    with pytest.raises(ValueError, match="fewer keys"):
        s.hash_cuts(df, "id", F.lit(0), {0: 150}, {0: 200})


def test_repeated_keys_are_refused_where_they_break_the_size(spark):
    df = spark.range(200).select((F.col("id") % 4).alias("id"))
    with pytest.raises(ValueError, match="repeat"):
        s.random_sample(df, "id", 10)


@pytest.mark.parametrize("mode", ["exact", "hash"])
@pytest.mark.parametrize("ratio", [0.0, 1.0, -0.1, 1.5])
def test_split_ratio_is_checked(labelled, mode, ratio):
    with pytest.raises(ValueError, match="between 0 and 1"):
        s.stratified_split(labelled, "id", test_size=ratio, mode=mode)


def test_many_classes(spark):
    df = spark.range(12_000).select("id", F.concat(F.lit("c"), F.col("id") % 3000).alias("label"))
    got = s.stratified_split(df, "id", test_size=0.25).groupBy("label").agg(F.count_if("is_test").alias("n")).groupBy("n").count().collect()
    assert [(r.n, r["count"]) for r in got] == [(1, 3000)]
    assert s.stratified_sample(df, "id", "label", 6000).count() == 6000
