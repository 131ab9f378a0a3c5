"""Vocabularies, naive Bayes and splits that stay tables, against the driver-side versions and plain rules."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import class_tables as c
from opinion_spark.operators import sampling, tfidf
from opinion_spark.operators.numbering import numbered
from opinion_spark.operators.term_tables import fit_table_bayes, fit_term_table

WORDS = [f"w{i}x" for i in range(60)]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(WORDS, weights=range(1, 61), k=rng.randint(0, 25))), i % 3 - 1) for i in range(120)] + [(500, None, 1), (501, "", 0), (502, "unseen", -1)]
    return spark.createDataFrame(rows, "id bigint, t string, label int").repartition(5)


@pytest.mark.parametrize("max_features", [None, 40])
def test_vocabulary_and_weights_equal_the_vector_version(docs, max_features):
    table = fit_term_table(docs, "t", min_df=2, max_features=max_features)
    fitted = tfidf.fit_tfidf(docs, "t", min_df=2, max_features=max_features)
    rows = table.terms.orderBy("term_index").collect()
    assert [r.term_index for r in rows] == list(range(len(fitted.terms)))
    assert [r.term for r in rows] == list(fitted.terms) and [r.df for r in rows] == list(fitted.df) and [r.total_tf for r in rows] == list(fitted.total_tf)
    got = {(r.id, r.term): (r.tf, r.weight) for r in table.weights(docs, "id").collect()}
    want = {(r.id, r.term): (r.tf, r.weight) for r in fitted.weights(docs, "id").collect()}
    assert got.keys() == want.keys()
    for k, (tf, weight) in want.items():
        assert got[k][0] == tf and got[k][1] == pytest.approx(weight)


def test_bayes_equals_plain_rules(docs):
    table = fit_term_table(docs, "t", sizes=(1, 1), min_df=1)
    model = fit_table_bayes(table, docs, "id")
    vectors = {}
    for r in table.weights(docs, "id", ["label"]).collect():
        vectors.setdefault((r.id, r.label), {})[r.term] = r.weight
    terms = [r.term for r in table.terms.collect()]
    counts = Counter(r.label for r in docs.collect())
    prior = {k: math.log(n / 123) for k, n in counts.items()}
    sums = {k: Counter() for k in counts}
    for (_, label), v in vectors.items():
        sums[label].update(v)
    theta = {k: {t: math.log((s[t] + 1) / (sum(s.values()) + len(terms))) for t in terms} for k, s in sums.items()}
    for r in model.table().collect():
        assert r.log_theta == pytest.approx(theta[r.label][r.term]) and r.log_prior == pytest.approx(prior[r.label])
    got = {r.id: (r.prediction, r.score) for r in model.predict(docs, "id").collect()}
    assert len(got) == 123
    for r in docs.collect():
        scores = {k: prior[k] + sum(w * theta[k][t] for t, w in vectors.get((r.id, r.label), {}).items()) for k in (-1, 0, 1)}
        assert got[r.id][1] == pytest.approx(max(scores.values())) and scores[got[r.id][0]] == pytest.approx(max(scores.values()))


def test_dense_numbers(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit("a").alias("y")).repartition(7)
    got = numbered(df, [F.desc("x")], "place").collect()
    assert sorted((r.place, r.x) for r in got) == [(i, 999 - i) for i in range(1000)]
    assert numbered(df.limit(0), [F.asc("x")], "place").collect() == []


@pytest.mark.parametrize("few", [10_000, 5])
def test_split_equals_the_driver_side_version(spark, few):
    rng = random.Random(few)
    sizes = [2, 2, 3, 700, *(rng.randint(2, 9) for _ in range(60))]
    rows = [(k, g) for k, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame(rows + [(10**6, None)], "k bigint, g int").repartition(4)
    got = {r.k: r.is_test for r in c.split_classes(df, "k", "g", 0.35, few=few).collect()}
    want = {r.k: r.is_test for r in sampling.stratified_split(df, "k", "g", 0.35).collect()}
    assert got == want and got[10**6] is None


def test_refusals(spark):
    df = spark.createDataFrame([(i, i // 2) for i in range(40)], "k bigint, g int")
    assert c.split_classes(df, "k", "g", 0.5).filter("is_test").count() == 20
    for bad in (0, 1, 0.1):
        with pytest.raises(ValueError):
            c.split_classes(df, "k", "g", bad)
    with pytest.raises(ValueError, match="two rows"):
        c.split_classes(df.filter("k > 0"), "k", "g", 0.5)
    with pytest.raises(ValueError, match="NULL"):
        c.split_classes(df.withColumn("k", F.nullif("k", F.lit(3))), "k", "g", 0.5)


@pytest.mark.parametrize("few", [10_000, 4])
def test_copies_of_keys_are_split_to_the_row(spark, few):
    rng = random.Random(8)
    rows = [(rng.randrange(3), g, "x") for g in range(6) for _ in range(rng.randint(8, 40))] + [(1, 9, "x")] * 50
    df = spark.createDataFrame(rows, "k bigint, g int, extra string").repartition(3)
    out = c.split_classes(df, "k", "g", 0.3, few=few)
    assert out.columns == [*df.columns, "is_test"]
    got = Counter((r.g, r.is_test) for r in out.collect())
    sizes = Counter(g for _, g, _ in rows)
    take = sampling.allocate_test(dict(sorted(sizes.items())), 0.3)
    assert {g: got[g, True] for g in sizes} == take and {g: got[g, False] + got[g, True] for g in sizes} == sizes


def test_only_classes_of_one_remainder_are_put_in_order(spark, monkeypatch):
    ordered = []

    def counting(df, *args):
        ordered.append(df.count())
        return numbered(df, *args)

    monkeypatch.setattr(c, "numbered", counting)
    for sizes, share in [({g: 2 + g % 7 for g in range(70)}, 0.4), ({f"k{g}": 5 for g in range(30)}, 0.3), ({g: 10 for g in range(8)}, 0.5), ({g: 2 + g * g for g in range(12)}, 0.35)]:
        ordered.clear()
        counts = spark.createDataFrame(list(sizes.items()), f"g {'string' if 'k0' in sizes else 'bigint'}, n bigint")
        got = {r.g: (r.n, r["take"]) for r in c.allocate_test_rows(counts, share).collect()}
        take = sampling.allocate_test(dict(sorted(sizes.items())), share)
        assert got == {g: (sizes[g], take[g]) for g in sizes}
        assert sum(ordered) <= max(list(sizes.values()).count(n) for n in sizes.values())
