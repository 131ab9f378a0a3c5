import math
import re
from collections import Counter

import pytest
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from opinion_spark.functions.stop_words import CLOUD, ENGLISH, FEATURE, load_stop_words
from opinion_spark.functions.text import prepare_text
from opinion_spark.operators import tfidf as t

TEXTS = [
    "The été was hot, the ÉTÉ is over", "hot hot summer; don't go", "summer was over and hot", "A_b 12 x y zz", "",
    "hot summer over été", None, "the of and", "summer hot été 12 over",
]


def grams(text, stops=frozenset(FEATURE), high=2):
    tokens = [w for w in re.findall(r"\w\w+", text.lower()) if w not in stops]
    return [" ".join(tokens[i : i + n]) for n in range(1, high + 1) for i in range(len(tokens) - n + 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id bigint, t string")


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2), (2, 2), (1, 3)])
def test_terms(docs, sizes):
    for r in t.tokenize(docs.filter("t IS NOT NULL"), "t", sizes=sizes).collect():
        low, high = sizes
        expected = [g for n in range(low, high + 1) for g in grams(r.t, high=high) if g.count(" ") == n - 1]
        assert r.terms == expected


def test_fit_and_weights_equal_brute_force(docs):
    fitted = t.fit_tfidf(docs, "t", min_df=2, max_df=0.9)
    lists = {i: grams(x) for i, x in enumerate(TEXTS) if x is not None}
    df, tf = Counter(), Counter()
    for terms in lists.values():
        df.update(set(terms))
        tf.update(terms)
    kept = sorted(x for x in df if df[x] >= 2 and df[x] <= 0.9 * len(lists))
    assert list(fitted.terms) == kept
    assert list(fitted.df) == [df[x] for x in kept] and list(fitted.total_tf) == [tf[x] for x in kept]
    idf = {x: math.log((1 + len(lists)) / (1 + df[x])) + 1 for x in kept}
    assert fitted.idf == pytest.approx([idf[x] for x in kept])
    got = {(r.id, r.term): (r.tf, r.weight) for r in fitted.weights(docs, "id").collect()}
    expected = {}
    for i, terms in lists.items():
        raw = {x: c * idf[x] for x, c in Counter(terms).items() if x in idf}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        expected |= {(i, x): (Counter(terms)[x], w / norm) for x, w in raw.items()}
    assert got.keys() == expected.keys()
    for k, (count, weight) in expected.items():
        assert got[k][0] == count and got[k][1] == pytest.approx(weight)


def test_long_form_equals_vectors(docs):
    fitted = t.fit_tfidf(docs, "t", min_df=1)
    vectors = {r.id: r.features for r in fitted.vectors(docs).collect()}
    assert len(vectors) == len(TEXTS)
    for i, v in vectors.items():
        assert v.norm(2) == pytest.approx(1) or v.numNonzeros() == 0


def test_cap_keeps_most_frequent_then_alphabetic(spark):
    df = spark.createDataFrame([("bb aa cc dd dd",), ("bb aa cc dd",), ("bb aa cc",)], "t string")
    fitted = t.fit_tfidf(df, "t", sizes=(1, 1), min_df=1, max_df=1.0, max_features=3)
    assert fitted.terms == ("aa", "bb", "dd") or fitted.terms == ("aa", "bb", "cc")
    counts = Counter("bb aa cc dd dd bb aa cc dd bb aa cc".split())
    assert fitted.terms == tuple(sorted(sorted(counts, key=lambda w: (-counts[w], w))[:3]))


def test_empty_vocabulary_is_an_error(spark):
    with pytest.raises(ValueError):
        t.fit_tfidf(spark.createDataFrame([("the of and",)], "t string"), "t")


def test_unseen_terms_do_not_count(spark, docs):
    fitted = t.fit_tfidf(docs, "t", min_df=2)
    other = spark.createDataFrame([(1, "qqq www hot")], "id bigint, t string")
    assert [r.term for r in fitted.weights(other, "id").collect()] == ["hot"]


def test_plan_has_no_shuffle_by_document(docs):
    plan = t.term_statistics(docs, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    vectors = t.fit_tfidf(docs, "t", min_df=1).vectors(docs)
    assert "Exchange" not in vectors._jdf.queryExecution().executedPlan().toString()


def test_stop_word_lists(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")
    assert load_stop_words("english") == ENGLISH and load_stop_words("cloud") == CLOUD
    assert load_stop_words() == FEATURE and len(FEATURE) == 318 and not any("'" in w for w in FEATURE)
    assert load_stop_words("none") == () and load_stop_words(["A", "a", "B"]) == ("a", "b")
    assert "avec" in load_stop_words("french")


def test_prepare_text(spark):
    df = spark.createDataFrame([(1, "x" * 3000), (2, "  \n "), (3, None), (4, "ok")], "id int, t string")
    got = {r.id: r.scored_text for r in prepare_text(df, "t", max_chars=2000).collect()}
    assert {k: len(v) for k, v in got.items()} == {1: 2000, 4: 2}
    kept = {r.id: r.scored_text for r in prepare_text(df, "t", max_chars=None, drop_blank=False, missing="nan").collect()}
    assert len(kept[1]) == 3000 and kept[3] == "nan" and set(kept) == {1, 2, 3, 4}
    assert prepare_text(df, "t").filter(F.length("t") > 2000).count() == 1


@pytest.mark.parametrize("build", ["term_statistics", "count_words"])
def test_texts_are_split_once(docs, build):
    """No derived filter repeats the tokenising, and no text is shuffled."""
    from opinion_spark.operators.words import count_words

    df = t.term_statistics(docs, "t") if build == "term_statistics" else count_words(docs, "t")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("Exchange") == 1
