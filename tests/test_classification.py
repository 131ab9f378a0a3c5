import numpy as np
import pytest

from opinion_spark.operators.classifiers import BAYES, LOGISTIC, balanced_weights, fit_logistic, fit_naive_bayes
from opinion_spark.operators.tfidf import fit_tfidf
from opinion_spark.plans import classification as c
from opinion_spark.sources.bundle import load_model

BAD = ["awful broken thing", "broken awful refund", "terrible awful product", "refund terrible broken"]
MID = ["average plain thing", "plain average product", "average so plain", "plain thing average refund"]
GOOD = ["great lovely product", "lovely great thing", "great product works", "works lovely great"]


@pytest.fixture(scope="module")
def reviews(spark):
    texts = [(t, y) for y, block in ((-1, BAD), (0, MID), (1, GOOD), (1, GOOD), (1, GOOD)) for t in block]
    return spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(texts)], "doc_id bigint, review_text string, label int")


@pytest.fixture(scope="module")
def trained(reviews):
    return c.run_classification(reviews, "review_text", "doc_id", test_size=0.3)


def matrices(vectors, size):
    rows = vectors.collect()
    x = np.zeros((len(rows), size))
    for i, r in enumerate(rows):
        x[i, r.features.indices] = r.features.values
    return x, np.array([r.label for r in rows])


@pytest.mark.parametrize("classes", [(-1, 0, 1), (-1, 1)])
def test_logistic_is_at_the_optimum(reviews, classes):
    df = reviews.filter(reviews.label.isin(*classes))
    tfidf = fit_tfidf(df, "review_text", min_df=1)
    counts = {k: df.filter(df.label == k).count() for k in classes}
    vectors = tfidf.vectors(df)
    model = fit_logistic(vectors, tfidf, counts, tol=1e-10).classifier.stages[0]
    x, y = matrices(vectors, len(tfidf.terms))
    weights = balanced_weights(counts)
    s = np.array([weights[v] for v in y])
    target = np.searchsorted(classes, y)
    w, b = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    z = x @ w.T + b
    if len(classes) == 2:
        p = 1 / (1 + np.exp(-z[:, 0]))
        gradient = (s * (p - target)) @ x + w[0]
    else:
        z -= z.max(1, keepdims=True)
        p = np.exp(z) / np.exp(z).sum(1, keepdims=True)
        gradient = ((p - np.eye(3)[target]) * s[:, None]).T @ x + w
    assert np.abs(gradient).max() < 1e-3


def test_naive_bayes_parameters_and_scores(reviews):
    tfidf = fit_tfidf(reviews, "review_text", min_df=1)
    counts = {-1: 4, 0: 4, 1: 12}
    vectors = tfidf.vectors(reviews).orderBy("doc_id")
    model = fit_naive_bayes(vectors, tfidf, counts)
    x, y = matrices(vectors, len(tfidf.terms))
    sums = np.array([x[y == k].sum(0) for k in counts])
    theta = np.log((sums + 1) / (sums.sum(1, keepdims=True) + x.shape[1]))
    prior = np.log(np.array(list(counts.values())) / 20)
    assert np.allclose(model.classifier.stages[0].theta.toArray(), theta)
    got = model.predict_vectors(vectors, scores=True).orderBy("doc_id").collect()
    scores = x @ theta.T + prior
    assert np.allclose([r.scores for r in got], scores)
    assert [r.prediction for r in got] == [list(counts)[i] for i in scores.argmax(1)]


def test_prior_alone_decides_for_unknown_words(spark, reviews):
    tfidf = fit_tfidf(reviews, "review_text", min_df=1)
    model = fit_naive_bayes(tfidf.vectors(reviews), tfidf, {-1: 4, 0: 4, 1: 12})
    other = spark.createDataFrame([(1, "zzz qqq"), (2, None)], "doc_id bigint, review_text string")
    assert [r.prediction for r in model.predict(other).collect()] == [1, 1]


def test_run(trained):
    summary = trained.summary.collect()
    assert [r.model for r in summary] == [LOGISTIC, BAYES]
    assert all((r.train_size, r.test_size, r.train_percent, r.test_percent) == (14, 6, 70.0, 30.0) for r in summary)
    assert all(r.error is None and r.training_time >= 0 for r in summary)
    confusion = trained.confusion.collect()
    assert len(confusion) == 18
    for r in summary:
        cells = [x for x in confusion if x.model == r.model]
        assert sum(x.n for x in cells) == 6
        assert r.accuracy == pytest.approx(sum(x.n for x in cells if x.actual == x.predicted) / 6)
    assert trained.report.count() == 12
    best = c.best_model(trained.summary).first()
    assert best.model == trained.best.name
    assert c.compare_models(trained.summary).count() == 2


def test_vocabulary_comes_from_training_texts_only(reviews, trained):
    test_ids = {r.doc_id for r in trained.data.test.select("doc_id").collect()}
    seen = " ".join(r.review_text for r in reviews.collect() if r.doc_id not in test_ids).split()
    assert all(word in seen for term in trained.data.tfidf.terms for word in term.split())


def test_save_and_load(reviews, trained, tmp_path, spark):
    path = str(tmp_path / "model")
    result = c.run_classification(reviews, "review_text", "doc_id", test_size=0.3, models=(BAYES,), save_to=path)
    loaded = load_model(spark, path)
    assert (loaded.name, loaded.accuracy, loaded.classes) == (BAYES, result.best.accuracy, (-1, 0, 1))
    before = result.best.predict(reviews).select("doc_id", "prediction").orderBy("doc_id").collect()
    assert loaded.predict(reviews).select("doc_id", "prediction").orderBy("doc_id").collect() == before


def test_model_choice(reviews):
    only = c.run_classification(reviews, "review_text", "doc_id", test_size=0.3, models=("Unknown", BAYES))
    assert list(only.models) == [BAYES]
    none = c.run_classification(reviews, "review_text", "doc_id", test_size=0.3, models=())
    assert none.best is None and none.rows == []
    with pytest.raises(RuntimeError):
        none.report


def test_failures_stay_apart(reviews, monkeypatch):
    def broken(*args, **kwargs):
        raise RuntimeError("no memory")

    monkeypatch.setitem(c.TRAINERS, LOGISTIC, broken)
    result = c.run_classification(reviews, "review_text", "doc_id", test_size=0.3)
    failed, fine = result.summary.collect()
    assert failed.error == "no memory" and failed.accuracy is None
    assert fine.error is None and result.best.name == BAYES
    assert [r.model for r in c.compare_models(result.summary).collect()] == [BAYES]


def test_first_of_equal_models_is_best(spark):
    rows = [("b", 0.5, 1, 1, 80.0, 20.0, 0.1, None, 0), ("a", 0.5, 1, 1, 80.0, 20.0, 0.1, None, 1)]
    assert c.best_model(spark.createDataFrame(rows, c.SUMMARY_SCHEMA)).first().model == "b"


def test_one_class_is_refused(reviews):
    with pytest.raises(ValueError):
        c.run_classification(reviews.filter("label = 1"), "review_text", "doc_id")


def test_counts_and_cuts_read_no_text(spark, tmp_path):
    """Class counts and cuts of a split over a written table scan keys and labels only."""
    from opinion_spark.operators.sampling import class_sizes

    path = str(tmp_path / "t")
    spark.createDataFrame([(i, f"text {i}", i % 3) for i in range(60)], "id bigint, review string, label int").write.parquet(path)
    slim = spark.read.parquet(path).select("id", "label")
    plan = slim.filter("label is not null").groupBy("label").count()._jdf.queryExecution().toString()
    assert "review" not in plan.split("ReadSchema:")[-1]
    assert class_sizes(slim) == {0: 20, 1: 20, 2: 20}
