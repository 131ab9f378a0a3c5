import pandas as pd
import pytest
from pyspark.sql import functions as F

from opinion_spark.operators import scoring as s
from opinion_spark.operators.lexicon import lexicon_scorer
from opinion_spark.operators.metrics import error_examples
from opinion_spark.plans.evaluation import evaluation_report, format_summary, headline_metrics
from opinion_spark.streaming.scores import read_text_stream, score_stream, write_scores

TEXTS = [
    (1, "you idiot, you trash"), (2, "such a clown"), (3, "nice"), (4, "word " * 200), (5, "   "), (6, None),
    (7, "x" * 2000 + " idiot trash"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string")


def scored(df, **options):
    return {r.doc_id: (r.hf_label, round(r.hf_score, 6), r.hf_mapped) for r in s.score(df, "text", lexicon_scorer, **options).collect()}


def test_scores(docs):
    whole = {1: ("1 star", 0.75, -1), 2: ("2 stars", 0.666667, -1), 3: ("3 stars", 0.5, 0), 4: ("5 stars", 0.5, 1), 7: ("1 star", 0.75, -1)}
    assert scored(docs) == whole
    assert scored(docs, max_chars=2000) == {**whole, 7: ("5 stars", 0.5, 1)}


def test_whole_texts_and_missing_ones(docs):
    got = scored(docs, drop_blank=False, missing="nan")
    assert got[7] == ("1 star", 0.75, -1)
    assert got[6] == got[5] == ("3 stars", 0.5, 0)


def test_original_columns_stay(docs):
    out = s.score(docs, "text", lexicon_scorer, model="m/n")
    assert out.columns == ["doc_id", "text", "hf_label", "hf_score", "hf_mapped", "model"]
    assert out.filter("doc_id = 7").first().text.endswith("trash") and out.first().model == "m/n"


def test_errors(docs):
    def broken():
        def batch(texts):
            raise RuntimeError("no model")
        return batch

    with pytest.raises(Exception, match="no model"):
        s.score(docs, "text", broken).collect()
    got = s.score(docs, "text", broken, model="broken-null", on_error="null").collect()
    assert {(r.hf_label, r.hf_score, r.hf_mapped) for r in got} == {(None, 0.0, 0)}
    with pytest.raises(ValueError):
        s.score(docs, "text", broken, on_error="skip")


def test_one_bad_text_fails_alone(spark):
    def strict():
        def batch(texts):
            if texts.str.contains("bad").any():
                raise RuntimeError("bad text")
            return pd.DataFrame({"label": ["POSITIVE"] * len(texts), "score": texts.str.len() / 100})
        return batch

    rows = [(i, "bad" if i == 4321 else "x" * (1 + i % 50)) for i in range(10_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in s.score(df, "text", strict, model="strict", on_error="null").collect()}
    assert len(got) == 10_000 and [i for i, r in got.items() if r.hf_label is None] == [4321]
    assert (got[4321].hf_score, got[4321].hf_mapped) == (0.0, 0)
    assert all(r.hf_score == pytest.approx(len(r.text) / 100) and r.hf_mapped == 1 for i, r in got.items() if i != 4321)
    with pytest.raises(Exception, match="bad text"):
        s.score(df, "text", strict, model="strict").collect()


def test_isolation_takes_logarithmic_calls():
    for n, bad in [(1, {0}), (1000, {0}), (1000, {999}), (1000, {3, 500}), (10_000, {7777}), (64, set())]:
        calls = []

        def batch(texts, bad=bad, calls=calls):
            calls.append(len(texts))
            if set(texts) & {str(b) for b in bad}:
                raise ValueError("bad")
            return pd.DataFrame({"label": texts, "score": 1.0})

        out = s.run_isolated(batch, pd.Series([str(i) for i in range(n)]))
        assert [None if i in bad else str(i) for i in range(n)] == [None if pd.isna(v) else v for v in out["label"]]
        assert len(calls) <= 1 + len(bad) * 2 * (n - 1).bit_length()


def test_a_wrong_number_of_results_is_a_failure():
    out = s.run_isolated(lambda texts: pd.DataFrame({"label": ["a"], "score": [1.0]}), pd.Series(["x", "y", "z"]))
    assert list(out["label"]) == ["a"] * 3


def test_a_model_that_cannot_be_loaded_fails_the_job(docs):
    def unloadable():
        raise RuntimeError("no weights")

    with pytest.raises(Exception, match="no weights"):
        s.score(docs, "text", unloadable, on_error="null").collect()


def test_calls_are_bounded_in_bytes():
    texts = pd.Series(["x" * (n * 7919 % 1000) for n in range(500)] + ["é" * 700_000, None, "", "y" * 1_000_000])
    calls = s.call_places(texts, 10_000)
    assert sorted(i for c in calls for i in c.tolist()) == list(range(len(texts)))
    size = lambda i: len((texts[i] or "").encode())
    assert all(len(c) == 1 or sum(map(size, c)) <= 10_000 for c in calls)
    assert [size(i) for c in calls for i in c] == sorted(map(size, range(len(texts))))
    assert s.call_places(pd.Series([], dtype=object), 10) == [] and len(s.call_places(pd.Series(["aa", "b"]), 1)) == 2


def test_results_keep_their_rows_at_any_budget(spark):
    rows = [(i, f"{i} " + "word " * (i * 37 % 300)) for i in range(400)] + [(400, "big " * 250_000), (401, None), (402, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)

    def lengths():
        def batch(texts):
            total = sum(len(t.encode()) for t in texts)
            if len(texts) > 1 and total > 5_000:
                raise RuntimeError("too many bytes in a call")
            return pd.DataFrame({"label": texts.str.split().str[0], "score": texts.str.len().astype(float)})
        return batch

    got = {r.doc_id: (r.hf_label, r.hf_score) for r in s.score(df, "text", lengths, model="lengths", call_bytes=5_000, drop_blank=False, missing="nan").collect()}
    assert all(got[i] == (t.split()[0], len(t)) for i, t in rows if t and t.strip()) and len(got) == 403
    with pytest.raises(ValueError):
        s.score(df, "text", lengths, call_bytes=0)


def test_missing_scores_become_zero(docs):
    def unscored():
        return lambda texts: pd.DataFrame({"label": ["POSITIVE"] * len(texts)})

    assert {(r.hf_score, r.hf_mapped) for r in s.score(docs, "text", unscored).collect()} == {(0.0, 1)}


def test_registry():
    s.register_scorer("words", lexicon_scorer)
    assert s.scorer_factory("words") is lexicon_scorer
    with pytest.raises(ValueError, match="no scorer"):
        s.scorer_factory("some/model")


def test_models_are_loaded_once_and_few_are_kept():
    s._loaded.clear()
    loads = []
    for name in ["a", "b", "a", "c", "d", "a", "b"]:
        s._worker_model(name, lambda: loads.append(name) or len)
    assert loads == ["a", "b", "c", "d", "b"] and len(s._loaded) == s.MODELS_PER_WORKER
    s._loaded.clear()


def test_stream_equals_batch(spark, docs, tmp_path):
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.repartition(3).write.parquet(source)
    stream = read_text_stream(spark, source, docs.schema)
    write_scores(score_stream(stream, "text", lexicon_scorer), sink, state).awaitTermination()
    key = lambda r: r.doc_id
    batch = s.score(docs, "text", lexicon_scorer)
    assert sorted(spark.read.parquet(sink).select(*batch.columns).collect(), key=key) == sorted(batch.collect(), key=key)
    with pytest.raises(ValueError):
        score_stream(docs, "text", lexicon_scorer)


def test_evaluation(spark):
    data = [(i, ["you idiot trash", "fine", "word " * 200][i % 3] + f" n{i}", [-1, 0, 1][i % 3 if i % 5 else 0]) for i in range(150)]
    df = spark.createDataFrame([*data, (999, None, 1)], "doc_id bigint, review_text string, label int")
    out = s.evaluate_sample(df, "doc_id", "review_text", lexicon_scorer, 90).persist()
    assert out.count() == 90 and out.filter("review_text IS NULL").count() == 0
    assert out.columns == ["eval_id", "review_text", "label", "hf_label", "hf_score", "hf_mapped", "model"]
    assert {r.label: r["count"] for r in out.groupBy("label").count().collect()} == {-1: 30, 0: 30, 1: 30}
    report = evaluation_report(out, "review_text", 90)
    assert sum(r.n for r in report.distribution.collect()) == sum(r.n for r in report.confusion.collect()) == 90
    accuracy = report.accuracy.first().accuracy
    shown = format_summary(headline_metrics(out)).first()
    assert shown.accuracy == pytest.approx(accuracy) and shown.accuracy_percent == f"{accuracy:.2%}"
    assert report.errors.count() == min(10, round((1 - accuracy) * 90))
    assert report.report.count() == 6


def test_conditions_on_results_score_the_sample_alone(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(300)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/texts")
    spark.createDataFrame([(i, (-1, 0, 1)[i % 3]) for i in range(300)], "mark_id bigint, label int").write.parquet(f"{tmp_path}/marks")
    marked = spark.read.parquet(f"{tmp_path}/texts").join(spark.read.parquet(f"{tmp_path}/marks"), F.col("doc_id") == F.col("mark_id")).drop("mark_id")

    def scorer(only):
        def factory():
            def batch(texts):
                if only and not set(texts) <= only:
                    raise RuntimeError("a text outside the sample was scored")
                return pd.DataFrame({"label": ["POSITIVE"] * len(texts), "score": [1.0] * len(texts)})
            return batch
        return factory

    drawn = {r.text for r in s.evaluate_sample(marked, "doc_id", "text", scorer(None), 30, model="any").collect()}
    assert len(drawn) == 30
    sample = s.evaluate_sample(marked, "doc_id", "text", scorer(drawn), 30, model="sample-only")
    wrong = error_examples(sample, "label", "hf_mapped", "text", n=50).collect()
    assert len(wrong) == 20 and {r.predicted_name for r in wrong} == {"Positif"}
    some = marked.filter("label = 1")
    scored = s.score(some, "text", scorer({r.text for r in some.collect()}), model="joined-only")
    assert scored.filter("label = hf_mapped").count() == 100
