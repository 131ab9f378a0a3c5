import random

import numpy as np
import pytest

from opinion_spark.operators import metrics as m


def brute_report(pairs, classes=(-1, 0, 1)):
    out, support_all = {}, 0
    for c in classes:
        tp = sum(y == c and p == c for y, p in pairs)
        predicted, support = sum(p == c for _, p in pairs), sum(y == c for y, _ in pairs)
        precision = tp / predicted if predicted else 0.0
        recall = tp / support if support else 0.0
        f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
        out[c] = (precision, recall, f1, support)
        support_all += support
    table = np.array([out[c] for c in classes])
    macro = table[:, :3].mean(0)
    weighted = (table[:, :3] * table[:, 3:]).sum(0) / support_all if support_all else np.zeros(3)
    return table, macro, weighted, support_all


CASES = {
    "all right": [(-1, -1), (0, 0), (1, 1)],
    "all wrong": [(-1, 1), (0, -1), (1, 0)],
    "class never predicted": [(-1, 1), (0, 0), (1, 1), (1, 0)],
    "class absent from truth": [(1, -1), (1, 1), (0, 0)],
    "random": [(random.Random(i).choice([-1, 0, 1]), random.Random(i + 1000).choice([-1, 0, 1])) for i in range(200)],
}


@pytest.mark.parametrize("name", CASES)
def test_report(spark, name):
    pairs = CASES[name]
    df = spark.createDataFrame(pairs, "label int, prediction int")
    got = {r["class"]: r for r in m.classification_report(df).collect()}
    table, macro, weighted, total = brute_report(pairs)
    for display, row in zip(("Négatif", "Neutre", "Positif"), table):
        r = got[display]
        assert np.allclose([r.precision, r.recall, r.f1_score, r.support], row)
    assert np.allclose(list(got["macro avg"])[1:4], macro)
    assert np.allclose(list(got["weighted avg"])[1:4], weighted)
    hits = sum(y == p for y, p in pairs) / len(pairs)
    assert np.allclose(list(got["accuracy"])[1:4], hits) and got["accuracy"].support == total
    assert m.accuracy(df).first().accuracy == pytest.approx(hits)


def test_labels_outside_the_classes(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (0, 2), (-1, -1)], "label int, prediction int")
    got = {r["class"]: r for r in m.classification_report(df).collect()}
    assert "accuracy" not in got
    assert got["micro avg"].precision == pytest.approx(2 / 3) and got["micro avg"].recall == pytest.approx(2 / 3)
    assert m.accuracy(df).first().accuracy == 0.5
    assert sum(r.n for r in m.confusion_matrix(df).collect()) == 2


def test_counted_pairs_give_the_same(spark):
    df = spark.createDataFrame(CASES["random"], "label int, prediction int")
    counted = m.pair_counts(df)
    for metric in (m.classification_report, m.confusion_matrix, m.accuracy):
        assert metric(df).collect() == metric(counted, "actual", "predicted", weight="n").collect()


def test_confusion_matrix_order_and_zeros(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (-1, -1)], "label int, prediction int")
    got = [tuple(r) for r in m.confusion_matrix(df).collect()]
    assert [c[:2] for c in got] == [(a, p) for a in (-1, 0, 1) for p in (-1, 0, 1)]
    assert sum(c[2] for c in got) == 3 and (1, 0, 2) in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "label int, prediction int")
    assert {(r.precision, r.support) for r in m.classification_report(df).collect()} == {(0.0, 0)}
    assert m.accuracy(df).first().accuracy == 0


def test_error_examples(spark):
    data = [(i, 1, -1 if i % 2 else 1, "x" * 300 if i == 1 else "short") for i in range(40)]
    df = spark.createDataFrame(data, "eval_id bigint, label int, hf_mapped int, t string")
    got = m.error_examples(df, "label", "hf_mapped", "t").collect()
    assert [r.eval_id for r in got] == list(range(1, 20, 2))
    assert got[0].preview == "x" * 200 + "..." and got[1].preview == "short..."
    assert (got[0].actual_name, got[0].predicted_name) == ("Positif", "Négatif")
