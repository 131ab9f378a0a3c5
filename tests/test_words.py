import math
import re
from collections import Counter, defaultdict

import pytest
from conftest import rows

from opinion_spark.functions.stop_words import CLOUD
from opinion_spark.operators import words as w

TEXTS = [
    "The Dog's dogs chase a Dog in New York. New York dogs are hot dogs", "new york NEW York New Yorks glass glasses 42 ²",
    "I don't like hot dog stands; hot dogs' stands. Été été ÉTÉ", "bus buses pass passes cats cat CAT Cats", None, "",
    "hot dog hot dog hot dog hot dog hot dog rain rain sun", "as was is s x xs xss",
]


def reference_words(text):
    found = [x[:-2] if x.lower().endswith("'s") else x for x in re.findall(r"\w[\w']*", text)]
    return [x for x in found if not x.isdigit()]


def fold(items):
    spellings = defaultdict(Counter)
    for x in items:
        spellings[x.lower()][x] += 1
    target = {}
    for word in sorted(spellings):
        single = word[:-1]
        target[word] = single if word.endswith("s") and not word.endswith("ss") and single in spellings else word
    merged = defaultdict(Counter)
    for word, forms in spellings.items():
        for form, n in forms.items():
            merged[target[word]][form if target[word] == word else form[:-1]] += n
    name = {word: min(forms, key=lambda f: (-forms[f], f)) for word, forms in merged.items()}
    return {name[k]: sum(v.values()) for k, v in merged.items()}, {x: name[target[x]] for x in spellings}


def brute(texts, stops, threshold=30.0):
    singles, pairs = [], []
    for text in texts:
        found = reference_words(text)
        singles += [x for x in found if x.lower() not in stops]
        pairs += [f"{a} {b}" for a, b in zip(found, found[1:]) if a.lower() not in stops and b.lower() not in stops]
    counts, standard = fold(singles)
    pair_counts, _ = fold(pairs)
    total, out, found = len(singles), Counter(counts), {}
    for pair, c12 in pair_counts.items():
        a, b = (standard[x.lower()] for x in pair.split(" "))
        c1, c2 = counts[a], counts[b]
        if total <= c1 or total <= c2:
            continue
        def like(k, n, x):
            return math.log(max(x, 1e-10)) * k + math.log(max(1 - x, 1e-10)) * (n - k)
        p, p1, p2 = c2 / total, c12 / c1, (c2 - c12) / (total - c1)
        score = -2 * (like(c12, c1, p) + like(c2 - c12, total - c1, p) - like(c12, c1, p1) - like(c2 - c12, total - c1, p2))
        if score > threshold:
            found[pair] = score
            out[a] -= c12
            out[b] -= c12
            out[pair] = c12
    return {k: v for k, v in out.items() if v > 0}, found


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(x,) for x in TEXTS], "t string")


@pytest.mark.parametrize("threshold", [30.0, 8.0, 0.5])
def test_frequencies_equal_brute_force(docs, threshold):
    expected, found = brute([x for x in TEXTS if x], set(CLOUD), threshold)
    got = w.word_frequencies(docs, "t", top=1000, threshold=threshold).collect()
    assert {r.term: r.n for r in got} == expected
    largest = max(expected.values())
    assert all(r.relative == pytest.approx(r.n / largest) for r in got)
    pairs = {r.pair: r.score for r in w.collocations(docs, "t", threshold=threshold).collect()}
    assert pairs.keys() == found.keys() and all(pairs[k] == pytest.approx(found[k]) for k in found)


def test_top_is_ordered_with_ties_by_term(docs):
    expected, _ = brute([x for x in TEXTS if x], set(CLOUD))
    got = [(r.term, r.n) for r in w.word_frequencies(docs, "t", top=7).collect()]
    assert got == sorted(expected.items(), key=lambda kv: (-kv[1], kv[0]))[:7]


def test_without_pairs_and_stop_words(docs):
    got = {r.term: r.n for r in w.word_frequencies(docs, "t", stop_words=(), top=1000, pairs=False).collect()}
    assert got == fold([x for text in TEXTS if text for x in reference_words(text)])[0]


def test_one_word_only(spark):
    df = spark.createDataFrame([("rain rain rain",)], "t string")
    assert rows(w.word_frequencies(df, "t")) == [("rain", 3, 1.0)]
    assert w.word_frequencies(df.filter("false"), "t").collect() == []
