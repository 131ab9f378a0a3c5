import math
import zlib
from collections import Counter, defaultdict

import pytest
from llm_cases import edge_documents, frame, spaced

from opinion_spark.llm import language_model as lm


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 7 == 2


def plain_scores(rows):
    """The suffix tree by dictionaries, over token tuples."""
    texts = [(i, [*spaced(t), None]) for i, t in rows]
    train = [t for i, t in texts if not fold(i)]
    counts = Counter(w for t in train for w in t)
    n, v = sum(counts.values()), len(counts)
    root = defaultdict(float)
    joint, context = Counter(), Counter()
    for t in train:
        for k, w in enumerate(t):
            for c in contexts(t, k):
                joint[c, w] += 1
                context[c] += 1

    def p0(w):
        return (counts[w] + 1) / (n + v + 1)

    def smoothed(c, w, parent, less=0):
        weight = lm.SMOOTHING[len(c)]
        return (joint[c, w] - less + weight * parent) / (context[c] - less + weight)

    stays = {}

    def p(t, k):
        value = p0(t[k])
        for c in contexts(t, k):
            if stays.get(c):
                value = smoothed(c, t[k], value)
        return value

    for size in (1, 2):
        gain = defaultdict(float)
        for t in train:
            for k, w in enumerate(t):
                for c in contexts(t, k):
                    if len(c) == size and context[c] >= lm.MIN_COUNT:
                        parent = p0(w) if size == 1 else p(t, k)
                        gain[c] += math.log(smoothed(c, w, parent, 1) / parent)
        stays |= {c: g > lm.MIN_GAIN for c, g in gain.items()}
    del root
    return {
        "n": n,
        "scores": [(i, fold(i), len(t), sum(counts[w] > 0 for w in t), sum(math.log10(p0(w)) for w in t), sum(math.log10(p(t, k)) for k in range(len(t)))) for i, t in texts],
        "contexts": Counter(len(c) for c, s in stays.items() if s),
    }


def contexts(t, k):
    """The word before, then the two words before; the begin of a text counts as one."""
    padded = ["<begin>", *t]
    yield (padded[k],)
    if k >= 1:
        yield (padded[k - 1], padded[k])


def key(r):
    return repr((r[0], r[1], r[2], r[3], round(r[4], 4)))


@pytest.mark.parametrize("block_chars", [500, 1 << 23])
def test_scores_equal_plain_tree(spark, block_chars):
    rows = [(i, t) for i, t in edge_documents() if t is None or len(t) < 20_000]
    rows += [(i, "one two three four five six seven eight nine ten") for i in range(100, 115)]
    want = plain_scores(rows)
    got = lm.score_documents(frame(spark, rows), block_chars=block_chars).collect()
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {want["n"]}
    assert want["contexts"][1] and want["contexts"][2]
    mine = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=key)
    for a, b in zip(mine, sorted(want["scores"], key=key), strict=True):
        assert a[:4] == b[:4]
        assert math.isclose(a[4], b[4], rel_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-5, abs_tol=1e-6)


def test_distribution_sums_to_one():
    """Smoothing by the parent keeps the mass: next-word probabilities and that of an unknown word add up."""
    joint, weight, parent = {"a": 3, "b": 1}, 0.7, {"a": 0.2, "b": 0.3, "c": 0.5}
    assert math.isclose(sum((joint.get(w, 0) + weight * q) / (4 + weight) for w, q in parent.items()), 1.0)


def test_held_out_copies_gain(spark, sf_dir):
    got = lm.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    held = [r for r in got if r.held_out]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score < 0 and r.base_score < 0 for r in got)


def test_empty_and_untrained_tables(spark):
    assert lm.score_documents(frame(spark, [])).collect() == []
    only_held = [i for i in range(100) if fold(i)][:3]
    got = lm.score_documents(frame(spark, [(i, "a b") for i in only_held])).collect()
    assert {(r.n_known, r.train_tokens, r.base_score, r.score) for r in got} == {(0, 0, 0.0, 0.0)}
