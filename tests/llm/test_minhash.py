"""Near duplicates against the comparison of all pairs, and the bounds of the candidate search."""

import random

import duckdb
import numpy as np
import pytest

from llm_cases import edge_documents, frame, prose, shingles

from opinion_spark.llm import minhash
from opinion_spark.llm.minhash import band_rows, least_matches, minima, near_duplicates, still_possible


def plain(rows, n=4, percent=80):
    """(doc_id, n_shingles, component_id, kept) of each row, every row a document."""
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x, a in enumerate(sets):
        for y, b in enumerate(sets[:x]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    ids = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            ids[find(x)] = min(i, ids.get(find(x), i))
    return sorted(((i, len(sets[x]), ids.get(find(x)), i == ids.get(find(x))) for x, (i, _) in enumerate(rows)), key=repr)


def found(spark, rows, **options):
    df = near_duplicates(frame(spark, rows), **options)
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted((tuple(r) for r in df.collect()), key=repr)


def changed(rng, words, most):
    copy = list(words)
    for _ in range(rng.randint(1, most)):
        copy[rng.randrange(len(copy))] = f"changed{rng.randrange(10**6)}"
    return " ".join(copy)


def test_edge_documents(spark):
    rows = [*edge_documents(), (None, None), (None, "four words only here"), (None, "nobody else has this one text"), (None, "nobody else has this one text")]
    assert found(spark, rows) == plain(rows)


@pytest.mark.parametrize("group_sets", [1024, 3])
def test_groups_of_copies(spark, group_sets):
    """Copies of copies, whose links form chains, and groups of many near copies of one text."""
    rng = random.Random(5)
    rows, number = [], 1000
    for length, copies, most in ((90, 60, 5), (40, 25, 3), (400, 30, 20)):
        words = prose(rng, length).split()
        rows += [((number := number - 1), changed(rng, words, most)) for _ in range(copies)] + [((number := number - 1), " ".join(words))]
    for length in (60, 150):
        words = prose(rng, length).split()
        for _ in range(25):
            rows.append(((number := number - 1), " ".join(words)))
            words[rng.randrange(len(words))] = f"next{rng.randrange(10**6)}"
    rng.shuffle(rows)
    assert found(spark, rows, group_sets=group_sets) == plain(rows)


def test_other_thresholds(spark):
    rng = random.Random(9)
    words = prose(rng, 80).split()
    rows = [(i, changed(rng, words, 12)) for i in range(60)]
    for n, percent in ((2, 60), (5, 95), (3, 100)):
        assert found(spark, rows, n=n, percent=percent) == plain(rows, n, percent)


def test_bridges_without_an_id_and_shared_stock(spark):
    words = [f"w{i}" for i in range(60)]
    rows = [(7, " ".join(words)), (None, " ".join(words[2:] + ["x1", "x2"])), (9, " ".join(words[5:] + ["x1", "x2", "x3", "x4"]))]
    rng = random.Random(1)
    stock = [prose(rng, 20) for _ in range(12)]
    rows += [(100 + i, " ".join(rng.sample(stock, 6))) for i in range(80)]
    assert found(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert found(spark, edge_documents()[:0] or [(1, "x")])[0] == (1, 1, 1, True)
    assert near_duplicates(frame(spark, edge_documents()).limit(0)).collect() == []


def test_bounds():
    assert band_rows(80) == 5 and (1 - 0.8**5) ** (256 // 5) < minhash.MISS
    assert (1 - 0.8**6) ** (256 // 6) > minhash.MISS
    with pytest.raises(ValueError):
        band_rows(2)
    least = least_matches(80)
    rng = np.random.default_rng(0)
    for i, need in enumerate(least.tolist()):
        hits = rng.binomial(32 * (i + 1), 0.8, 100_000)
        assert (hits >= need).all()  # a pair at the threshold stays
        assert need > 0.5 * 32 * (i + 1) or i < 2


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    for shared in (50, 300, 900):
        sets = [rng.integers(0, 2**63, 1000 - shared, dtype=np.int64).astype(np.uint64) for _ in range(2)]
        both = rng.integers(0, 2**63, shared, dtype=np.int64).astype(np.uint64)
        least = minima([np.concatenate([s, both]) for s in sets], 256)
        assert abs((least[0] == least[1]).mean() - shared / (2000 - shared)) < 0.1


def test_batches_drop_what_cannot_reach():
    least = least_matches(80)
    one = np.zeros((1, 256), dtype=np.uint8)
    others = np.stack([np.arange(256) < k for k in (0, 40, 100, 200)]).astype(np.uint8)[:, ::-1]
    assert still_possible(one, others, least).tolist() == [0, 1]
    assert still_possible(others, others, least).tolist() == [0, 1, 2, 3]


def test_query_equals_sql(spark, sf_dir):
    from opinion_spark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    cursor = con.execute(ORACLE["op11_minhash"])
    df = QUERIES["op11_minhash"](spark, sf_dir)
    assert df.columns == [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
