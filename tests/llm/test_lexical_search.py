"""Ranked search against plain whole-number scores, and the exactness of its products."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from llm_cases import PLAIN, edge_documents, frame, lower, prose

from opinion_spark.llm.lexical_search import EXACT, IMPACT_LIMIT, Best, exact_products, item_tiles, ranked_search


def plain(docs, items, top=10):
    """Sorted (item_id, rank, doc_id, score) by the formulas of the contract."""
    bags = [(i, Counter(PLAIN.findall(lower(t)))) for i, t in docs]
    n = sum(1 for _, b in bags if b)
    length = sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in items:
        scores = []
        for doc, bag in bags:
            m = 25 + 75 * bag.total() * n // length if length else 0
            score = 0
            for term in PLAIN.findall(lower(text)):
                if bag[term]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[term] + 1))) * (1_000_000_000 * bag[term] // (1000 * bag[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc is None, doc or 0))
        out += [(item, rank, None if gone else doc, -score) for rank, (score, gone, doc) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def tables(spark, docs, items):
    return frame(spark, docs), spark.createDataFrame([(i, t, 1, 2) for i, t in items], "item_id bigint, text string, rank int, score int")


def cases():
    rng = random.Random(11)
    docs = edge_documents(rng)
    words = [w for _, t in docs[16:] if t and len(t) < 2000 for w in t.split()]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(80)]
    items += [(200, None), (201, ""), (202, "..."), (203, "unknown terms"), (204, "one"), (204, "ONE, one"), (None, words[0]), (205, docs[0][1]), (206, "same words " * 50)]
    return docs, items


@pytest.mark.parametrize("block_words", [1 << 18, 300])
def test_ranks_equal_plain_version(spark, block_words):
    docs, items = cases()
    got = sorted((tuple(r) for r in ranked_search(*tables(spark, docs, items), block_words=block_words).collect()), key=repr)
    assert got == plain(docs, items)


def test_ties_and_repeated_rows(spark):
    docs = [(i, "alpha beta") for i in range(100, 0, -1)] + [(5, "alpha beta"), (None, "alpha beta"), (None, "alpha")] + [(i, prose(random.Random(i), 9)) for i in range(200, 230)]
    items = [(1, "alpha"), (1, "alpha"), (2, "beta beta gamma"), (3, "gamma")]
    for top in (3, 10, 200):
        got = sorted((tuple(r) for r in ranked_search(*tables(spark, docs, items), top=top).collect()), key=repr)
        assert got == plain(docs, items, top)


def test_empty_tables(spark):
    docs, items = cases()
    for d, i in ((docs, []), ([], items), ([(1, None), (2, " ")], items)):
        full = tables(spark, docs, items)
        given = [full[0].limit(0) if not d else frame(spark, d), full[1].limit(0) if not i else full[1]]
        assert ranked_search(*given).collect() == []


def test_products_are_cut_before_they_lose_exactness():
    weights = np.array([20_000, 3, 0, 25_000], dtype=np.int64)
    items = [{0: 10**6, 1: 2, 3: 10**7}, {1: 5, 2: 9}, {}]
    products = exact_products(items, weights)
    assert len(products) > 10
    totals = Counter()
    for p in products:
        sums = Counter()
        for t, i, w in zip(p.term.tolist(), p.item.tolist(), p.weight.tolist(), strict=True):
            sums[i] += w * IMPACT_LIMIT
            totals[i, p.codes[t]] += int(w)
        assert len(set(p.codes.tolist())) == len(p.codes) and max(sums.values()) < EXACT
    assert totals == {(i, c): n * weights[c] for i, own in enumerate(items) for c, n in own.items() if weights[c]}
    assert [len(p.codes) for p in exact_products([{0: 1, 1: 1, 3: 1}], weights, max_terms=2)] == [2, 1]


def test_tiles_cover_all_items():
    rng = random.Random(2)
    items = [{rng.randrange(5000): 1 for _ in range(rng.choice([3, 700, 4500]))} for _ in range(300)]
    tiles = item_tiles(items, np.ones(5000, dtype=np.int64))
    assert [t.first for t in tiles] == np.cumsum([0] + [t.size for t in tiles[:-1]]).tolist() and sum(t.size for t in tiles) == 300


def test_best_of_many_tiles():
    rng = np.random.default_rng(4)
    best = Best(3, 5)
    scores = rng.integers(0, 6, (3, 400))
    ids, missing = rng.permutation(400), rng.integers(0, 2, 400)
    for a in range(0, 400, 37):
        best.add(0, scores[:, a:a + 37], missing[a:a + 37], ids[a:a + 37])
    for i in range(3):
        assert best.found[i].T.tolist() == [list(x) for x in sorted(zip(scores[i].tolist(), missing.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1], r[2]))[:5]]


def test_query_equals_sql(spark, sf_dir):
    from opinion_spark.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    cursor = con.execute(ORACLE["op12_search"])
    df = QUERIES["op12_search"](spark, sf_dir)
    assert df.columns == [d[0] for d in cursor.description]
    assert sorted(map(tuple, df.collect())) == sorted(cursor.fetchall())
