import random

import numpy as np
import pyarrow as pa
import pytest
from llm_cases import components, edge_documents, frame, prose, shingles

from opinion_spark.llm import jaccard
from opinion_spark.llm.components import connected_components
from opinion_spark.llm.jaccard import SetJoin, jaccard_components, keep_one, may_link, prefix_length, set_bits
from opinion_spark.llm.wordhash import hash_words, shingle_sets


def check(got, rows):
    want = components(rows)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == sorted(
        ((i, len(shingles(t)), want.get(i)) for i, t in rows), key=repr
    )


def test_edge_documents(spark):
    rows = edge_documents()
    check(jaccard_components(frame(spark, rows)).collect(), rows)


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []


@pytest.mark.parametrize("group_sets", [4, 64])
def test_large_group_of_near_copies_is_whole(spark, group_sets):
    """A hot leader in chunks: copies at all distances around the threshold, chained and apart."""
    rng = random.Random(3)
    base = prose(rng, 90).split()
    rows = []
    for i in range(60):
        copy = list(base)
        for k in rng.sample(range(len(copy)), rng.randint(0, 6)):
            copy[k] = f"w{rng.randrange(40)}"
        rows.append((1000 - i, " ".join(copy[:rng.randint(70, 90)])))
    passage = prose(rng, 15)  # shared by texts that are otherwise apart
    rows += [(i, f"{passage} {prose(rng, 12)}") for i in range(40)]
    check(jaccard_components(frame(spark, rows), group_sets=group_sets).collect(), rows)


@pytest.mark.parametrize("seed", range(30))
def test_set_join_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 60, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        kind = rng.integers(3)
        own = base[rng.random(60) < (0.95, 0.8, 0.4)[kind]]
        new = rng.integers(0, 200, rng.integers(0, 12)).astype(np.uint64)
        s = np.unique(np.concatenate([own, new]))
        if len(s):
            sets.append(s)
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= 80 * (len(a) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    labels = SetJoin(sets, 80).run()
    for i in range(len(sets)):
        for j in range(i):
            assert (labels[i] == labels[j]) == (find(i) == find(j))


def near_and_far(rng, count):
    """Sets at all similarities, of sizes around two powers of two."""
    base = rng.integers(0, 1 << 63, 140).astype(np.uint64) * np.uint64(2)
    sets = []
    for _ in range(count):
        own = base[rng.random(140) < rng.choice([0.3, 0.8, 0.97])]
        new = rng.integers(0, 1 << 63, rng.integers(1, 60)).astype(np.uint64) * np.uint64(2)
        sets.append(np.unique(np.concatenate([own, new])))
    return sets


def linked(sets, percent=80):
    """Which sets link with another one, from all pairs."""
    found = np.zeros(len(sets), dtype=bool)
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(np.intersect1d(a, sets[j]))
            if 100 * common >= percent * (len(a) + len(sets[j]) - common):
                found[[i, j]] = True
    return found


@pytest.mark.parametrize("seed", range(20))
def test_bitmaps_rule_out_no_link(seed):
    rng = np.random.default_rng(seed)
    sets = near_and_far(rng, 60)
    told = may_link(np.array([len(s) for s in sets]), [set_bits(s) for s in sets], 80)
    assert not (linked(sets) & ~told).any()


def test_bitmaps_rule_out_sets_that_share_half():
    rng = np.random.default_rng(1)
    shared = rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)
    sets = [np.unique(np.concatenate([shared, rng.integers(0, 1 << 63, 200).astype(np.uint64) * np.uint64(2)])) for _ in range(30)]
    assert not may_link(np.array([len(s) for s in sets]), [set_bits(s) for s in sets], 80).any()


@pytest.mark.parametrize("group_bits", [1 << 24, 200])
@pytest.mark.parametrize("batch_rows", [1, 7, 1000])
def test_groups_across_batches_and_groups_too_large(monkeypatch, group_bits, batch_rows):
    monkeypatch.setattr(jaccard, "GROUP_BITS", group_bits)
    rng = np.random.default_rng(2)
    sets, rows, want = [], [], set()
    for leader, count in enumerate([1, 2, 9, 3, 30]):
        mine = near_and_far(rng, count)
        for i, hit in enumerate(linked(mine)):
            if hit:
                want.add((leader, len(sets) + i))
        rows += [(leader, len(sets) + i, len(s), set_bits(s)) for i, s in enumerate(mine)]
        sets += mine
    columns = [pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
    table = pa.RecordBatch.from_arrays(columns, names=["leader", "member", "n_shingles", "bits"])
    batches = [table.slice(i, batch_rows) for i in range(0, len(rows), batch_rows)]
    got = [p for b in jaccard._linkable(80)(iter(batches)) for p in zip(*(c.to_pylist() for c in b.columns))]
    assert len(got) == len(set(got)) and want <= set(got) <= {(r[0], r[1]) for r in rows}
    if group_bits == 200:  # a group past the bound goes on whole
        assert {m for of, m in got if of == 4} == {r[1] for r in rows if r[0] == 4}
    else:
        assert len(got) < len(rows)


def test_shingles_equal_plain_rule():
    texts = [t for _, t in edge_documents()]
    assert [len(s) for s in shingle_sets(hash_words(texts))] == [len(shingles(t)) for t in texts]
    assert prefix_length(10, 80) == 3 and prefix_length(1, 80) == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, i) for i in range(101, 130)] + [(200, 200), (7, 300)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {i: 1 for i in range(2, 41)} | {i: 100 for i in range(101, 130)} | {300: 1}
    assert got == want


def test_keep_one_keeps_columns_and_rows_without_id(spark):
    rows = edge_documents()
    docs = frame(spark, rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    want = components(rows)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([i for i in want if want[i] == i] + [None], key=repr)
