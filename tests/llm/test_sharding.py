import zlib
from collections import Counter

import pytest
from llm_cases import edge_documents, frame

from opinion_spark.llm.sharding import shard_documents, stratified_order
from opinion_spark.llm.queries import op10_sharding


@pytest.mark.parametrize("shards", [1, 4, 16])
def test_rows_law_and_mixture(spark, shards):
    rows = edge_documents() + [(i, f"t{i}") for i in range(100, 400)]
    docs = frame(spark, rows)
    got = shard_documents(docs, shards=shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(shards)) and max(counts.values()) - min(counts.values()) <= 1
    for k in counts:
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    for source, n in Counter(r.source for r in got).items():
        for k in counts:
            assert abs(sum(r.source == source and r.shard == k for r in got) - n / shards) <= 2


def test_same_result_at_any_partitioning_and_slicing(spark):
    rows = spark.createDataFrame([(i, f"s{i % 7 if i % 3 else 0}") for i in range(500)], "doc_id bigint, source string")
    one = {(r.doc_id, r.place) for r in stratified_order(rows.coalesce(1), "source", ["doc_id"], 500, slice_rows=500).collect()}
    many = {(r.doc_id, r.place) for r in stratified_order(rows.repartition(7), "source", ["doc_id"], 500, slice_rows=20).collect()}
    assert {p for _, p in one} == set(range(500)) == {p for _, p in many}
    assert one == many


def test_fewer_rows_than_shards_and_none(spark):
    got = shard_documents(frame(spark, [(1, "a"), (2, "b"), (3, "c")]), shards=16).collect()
    assert len({r.shard for r in got}) == 3 and all(r.slot == 0 for r in got)
    assert shard_documents(frame(spark, []), shards=16).collect() == []


def test_query_runs_no_python(spark, sf_dir):
    plan = op10_sharding(spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "MapInArrow" not in plan
