"""What the operators send and keep on disk besides their results."""

import random

import numpy as np
import pytest
from llm_cases import edge_documents, frame, prose
from pyspark.sql import functions as F

from opinion_spark.llm import bit_tables, jaccard
from opinion_spark.llm.bit_tables import bit_table, filter_rows
from opinion_spark.llm.decontamination import drop_contaminated
from opinion_spark.llm.jaccard import keep_one_row, packed_texts
from opinion_spark.session import drop_staged, staged_paths


def left(spark, before):
    """Names of the tables that have been staged since."""
    return [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in staged_paths(spark)[before:]]


@pytest.mark.parametrize("bits", [15, 25])
def test_rows_that_a_table_rules_out(spark, monkeypatch, bits):
    monkeypatch.setattr(bit_tables, "TABLE_BITS", bits)
    keys = [*range(0, 30_000, 50), None]
    table = bit_table(spark.createDataFrame([(k,) for k in keys * 2], "k bigint"))
    df = spark.range(30_000).select(F.col("id").alias("_place"), F.lit("x").alias("text")).unionByName(spark.sql("select cast(null as bigint) as _place, 'y' as text"))
    held = [r._place for r in filter_rows(df, table, "_place").collect()]
    rest = [r._place for r in filter_rows(df, table, "_place", held=False).collect()]
    assert set(keys) <= set(held) and len(held) < (30_000 * 0.1 if bits == 15 else 630)
    assert sorted([*held, *rest], key=repr) == sorted([*range(30_000), None], key=repr)
    empty = bit_table(spark.createDataFrame([], "k bigint"))
    assert filter_rows(df, empty, "_place").count() == 0 and filter_rows(df, empty, "_place", held=False).count() == 30_001


def test_only_texts_that_are_listed_are_packed(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(2000)] + [(7, None)], "doc_id bigint, text string")
    sent = packed_texts(docs, spark.createDataFrame([(7,), (9,), (9,)], "doc_id bigint"))
    ids = [r.doc_id for r in sent.collect()]
    assert {7, 9} <= set(ids) and ids.count(7) == 2 and len(ids) < 10


def test_sets_that_one_row_has_are_joined_with_no_list(spark):
    sets = spark.createDataFrame([(i, 3, bytes([i % 90]), [i]) for i in range(100)] + [(100, 0, b"", None)], "doc_id bigint, n_shingles bigint, digest binary, prefix array<bigint>")
    classes = sets.filter("n_shingles > 0").groupBy("digest", "n_shingles").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows"))
    assert sorted(r.doc_id for r in jaccard.first_rows(sets, classes).collect()) == list(range(90))
    asked = filter_rows(sets, bit_table(classes.filter("rows > 1").select("digest")), "digest")
    assert {i for i in range(100) if i % 90 < 10} <= {r.doc_id for r in asked.collect()} and asked.count() < 30


@pytest.mark.parametrize("most", [0, 1, 255, 256, 1 << 16, 1 << 32, 1 << 40])
def test_counts_are_packed_whole(most):
    counts = np.arange(64, dtype=np.int64)[::-1] * 0
    counts[5] = most
    assert (jaccard._unpacked_counts(jaccard._packed_counts(counts), 64) == counts).all()


def test_stages_leave_only_what_their_result_reads(spark):
    docs = frame(spark, edge_documents())
    before = len(staged_paths(spark))
    kept = keep_one_row(docs)
    assert left(spark, before) == ["numbered-rows", "copies"]
    count = kept.count()
    drop_staged(spark, before)
    assert 0 < count < docs.count()


def test_decontamination_copies_no_rows(spark):
    rng = random.Random(5)
    passage, clean = prose(rng, 12), prose(rng, 40)
    docs = frame(spark, [(1, f"{clean} {passage}"), (None, f"{clean} {passage}"), (None, clean), (2, clean), (3, None), (3, "")]).withColumn("_text_digest", F.lit("own"))
    before = len(staged_paths(spark))
    result = drop_contaminated(docs, spark.createDataFrame([(1, passage)], "item_id bigint, text string"))
    assert left(spark, before) == ["contaminated"]
    assert result.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in result.collect()), key=repr) == sorted([(None, clean), (2, clean), (3, None), (3, "")], key=repr)
    drop_staged(spark, before)
