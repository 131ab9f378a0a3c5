"""Stages of the pipeline, and the queries of the subpackage against their SQL."""

import duckdb
import pytest
from llm_cases import components, edge_documents, frame
from test_decontamination import cases, plain

import __spark_entry__ as entry_point
import corpus_pipeline
from opinion_spark.llm import pii, quality
from opinion_spark.llm.queries import ORACLE, QUERIES

TABLES = ("documents", "pages", "benchmark", "labels")


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    cursor = con.execute(ORACLE[name])
    columns = [d[0] for d in cursor.description]
    df = QUERIES[name](spark, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(map(repr, cursor.fetchall()))


def test_registered():
    names = set(entry_point.queries())
    assert {"pipeline", *QUERIES} <= names and {n.split("_")[0] for n in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(ORACLE) <= set(QUERIES)


def test_stages_equal_plain_rules(spark, tmp_path):
    rows, items = cases()
    rows = [r for r in rows if r[0] is not None] + [(300, f"mail me at a.b@example.org {' '.join(f'w{k}' for k in range(80))}"), (None, " ".join(f"word{k}" for k in range(60)))]
    docs = frame(spark, rows)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == docs.columns
        seen.append([(r.doc_id, r.text) for r in kept.collect()])
    passed = quality.run_cascade(quality.Measured([t for _, t in rows]), quality.default_rules())
    want = [r for r, ok in zip(rows, passed, strict=True) if ok]
    assert sorted(seen[0], key=repr) == sorted(want, key=repr)
    least = components(want)
    firsts = {i for i in least if least[i] == i}
    assert sorted((i for i, _ in seen[1]), key=repr) == sorted([*firsts, None], key=repr)
    bad = {i for i, *_, c in plain(seen[1], items) if c}
    assert sorted(seen[2], key=repr) == sorted((r for r in seen[1] if r[0] not in bad), key=repr)
    assert {i for i, _ in seen[3]} == {i for i, _ in seen[2]} and not any(pii.base_spans(t) for _, t in seen[3])
    assert any("<email>" in t for _, t in seen[3])
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {i for i, _ in seen[3]}


def test_rows_are_told_apart_whatever_their_ids(spark, tmp_path):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(80)) for x in "abcd")
    rows = [(None, a), (None, a), (None, f"{a} more"), (None, b), (5, c), (5, d), (6, b), (None, f"{c} end"), (7, None), (None, "")]
    docs = frame(spark, rows)
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, str(tmp_path))
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 6
    assert {(5, c), (5, d), (6, b), (7, None), (None, "")} < set(got) and [t[:2] for i, t in got if i is None and t] == ["a0"]
    spark.createDataFrame([(1, " ".join(f"a{k}" for k in range(20))), (2, d)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left = corpus_pipeline.decontamination_stage(spark, docs, str(tmp_path))
    assert left.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted((r for r in rows if r[1] != d and not (r[1] or "").startswith("a0")), key=repr)


def test_empty_documents(spark, tmp_path):
    frame(spark, edge_documents()).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "a b")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
