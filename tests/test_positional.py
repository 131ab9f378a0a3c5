import pytest

from opinion_spark.operators.numbering import file_positions, positioned
from opinion_spark.operators.positional import concat_columns, join_positions


def letters(spark, n, parts, column="a"):
    """``n`` rows in order, over tasks of uneven sizes, some empty."""
    return spark.range(0, n, 1, parts).selectExpr(f"concat('v', id) AS `{column}`")


def test_positions_are_those_of_the_rows(spark):
    df = letters(spark, 101, 7).filter("a NOT LIKE 'v2%'")
    want = [f"v{i}" for i in range(101) if not str(i).startswith("2")]
    assert [(r.n, r.a) for r in positioned(df, "n").orderBy("n").collect()] == list(enumerate(want))


def test_helper_names_do_not_clash(spark):
    df = spark.range(0, 5, 1, 2).selectExpr("id AS _n", "id AS _part", "id AS _rows", "id AS _BEGIN")
    assert sorted(tuple(r) for r in positioned(df, "n").collect()) == [(i,) * 5 for i in range(5)]


def test_files_keep_their_order(spark, tmp_path):
    """Files of uneven sizes: Spark reads them in another order than that of their names."""
    path = str(tmp_path / "t")
    spark.range(0, 300, 1, 1).selectExpr("id", "CASE WHEN id < 4 THEN 0 WHEN id < 250 THEN 1 ELSE 2 END AS part").repartitionByRange(3, "part").sortWithinPartitions("id").write.parquet(path)
    rows = file_positions(spark, path, "at").collect()
    assert len(rows) == 300 and all(r.at == r.id for r in rows)


@pytest.mark.parametrize("n, parts, others", [(0, 1, 3), (1, 4, 1), (57, 3, 8)])
def test_tables_side_by_side(spark, n, parts, others):
    both = concat_columns(letters(spark, n, parts), letters(spark, n, others, "b.c"))
    assert both.columns == ["eval_id", "a", "b.c"]
    assert [tuple(r) for r in both.orderBy("eval_id").collect()] == [(i, f"v{i}", f"v{i}") for i in range(n)]


@pytest.mark.parametrize("n, m", [(10, 9), (9, 10), (0, 1), (1, 0)])
def test_tables_of_unequal_length_fail(spark, n, m):
    both = concat_columns(letters(spark, n, 2), letters(spark, m, 3, "b"))
    for read in (lambda: both.collect(), lambda: both.count(), lambda: both.select("a").collect(), lambda: both.filter("b IS NOT NULL").collect()):
        with pytest.raises(Exception, match="has no partner"):
            read()


def test_clashing_columns_are_refused(spark):
    with pytest.raises(ValueError, match="clash"):
        concat_columns(letters(spark, 3, 1), letters(spark, 3, 1, "A"))
    with pytest.raises(ValueError, match="clash"):
        join_positions(letters(spark, 3, 1, "eval_id").selectExpr("eval_id", "eval_id AS at"), letters(spark, 3, 1, "b").selectExpr("b", "b AS at"), "at", "at")


def test_nulls_and_copies_are_rows_like_others(spark):
    left = spark.createDataFrame([(None,), ("x",), ("x",)], "a string").coalesce(1)
    right = spark.createDataFrame([(1.0,), (None,), (None,)], "b double").coalesce(1)
    assert [tuple(r) for r in concat_columns(left, right).orderBy("eval_id").collect()] == [(0, None, 1.0), (1, "x", None), (2, "x", None)]
