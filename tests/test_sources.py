import os
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import types as T

from opinion_spark.operators.statistics import cleaned_dataset, complete_cases
from opinion_spark.session import drop_staged, scratch_path, shared_dir, stage, staged_paths
from opinion_spark.sources.reviews import read_reviews, write_reviews
from opinion_spark.sources.roles import resolve_roles
from opinion_spark.sources.snapshot import freeze, frozen_settings, thaw


@pytest.mark.parametrize("columns, text, title, country", [
    (["Review Text", "Review Title", "Country", "numeric_rating"], "Review Text", "Review Title", "Country"),
    (["text_of_review", "summary"], "text_of_review", "summary", None),
    (["review_text_title", "review_text"], "review_text_title", "review_text_title", None),
    (["body", "rating"], None, None, None),
])
def test_roles(columns, text, title, country):
    roles = resolve_roles(columns)
    assert (roles.text, roles.title, roles.country) == (text, title, country)
    assert roles.has_rating == ("numeric_rating" in columns)


def test_missing_text_role_is_refused():
    with pytest.raises(ValueError):
        resolve_roles(["body", "rating"]).require_text()


CSV = (
    'review_text,summary,numeric_rating,country,stock\n'
    '"said ""hi"", then\nleft",NA,5,fr,1\n'
    ' padded ,NaN,2.5,,2\n'
    'NULL,"a,b",,de,3\n'
)


def write(folder, name, content):
    path = folder / name
    path.write_text(content, encoding="utf-8")
    return str(path)


def test_csv_quoting_and_null_tokens(spark, tmp_path):
    df = read_reviews(spark, write(tmp_path, "a.csv", CSV))
    assert dict(df.dtypes)["numeric_rating"] == "double"
    assert [tuple(r) for r in df.collect()] == [
        ('said "hi", then\nleft', None, 5.0, "fr", "1"), (" padded ", None, 2.5, None, "2"), (None, "a,b", None, "de", "3"),
    ]


def test_csv_inferred_types(spark, tmp_path):
    content = "i,gap,f,b,s,none\n1,1,1.5,True,x,NA\n2,,2e3,false,2,\n"
    df = read_reviews(spark, write(tmp_path, "b.csv", content), infer=True)
    assert dict(df.dtypes) == {"i": "bigint", "gap": "double", "f": "double", "b": "boolean", "s": "string", "none": "double"}
    assert tuple(df.orderBy("i").first()) == (1, 1.0, 1.5, True, "x", None)


def test_csv_with_schema(spark, tmp_path):
    schema = T.StructType.fromDDL("review_text string, summary string, numeric_rating double, country string, stock bigint")
    df = read_reviews(spark, write(tmp_path, "c.csv", CSV), schema=schema)
    assert df.schema.simpleString() == schema.simpleString()
    assert [r.stock for r in df.collect()] == [1, 2, 3]


def test_csv_round_trip(spark, tmp_path):
    data = [("a\nb", 'q"uo"te', 1.0, -1, "fr"), ("x, y", None, None, 1, None), (" lead", "back\\slash", 3.0, 0, "é")]
    df = spark.createDataFrame(data, "review_text string, review_title string, numeric_rating double, label int, country string")
    path = str(tmp_path / "out")
    write_reviews(cleaned_dataset(df, resolve_roles(df.columns)), path)
    back = read_reviews(spark, path)
    assert back.columns == df.columns
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_other_formats_and_failures(spark, tmp_path):
    df = spark.createDataFrame([("t", 4.0)], "review_text string, numeric_rating double")
    for fmt in ("parquet", "json", "orc"):
        path = str(tmp_path / fmt)
        write_reviews(df, path, fmt)
        assert tuple(read_reviews(spark, path, fmt).select(*df.columns).first()) == ("t", 4.0)
    df.createOrReplaceTempView("review_view")
    assert read_reviews(spark, "review_view", "table").count() == 1
    with pytest.raises(AnalysisException):
        read_reviews(spark, str(tmp_path / "nowhere"))


def test_cleaned_columns_once_and_in_order(spark):
    df = spark.createDataFrame([("fr", "t", 1, 2.0)], "country string, review_text_title string, label int, numeric_rating double")
    assert cleaned_dataset(df, resolve_roles(df.columns)).columns == ["review_text_title", "numeric_rating", "label", "country"]
    with pytest.raises(AnalysisException):
        cleaned_dataset(df.drop("label"), resolve_roles(df.columns)).collect()


def test_complete_cases(spark):
    df = spark.createDataFrame([(1, "a", 1), (2, None, 1), (3, "b", None), (4, None, None)], "id int, t string, label int")
    assert [r.id for r in complete_cases(df, "t", keep=["id"]).collect()] == [1]
    numbers = spark.createDataFrame([(7, 1)], "t int, label int")
    assert complete_cases(numbers, "t").first().t == "7"


def test_snapshot_warns_about_other_model(spark, tmp_path):
    path = str(tmp_path / "snap")
    freeze(spark.createDataFrame([(0, "m1")], "eval_id int, model string"), path)
    assert thaw(spark, path, "m1").count() == 1
    with pytest.warns(UserWarning):
        thaw(spark, path, "m2")


def test_stage_and_shared_folder(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
    assert scratch_path(spark, "x") != scratch_path(spark, "x")
    df = spark.range(10).selectExpr("id", "id % 2 = 0 AS even")
    assert sorted(stage(df, "numbers").collect()) == sorted(df.collect())


def test_staged_tables_can_be_dropped(spark):
    kept, gone = stage(spark.range(3), "kept"), None
    mark = len(staged_paths(spark))
    gone = stage(spark.range(5), "gone")
    assert gone.count() == 5
    path = staged_paths(spark)[-1]
    assert drop_staged(spark, since=mark) == 1
    assert not os.path.exists(path.removeprefix("file:")) and kept.count() == 3


def test_a_fraction_is_no_whole_number(spark, tmp_path):
    path = write(tmp_path, "f.csv", "text,label\na,1.0\nb,1.5\n")
    df = read_reviews(spark, path)
    with pytest.raises(Exception, match="fraction"):
        df.select("label").collect()


def test_frozen_rows_know_their_size_and_text(spark, tmp_path):
    path = str(tmp_path / "frozen")
    freeze(spark.createDataFrame([(0, "t", "m")], "eval_id bigint, body string, model string"), path, 120, "body")
    assert frozen_settings(thaw(spark, path)) == (120, "body")


def test_cached_read(spark, tmp_path):
    path = write(tmp_path, "d.csv", CSV)
    df = read_reviews(spark, path, cache=True)
    assert df.storageLevel.useMemory and df.storageLevel.useDisk and df.count() == 3
    df.unpersist()
    assert not read_reviews(spark, path).storageLevel.useMemory
