import os

import pytest
from pyspark.sql import types as T

from opinion_spark.sources import ingest
from opinion_spark.sources.ingest import fingerprint, ingest_reviews
from opinion_spark.sources.reviews import read_reviews

CSV = 'review_text,numeric_rating\n"a, ""b""\nc",5\nNA,2.5\n'


@pytest.fixture
def parses(monkeypatch):
    """Paths that were parsed."""
    seen = []

    def read(spark, path, **options):
        seen.append(path)
        return read_reviews(spark, path, **options)

    monkeypatch.setattr(ingest, "read_reviews", read)
    return seen


def test_second_read_parses_nothing(spark, tmp_path, parses):
    path, store = str(tmp_path / "a.csv"), str(tmp_path / "store")
    (tmp_path / "a.csv").write_text(CSV)
    got = [ingest_reviews(spark, path, store) for _ in range(2)]
    assert parses == [path]
    want = read_reviews(spark, path)
    for df in got:
        assert df.dtypes == want.dtypes and sorted(map(tuple, df.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_changed_file_is_read_anew(spark, tmp_path, parses):
    path, store = str(tmp_path / "a.csv"), str(tmp_path / "store")
    (tmp_path / "a.csv").write_text(CSV)
    old = ingest_reviews(spark, path, store)
    (tmp_path / "a.csv").write_text(CSV + "new,1\n")
    assert ingest_reviews(spark, path, store).count() == 3 and old.count() == 2
    os.utime(path, (1, 1))  # same size, another time
    assert ingest_reviews(spark, path, store).count() == 3 and len(parses) == 3


def test_options_have_copies_of_their_own(spark, tmp_path, parses):
    path, store = str(tmp_path / "a.csv"), str(tmp_path / "store")
    (tmp_path / "a.csv").write_text(CSV)
    schema = T.StructType.fromDDL("review_text string, numeric_rating string")
    for _ in range(2):
        assert dict(ingest_reviews(spark, path, store, schema=schema).dtypes)["numeric_rating"] == "string"
        assert dict(ingest_reviews(spark, path, store).dtypes)["numeric_rating"] == "double"
    assert len(parses) == 2


def test_folders_and_missing_paths(spark, tmp_path):
    spark.range(5).selectExpr("id AS label", "'x' AS text").write.option("header", True).csv(str(tmp_path / "d"))
    before = fingerprint(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "_note").write_text("holds no rows")
    assert fingerprint(spark, str(tmp_path / "d")) == before == fingerprint(spark, str(tmp_path / "*d"))
    assert ingest_reviews(spark, str(tmp_path / "d"), str(tmp_path / "store")).count() == 5
    with pytest.raises(FileNotFoundError):
        ingest_reviews(spark, str(tmp_path / "gone"), str(tmp_path / "store"))


def test_file_changed_during_the_read_makes_no_version(spark, tmp_path, monkeypatch):
    path, store = str(tmp_path / "a.csv"), str(tmp_path / "store")
    (tmp_path / "a.csv").write_text(CSV)
    told = iter(["before", "after"])
    monkeypatch.setattr(ingest, "fingerprint", lambda spark, path: next(told))
    with pytest.raises(RuntimeError):
        ingest_reviews(spark, path, store)
    monkeypatch.undo()
    assert ingest_reviews(spark, path, store).count() == 2
