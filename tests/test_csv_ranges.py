"""Parallel CSV reading against Spark's one-task reader, with ranges of a few bytes."""

import random

import pytest

from opinion_spark.sources.csv_ranges import _after, csv_records
from opinion_spark.sources.reviews import read_reviews, write_reviews


@pytest.fixture()
def small_ranges(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n in names:
            spark.conf.set(n, str(size))

    yield use
    for n, value in before.items():
        spark.conf.set(n, value)


def both(spark, path, **options):
    key = lambda r: repr(tuple(r))
    slow = sorted(read_reviews(spark, path, parallel=False, **options).collect(), key=key)
    df = read_reviews(spark, path, **options)
    assert sorted(df.collect(), key=key) == slow
    return df, slow


def cell(rng):
    kind = rng.random()
    if kind < 0.2:
        return rng.choice(["", "NA", "x", " pad ", "5.0", "it's"])
    if kind < 0.35:
        return 'five 5" disks' if rng.random() < 0.5 else 'a "b" c'
    content = "".join(rng.choice(['a', 'é', ',', '""', '\n', '\n\n', ' ', '""""', ',""', '\r\n', 'word ']) for _ in range(rng.randint(0, 12)))
    return f'"{content}"'


@pytest.mark.parametrize("size, end", [(60, "\n"), (333, "\r\n")])
def test_equal_to_the_one_task_reader(spark, tmp_path, small_ranges, size, end):
    rng = random.Random(size)
    folder = tmp_path / "in"
    folder.mkdir()
    for name in ("a", "b"):
        lines = ["k,review_text,summary,other"] + [",".join([str(i), cell(rng), cell(rng), cell(rng)]) for i in range(30)]
        content = end.join(lines) + (end if name == "a" else "")
        (folder / f"{name}.csv").write_bytes(content.encode())
    small_ranges(size)
    df, rows = both(spark, str(folder))
    assert len(rows) == 60 and df.columns == ["k", "review_text", "summary", "other"]
    assert spark.read.text(str(folder)).rdd.getNumPartitions() > 5
    both(spark, str(folder), schema="k int, review_text string, summary string, other string")


def test_header_over_several_lines_and_empty_lines(spark, tmp_path, small_ranges):
    path = tmp_path / "h.csv"
    path.write_text('"first\nname","a ""b""","c"\n\n1,"x\n\ny",\n\n"2","",z\n', encoding="utf-8")
    for size in (9, 10**6):
        small_ranges(size)
        df, rows = both(spark, str(path))
        assert df.columns == ["first\nname", 'a "b"', "c"]
        assert sorted(map(tuple, rows), key=repr) == [("1", "x\n\ny", None), ("2", None, "z")]


def test_record_over_many_ranges(spark, tmp_path, small_ranges):
    path = tmp_path / "long.csv"
    path.write_text("a,b\n1,\"" + "line ,\"\"x\"\"\n" * 60 + "\"\n2,y\n3,\"" + "\n" * 150 + "\"\n", encoding="utf-8")
    small_ranges(50)
    _, rows = both(spark, str(path))
    assert [r.a for r in rows] == ["1", "2", "3"]


def test_other_separator_and_no_header(spark, tmp_path, small_ranges):
    path = tmp_path / "s.csv"
    path.write_text('1;"a;\n""b"""\n2;c,"d\n', encoding="utf-8")
    small_ranges(5)
    _, rows = both(spark, str(path), sep=";", header=False)
    assert [tuple(r) for r in rows] == [("1", 'a;\n"b"'), ("2", 'c,"d')]


def test_wrong_headers_and_records_fail(spark, tmp_path):
    for name, content in (("one.csv", "a,b\n1,2\n"), ("two.csv", "a,c\n1,2\n"), ("bad.csv", "a,b\n1,2,3\n")):
        (tmp_path / name).write_text(content, encoding="utf-8")
    one, two, bad = (str(tmp_path / n) for n in ("one.csv", "two.csv", "bad.csv"))
    assert read_reviews(spark, one, schema="A string, b string").count() == 1
    with pytest.raises(Exception, match="header"):
        read_reviews(spark, two, schema="a string, b string").collect()
    with pytest.raises(Exception):
        read_reviews(spark, bad).collect()


def test_unclosed_quote_and_empty_file(spark, tmp_path, small_ranges):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n', encoding="utf-8")
    small_ranges(4)
    assert [tuple(r) for r in csv_records(spark, str(tmp_path / "open.csv")).orderBy("record").collect()] == [(False, '1,"x\n2,y'), (True, "a,b")]
    (tmp_path / "none.csv").write_text("a,b\n", encoding="utf-8")
    assert read_reviews(spark, str(tmp_path / "none.csv")).collect() == []


def test_written_tables_come_back(spark, tmp_path, small_ranges):
    rng = random.Random(0)
    rows = [(i, "".join(rng.choice(['"', ",", "\n", "\r\n", "\\", "ab", " "]) for _ in range(rng.randint(1, 30))) + ".") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, review_text string")
    write_reviews(df, str(tmp_path / "out"))
    small_ranges(150)
    assert sorted(map(tuple, read_reviews(spark, str(tmp_path / "out"), schema="i int, review_text string").collect())) == rows


@pytest.mark.parametrize("code, inside, after", [("", True, True), ("S", True, False), ("SS", False, False), ("RS", True, True), ("SR", False, False), ("R", True, False)])
def test_composition(code, inside, after):
    assert _after(code, inside) is after
