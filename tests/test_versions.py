import os

import pytest

from opinion_spark.sources.snapshot import freeze, frozen_settings, thaw
from opinion_spark.sources.versions import MANIFESTS, commit, current, drop_versions, new_folder, versions

SCHEMA = "eval_id bigint, body string, model string"


def frame(spark, n, model="m"):
    return spark.range(n).selectExpr("id AS eval_id", "'t' AS body", f"'{model}' AS model")


def test_reader_during_an_overwrite_sees_one_whole_version(spark, tmp_path):
    path = str(tmp_path / "f")
    freeze(frame(spark, 5, "old"), path, 50, "body")
    opened = thaw(spark, path)
    # Written, not yet committed: nobody sees it.
    folder = new_folder(path)
    frame(spark, 9, "new").write.parquet(folder)
    assert thaw(spark, path).count() == 5
    freeze(frame(spark, 7, "new"), path, 70, "body")
    assert {r.model for r in opened.collect()} == {"old"} and opened.count() == 5
    now = thaw(spark, path)
    assert {r.model for r in now.collect()} == {"new"} and now.count() == 7 and frozen_settings(now) == (70, "body")


def test_settings_survive_no_rows(spark, tmp_path):
    path = str(tmp_path / "f")
    freeze(spark.createDataFrame([], SCHEMA), path, 120, "body")
    frozen = thaw(spark, path, "m")
    assert frozen.count() == 0 and frozen_settings(frozen) == (120, "body")
    freeze(spark.createDataFrame([], SCHEMA), path)
    assert frozen_settings(thaw(spark, path)) == (None, None)
    # Frozen rows can be frozen again.
    freeze(frame(spark, 2), path, 3, "body")
    freeze(thaw(spark, path), path, 4, "body")
    assert frozen_settings(thaw(spark, path)) == (4, "body") and thaw(spark, path).count() == 2


def test_old_versions_go_and_the_current_one_stays(spark, tmp_path):
    path = str(tmp_path / "f")
    for n in range(1, 5):
        freeze(frame(spark, n), path, n, "body", keep=2)
    assert [v.number for v in versions(spark, path)] == [3, 4]
    assert len([d for d in os.listdir(path) if d.startswith("data-")]) == 2
    assert drop_versions(spark, path, 1) == 1 and thaw(spark, path).count() == 4
    with pytest.raises(ValueError):
        drop_versions(spark, path, 0)


def test_unfinished_manifest_does_not_count(spark, tmp_path):
    path = str(tmp_path / "f")
    freeze(frame(spark, 3), path, 30, "body")
    with open(f"{path}/{MANIFESTS}/{2:012d}.json", "w") as half:
        half.write('{"folder": "data-')
    assert current(spark, path).number == 1 and thaw(spark, path).count() == 3
    # The number is taken: the next writer goes past it.
    freeze(frame(spark, 4), path, 40, "body")
    assert current(spark, path).number == 3 and thaw(spark, path).count() == 4


def test_two_writers_get_two_numbers(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f")
    first, second = new_folder(path), new_folder(path)
    commit(spark, path, first, {"who": 1})
    # The second writer listed the versions before the first one's commit.
    monkeypatch.setattr("opinion_spark.sources.versions._numbers", lambda spark, path: [])
    assert commit(spark, path, second, {"who": 2}).number == 2
    monkeypatch.undo()
    assert [v.settings["who"] for v in versions(spark, path)] == [1, 2] and current(spark, path).folder == second


def test_folder_without_versions_is_read_as_before(spark, tmp_path):
    path = str(tmp_path / "f")
    frame(spark, 2).selectExpr("*", "5L AS sample_size", "'body' AS text_column").write.parquet(path)
    assert current(spark, path) is None and frozen_settings(thaw(spark, path)) == (5, "body")
