"""Frozen evaluation results: written once, read by every later view."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.sources.versions import commit, current, drop_versions, new_folder

#: Name of a column's setting in its metadata, where it is known without a row.
SETTING = "setting"


def freeze(scored: DataFrame, path: str, size: int | None = None, text: str | None = None, keep: int = 2) -> None:
    """Write scored rows with what later views need: the model's name is in ``model`` already,
    the sample size that was asked for and the text column's name go in ``sample_size`` and ``text_column``.

    The rows are a new version under ``path``: who reads at the same time sees
    the old rows or the new ones. The newest ``keep`` versions stay.
    """
    spark, folder = scored.sparkSession, new_folder(path)
    settings = {"sample_size": size, "text_column": text}
    scored.drop(*settings).select("*", *_columns(settings)).write.parquet(folder)
    commit(spark, path, folder, settings)
    drop_versions(spark, path, keep)


def frozen_settings(scored: DataFrame) -> tuple[int | None, str | None]:
    """Sample size and text column of frozen rows, also where there are no rows."""
    told = [scored.schema[c].metadata.get(SETTING) for c in ("sample_size", "text_column")]
    if told != [None, None]:
        return told[0], told[1]
    row = scored.select("sample_size", "text_column").first()
    return (row.sample_size, row.text_column) if row else (None, None)


def thaw(spark: SparkSession, path: str, expect_model: str | None = None) -> DataFrame:
    """Read the current version of frozen rows; warn when they come from another model than expected."""
    version = current(spark, path)
    scored = spark.read.parquet(version.folder if version else path)
    if version:
        scored = scored.drop(*version.settings).select("*", *_columns(version.settings))
    if expect_model is not None:
        other = scored.filter(~scored["model"].eqNullSafe(expect_model)).select("model").first()
        if other is not None:
            warnings.warn(f"frozen results come from {other.model!r}, not {expect_model!r}; score again", stacklevel=2)
    return scored


def _columns(settings: dict) -> list:
    types = {"sample_size": "bigint", "text_column": "string"}
    return [F.lit(v).cast(types[c]).alias(c, metadata={} if v is None else {SETTING: v}) for c, v in settings.items()]
