"""Saving and loading the best model with its features, name and accuracy."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession

from opinion_spark.operators.classifiers import FittedModel
from opinion_spark.sources.versions import commit, current, drop_versions, new_folder

META_SCHEMA = "model_name string, accuracy double, text_column string, classes array<int>, log_prior array<double>"


def save_model(model: FittedModel, path: str, keep: int = 2) -> None:
    """Store the pipeline from text to label and its one-row description as the current version under ``path``.

    Both change at once for who loads the model. The newest ``keep`` versions stay.
    """
    spark, folder = SparkSession.active(), new_folder(path)
    model.pipeline.write().save(f"{folder}/pipeline")
    prior = list(model.log_prior) if model.log_prior else None
    row = (model.name, model.accuracy, model.text, list(model.classes), prior)
    spark.createDataFrame([row], META_SCHEMA).coalesce(1).write.parquet(f"{folder}/meta")
    commit(spark, path, folder, {"model_name": model.name})
    drop_versions(spark, path, keep)


def load_model(spark: SparkSession, path: str) -> FittedModel:
    """The current version under ``path``."""
    version = current(spark, path)
    folder = version.folder if version else path
    meta = spark.read.schema(META_SCHEMA).parquet(f"{folder}/meta").first()
    pipeline = PipelineModel.load(f"{folder}/pipeline")
    return FittedModel(
        name=meta.model_name, classes=tuple(meta.classes), text=meta.text_column,
        classifier=PipelineModel(pipeline.stages[-2:]), pipeline=pipeline, accuracy=meta.accuracy,
        log_prior=tuple(meta.log_prior) if meta.log_prior else None,
    )
