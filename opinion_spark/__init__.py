"""Sentiment analytics over large tables of written reviews, on PySpark."""

from opinion_spark.session import build_session, scratch_path, stage
from opinion_spark.sources.roles import ReviewSchema, resolve_roles

__all__ = ["ReviewSchema", "build_session", "resolve_roles", "scratch_path", "stage"]
