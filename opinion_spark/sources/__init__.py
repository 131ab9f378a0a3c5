from opinion_spark.sources.bundle import load_model, save_model
from opinion_spark.sources.ingest import ingest_reviews
from opinion_spark.sources.reviews import read_reviews, write_reviews
from opinion_spark.sources.roles import ReviewSchema, resolve_roles
from opinion_spark.sources.snapshot import freeze, thaw

__all__ = ["ReviewSchema", "freeze", "ingest_reviews", "load_model", "read_reviews", "resolve_roles", "save_model", "thaw", "write_reviews"]
