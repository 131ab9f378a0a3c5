"""The review table that the registered queries run on, from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL, RATING
from opinion_spark.functions.labels import with_label
KEY = "doc_id"
TEXT = "review_text"
TITLE = "review_title"
COUNTRY = "country"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table, in its own partitions unless the session names a number.

    A table in one file of one row group is one task. Who knows that to be so
    can set ``spark.opinion_spark.textPartitions``; the texts are then dealt out.
    """
    partitions = spark.conf.get("spark.opinion_spark.textPartitions", None)
    found = table(spark, sf_dir, "documents")
    return found.repartition(int(partitions)) if partitions else found


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews without a rating: no join where only the text matters."""
    return documents(spark, sf_dir).select(
        KEY, F.col("text").alias(TEXT), F.split_part("text", F.lit("\n"), F.lit(1)).alias(TITLE), F.col("lang").alias(COUNTRY)
    )


def unlabelled(spark: SparkSession, sf_dir: str, how: str = "left") -> DataFrame:
    """Every document as a review; its rating comes from its quality marks, if it has any."""
    d = documents(spark, sf_dir)
    m = table(spark, sf_dir, "labels").withColumnRenamed(KEY, "marked_id")
    rating = (
        F.when(F.col("marked_id").isNull(), None)
        .when(F.col("toxic") == 1, 1 + F.col("quality"))
        .when(F.col("quality") == 0, 3)
        .otherwise(4 + F.col("n_chars") % 2)
    )
    return d.join(m, d[KEY] == F.col("marked_id"), how).select(
        KEY,
        F.col("text").alias(TEXT),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias(TITLE),
        F.col("lang").alias(COUNTRY),
        rating.cast("double").alias(RATING),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All reviews with their label; unrated ones count as positive."""
    return with_label(unlabelled(spark, sf_dir))


def rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with a rating, for training and evaluation."""
    return with_label(unlabelled(spark, sf_dir, "inner").filter(F.col(RATING).isNotNull()))


__all__ = ["COUNTRY", "KEY", "LABEL", "RATING", "TEXT", "TITLE", "rated", "reviews", "table", "texts", "unlabelled"]
