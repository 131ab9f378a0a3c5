"""TF-IDF: vocabulary by aggregation, vectors by map-only ML stages."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer, SQLTransformer
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinion_spark.functions import text as words
from opinion_spark.functions.columns import named, quoted
from opinion_spark.functions.stop_words import FEATURE
from opinion_spark.operators.gram_counts import count_grams
from opinion_spark.session import stage

# The default settings of the feature step.
MAX_FEATURES = 15_000
NGRAM_SIZES = (1, 2)
MIN_DF = 3
MAX_DF = 0.9

STEPS_PER_DOUBLING = 16
VOCABULARY_SCHEMA = "term string, term_index int, df bigint, total_tf bigint, idf double"


def tokenize(df: DataFrame, text: str, stop_words: Sequence[str] = FEATURE, sizes: tuple[int, int] = NGRAM_SIZES) -> DataFrame:
    """Add ``tokens`` (words less stop words) and ``terms`` (their n-grams)."""
    return df.withColumn("tokens", F.expr(words.without_words(words.feature_tokens(quoted(text)), stop_words))).withColumn(
        "terms", F.expr(words.ngrams("tokens", sizes))
    )


def term_statistics(df: DataFrame, text: str, stop_words: Sequence[str] = FEATURE, sizes: tuple[int, int] = NGRAM_SIZES) -> DataFrame:
    """Document frequency and total frequency per term.

    Tasks count the terms of blocks of documents, a document's terms once for
    its frequency. One aggregation of these counts on the term then yields both
    numbers, and no shuffle by document is needed.
    """
    docs = df.select(named(text).cast("string").alias("t")).filter("t IS NOT NULL")
    tokens = docs.select(F.expr(words.without_words(words.feature_tokens("t"), stop_words)).alias("tokens"))
    return count_grams(tokens, "tokens", sizes).groupBy("term").agg(F.sum("df").alias("df"), F.sum("total_tf").alias("total_tf"))


@dataclass(frozen=True)
class Tfidf:
    """A fitted vocabulary with its weights, terms in alphabetic order."""

    text: str
    stop_words: tuple[str, ...]
    sizes: tuple[int, int]
    n_docs: int
    terms: tuple[str, ...]
    df: tuple[int, ...]
    total_tf: tuple[int, ...]

    @property
    def idf(self) -> list[float]:
        return [math.log((1 + self.n_docs) / (1 + n)) + 1 for n in self.df]

    def vocabulary(self, spark: SparkSession) -> DataFrame:
        rows = zip(self.terms, range(len(self.terms)), self.df, self.total_tf, self.idf)
        return spark.createDataFrame(list(rows), VOCABULARY_SCHEMA)

    def stages(self, out: str = "features") -> list[Transformer]:
        """Stages from text to unit-length vectors; all of them work row by row."""
        tokens = words.without_words(words.feature_tokens(f"coalesce(CAST({quoted(self.text)} AS STRING), '')"), self.stop_words)
        return [
            SQLTransformer(statement=f"SELECT *, {tokens} AS tokens FROM __THIS__"),
            SQLTransformer(statement=f"SELECT *, {words.ngrams('tokens', self.sizes)} AS terms FROM __THIS__"),
            CountVectorizerModel.from_vocabulary(list(self.terms), inputCol="terms", outputCol="term_counts"),
            ElementwiseProduct(scalingVec=Vectors.dense(self.idf), inputCol="term_counts", outputCol="term_weights"),
            Normalizer(p=2.0, inputCol="term_weights", outputCol=out),
        ]

    def vectors(self, df: DataFrame, out: str = "features") -> DataFrame:
        """Add the weight vector of each row; terms outside the vocabulary do not count."""
        return PipelineModel(self.stages(out)).transform(df).drop("tokens", "terms", "term_counts", "term_weights")

    def weights(self, df: DataFrame, key: str) -> DataFrame:
        """The vectors in long form: one row per document and vocabulary term."""
        transformed = PipelineModel(self.stages()).transform(df)
        counts, weights = F.unwrap_udt(F.col("term_counts")), F.unwrap_udt(F.col("features"))
        entries = F.arrays_zip(
            counts["indices"].alias("term_index"), counts["values"].alias("tf"), weights["values"].alias("weight")
        )
        long = transformed.select(named(key), F.inline(entries).alias("term_index", "tf", "weight"))
        terms = self.vocabulary(df.sparkSession).select("term_index", "term")
        return long.join(terms, "term_index").select(key, "term", F.col("tf").cast("bigint").alias("tf"), "weight")


def fit_tfidf(
    df: DataFrame,
    text: str,
    stop_words: Sequence[str] = FEATURE,
    sizes: tuple[int, int] = NGRAM_SIZES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = MAX_FEATURES,
    n_docs: int | None = None,
) -> Tfidf:
    """The vocabulary of the given (training) documents.

    Terms in fewer than ``min_df`` documents or in more than the share
    ``max_df`` of them are dropped, then the ``max_features`` most frequent
    kept, equal frequencies in term order. Only these reach the driver.
    """
    if n_docs is None:
        n_docs = df.filter(named(text).isNotNull()).count()
    stats = term_statistics(df, text, stop_words, sizes)
    kept = stage(stats.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs)), "terms")
    # A histogram of frequencies finds how deep the top list reaches, so that
    # the final sort sees little more than the terms it returns.
    depth = F.floor(F.log2("total_tf") * STEPS_PER_DOUBLING)
    steps = sorted(kept.groupBy(depth.alias("step")).count().collect(), key=lambda r: -r["step"])
    total = sum(r["count"] for r in steps)
    if total == 0:
        raise ValueError("no terms remain: texts hold only stop words, or min_df/max_df prune too much")
    wanted = total if max_features is None else min(max_features, total)
    reached = 0
    for row in steps:
        lowest, reached = row["step"], reached + row["count"]
        if reached >= wanted:
            break
    top = kept.filter(depth >= lowest).orderBy(F.desc("total_tf"), F.asc("term")).limit(wanted).collect()
    top.sort(key=lambda r: r.term)
    return Tfidf(
        text, tuple(stop_words), sizes, n_docs,
        tuple(r.term for r in top), tuple(r.df for r in top), tuple(r.total_tf for r in top),
    )
