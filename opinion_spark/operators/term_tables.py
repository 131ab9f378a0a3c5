"""TF-IDF and naive Bayes over vocabularies of any size: terms and parameters stay tables.

Beside ``tfidf`` and ``classifiers``, whose vocabulary of at most some thousand
terms is a vector, nothing here reaches the driver but counts by class. A
document's terms are counted in its row; joins are by term, with a table that
has one row a term, so that adaptive execution can split frequent terms.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL
from opinion_spark.functions.columns import named
from opinion_spark.functions.stop_words import FEATURE
from opinion_spark.operators.numbering import numbered
from opinion_spark.operators.sampling import class_sizes
from opinion_spark.operators.tfidf import MAX_DF, MIN_DF, NGRAM_SIZES, term_statistics, tokenize
from opinion_spark.session import stage


@dataclass(frozen=True)
class TermTable:
    """A vocabulary: ``terms`` has ``term, term_index, df, total_tf, idf``, numbered in alphabetic order."""

    text: str
    stop_words: tuple[str, ...]
    sizes: tuple[int, int]
    n_docs: int
    terms: DataFrame

    def counts(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """``keep`` columns, ``term, tf``: a row for each term of each document, vocabulary or not."""
        docs = df.select(*map(named, keep), F.coalesce(named(self.text).cast("string"), F.lit("")).alias("_text"))
        listed = tokenize(docs, "_text", self.stop_words, self.sizes).select(*map(named, keep), F.sort_array("terms").alias("_terms"))
        # Places where a term differs from the one before, then the way to the next such place.
        starts = "filter(transform(_terms, (t, i) -> if(get(_terms, i - 1) <=> t, NULL, i)), i -> i IS NOT NULL)"
        runs = "transform(_starts, (s, k) -> struct(_terms[s] AS term, CAST(coalesce(get(_starts, k + 1), size(_terms)) - s AS BIGINT) AS tf))"
        found = listed.withColumn("_starts", F.expr(starts)).select(*map(named, keep), F.expr(f"inline_outer({runs})"))
        return found.filter(F.col("term").isNotNull())

    def weights(self, df: DataFrame, key: str, keep: Sequence[str] = (), fields: Sequence[str] = ("term", "term_index", "tf")) -> DataFrame:
        """Unit-length vectors in long form: ``key, *keep, *fields, weight``. Keys must be unique.

        Only ``fields`` are shuffled by document.
        """
        columns = [key, *keep]
        raw = self.counts(df, columns).join(self.terms.select("term", "term_index", "idf"), "term").withColumn("raw", F.col("tf") * F.col("idf"))
        entry = F.struct(*fields, "raw")
        # A row holds one document's terms.
        grouped = raw.groupBy(*map(named, columns)).agg(F.collect_list(entry).alias("entries"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
        return grouped.select(*map(named, columns), "norm", F.inline("entries")).select(
            *map(named, columns), *fields, (F.col("raw") / F.col("norm")).alias("weight"))


def fit_term_table(
    df: DataFrame,
    text: str,
    stop_words: Sequence[str] = FEATURE,
    sizes: tuple[int, int] = NGRAM_SIZES,
    min_df: int = MIN_DF,
    max_df: float = MAX_DF,
    max_features: int | None = None,
    n_docs: int | None = None,
) -> TermTable:
    """The vocabulary of the given documents as a table, all terms by default.

    The rules are those of ``fit_tfidf``. With ``max_features`` terms are
    numbered by frequency first, so that any limit is a filter.
    """
    if n_docs is None:
        n_docs = df.filter(named(text).isNotNull()).count()
    kept = term_statistics(df, text, stop_words, sizes).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n_docs))
    if max_features is not None:
        kept = numbered(kept, [F.desc("total_tf"), F.asc("term")], "_place", "terms-by-frequency").filter(F.col("_place") < max_features).drop("_place")
    idf = F.log(F.lit(float(1 + n_docs)) / (1 + F.col("df"))) + 1
    terms = numbered(kept, [F.asc("term")], "term_index", "terms").select("term", "term_index", "df", "total_tf", idf.alias("idf"))
    return TermTable(text, tuple(stop_words), sizes, n_docs, terms)


@dataclass(frozen=True)
class TableBayes:
    """Multinomial naive Bayes: ``parameters`` has ``term, idf`` and ``log_theta``, an array over ``classes``."""

    classes: tuple
    log_prior: tuple[float, ...]
    vocabulary: TermTable
    parameters: DataFrame

    def table(self, label: str = LABEL) -> DataFrame:
        """``label, term, log_theta, log_prior`` in long form."""
        entries = F.arrays_zip(F.array(*map(F.lit, self.classes)).alias(label), F.array(*map(F.lit, self.log_prior)).alias("log_prior"), F.col("log_theta").alias("log_theta"))
        return self.parameters.select("term", F.inline(entries)).select(label, "term", "log_theta", "log_prior")

    def predict(self, df: DataFrame, key: str, keep: Sequence[str] = ()) -> DataFrame:
        """``key, *keep, prediction, score`` of every row; keys must be unique.

        Equal scores go to the first class. A text without known terms has the
        priors alone. Only sums by document are shuffled after the join.
        """
        found = self.vocabulary.counts(df, [key]).join(self.parameters, "term").withColumn("raw", F.col("tf") * F.col("idf"))
        sums = [F.sum(F.col("raw") * F.col("log_theta")[i]).alias(f"_sum{i}") for i in range(len(self.classes))]
        grouped = found.groupBy(named(key).alias("_key")).agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("_norm"), *sums)
        scores = F.array(*(F.lit(p) + F.coalesce(F.col(f"_sum{i}") / F.col("_norm"), F.lit(0.0)) for i, p in enumerate(self.log_prior)))
        joined = df.select(named(key), *map(named, keep)).join(grouped, named(key) == F.col("_key"), "left").withColumn("_scores", scores)
        best = F.array_max("_scores")
        place = F.array_position("_scores", best).cast("int")
        return joined.select(named(key), *map(named, keep), F.array(*map(F.lit, self.classes))[place - 1].alias("prediction"), best.alias("score"))


def fit_table_bayes(vocabulary: TermTable, df: DataFrame, key: str, label: str = LABEL, alpha: float = 1.0) -> TableBayes:
    """Parameters by one aggregation of the training weights by term, a column a class; priors are class shares."""
    counts = class_sizes(df.select(named(label)), label)
    classes, total = tuple(counts), sum(counts.values())

    def of(c: Hashable) -> Column:
        return F.coalesce(F.sum(F.when(named(label) == F.lit(c), F.col("weight"))), F.lit(0.0))

    weights = vocabulary.weights(df.filter(named(label).isNotNull()), key, [label], ["term_index"])
    sums = stage(weights.groupBy("term_index").agg(*(of(c).alias(f"s{i}") for i, c in enumerate(classes))), "class-sums")
    # One row of sums over the classes.
    whole = sums.agg(F.count(F.lit(1)).alias("terms"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(len(classes)))).first()
    theta = F.array(*(F.log((F.col(f"s{i}") + alpha) / F.lit((whole[f"s{i}"] or 0.0) + alpha * whole.terms)) for i in range(len(classes))))
    parameters = stage(sums.join(vocabulary.terms, "term_index").select("term", "idf", theta.alias("log_theta")), "bayes-parameters")
    return TableBayes(classes, tuple(math.log(n / total) for n in counts.values()), vocabulary, parameters)
