"""Word and word-pair frequencies behind a word cloud."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named, quoted
from opinion_spark.functions.stop_words import CLOUD
from opinion_spark.functions.text import cloud_words
from opinion_spark.operators.gram_counts import count_successors
from opinion_spark.session import stage

# Size of the cloud and the score a pair must exceed.
TOP_WORDS = 200
PAIR_THRESHOLD = 30.0
TINY = 1e-10


def count_words(df: DataFrame, text: str, stop_words: Sequence[str] = CLOUD) -> DataFrame:
    """Occurrences ``n`` of each word that is no stop word, by the word after it.

    ``second`` is NULL at the end of a text and before a stop word, so that a
    row is a pair where ``second`` is set, and the rows of a word add up to its
    count. Successors are taken before stop words are left out, within a text.
    Tasks count pairs first, so that stop words are looked up once a distinct pair.
    """
    words = df.filter(named(text).isNotNull()).select(F.expr(cloud_words(quoted(text))).alias("words"))
    counted = count_successors(words, "words")
    stops = list(stop_words)
    if stops:
        counted = counted.filter(~F.lower("first").isin(stops)).withColumn(
            "second", F.when(~F.lower("second").isin(stops), F.col("second"))
        )
    return counted.groupBy("first", "second").agg(F.sum("n").alias("n"))


def _single_counts(counted: DataFrame) -> DataFrame:
    return counted.groupBy(F.col("first").alias("spelling")).agg(F.sum("n").alias("n"))


def fold_spellings(counts: DataFrame) -> DataFrame:
    """Merge the spellings of a word: case variants, and simple plurals into singulars.

    Takes ``spelling, n``; gives one row per word with its most frequent
    spelling as ``term`` (equal counts: first in order). A plural is a word
    ending in one s whose singular occurs as well. A word and its plural share
    a stem, so one shuffle on the stem serves all three steps.
    """
    word = F.col("word")
    stems = (
        counts.select("spelling", "n", F.lower("spelling").alias("word"))
        .withColumn("is_plural", word.endswith("s") & ~word.endswith("ss"))
        .withColumn("stem", F.when(F.col("is_plural"), _less_last(word)).otherwise(word))
    )
    has_singular = F.max(~F.col("is_plural")).over(Window.partitionBy("stem"))
    merged = stems.withColumn("merge", F.col("is_plural") & has_singular)
    forms = merged.groupBy(
        "stem",
        F.when(F.col("merge"), F.col("stem")).otherwise(F.col("word")).alias("word"),
        F.when(F.col("merge"), _less_last(F.col("spelling"))).otherwise(F.col("spelling")).alias("form"),
    ).agg(F.sum("n").alias("n"), F.max("merge").alias("with_plural"))
    return forms.groupBy("stem", "word").agg(
        F.min_by("form", F.struct(-F.col("n"), F.col("form"))).alias("term"),
        F.sum("n").alias("n"),
        F.max("with_plural").alias("with_plural"),
    ).drop("stem")


def pair_score(c12: Column, c1: Column, c2: Column, n: Column) -> Column:
    """Log-likelihood ratio of a pair against independent words; 0 if one word is all there is."""
    def likelihood(k: Column, m: Column, x: Column) -> Column:
        return k * F.log(F.greatest(x, F.lit(TINY))) + (m - k) * F.log(F.greatest(1 - x, F.lit(TINY)))

    together, after = c2 / n, c12 / c1
    without = F.try_divide(c2 - c12, n - c1)
    score = -2 * (
        likelihood(c12, c1, together) + likelihood(c2 - c12, n - c1, together)
        - likelihood(c12, c1, after) - likelihood(c2 - c12, n - c1, without)
    )
    return F.when((n <= c1) | (n <= c2), F.lit(0.0)).otherwise(score)


@dataclass(frozen=True)
class WordCounts:
    """Folded words (stored, as they are read several times) and pairs as spelled."""

    words: DataFrame
    pairs: DataFrame
    total: int


def store_counts(df: DataFrame, text: str, stop_words: Sequence[str] = CLOUD) -> WordCounts:
    """Count words and pairs in one pass over the texts and store the counts."""
    counted = stage(count_words(df, text, stop_words), "word-counts")
    words = stage(fold_spellings(_single_counts(counted)), "words")
    total = words.agg(F.sum("n")).first()[0] or 0
    return WordCounts(words, counted.filter(F.col("second").isNotNull()), total)


def score_pairs(counts: WordCounts) -> DataFrame:
    """The score of every pair, with the names and counts of its words."""
    # A merged plural is looked up under its own spelling too.
    known = counts.words.select(
        F.explode(F.when(F.col("with_plural"), F.array("word", F.concat("word", F.lit("s")))).otherwise(F.array("word"))).alias("word"),
        F.col("term").alias("name"), F.col("n").alias("c"),
    )
    pairs = fold_spellings(
        counts.pairs.select(F.concat_ws(" ", "first", "second").alias("spelling"), "n")
    ).select("term", F.col("n").alias("c12"), F.split("word", " ").alias("both"))
    joined = (
        pairs.withColumn("w1", F.col("both")[0]).withColumn("w2", F.col("both")[1])
        .join(known.select(F.col("word").alias("w1"), F.col("name").alias("word1"), F.col("c").alias("c1")), "w1")
        .join(known.select(F.col("word").alias("w2"), F.col("name").alias("word2"), F.col("c").alias("c2")), "w2")
    )
    as_double = [F.col(c).cast("double") for c in ("c12", "c1", "c2")]
    return joined.select(
        F.col("term").alias("pair"), "word1", "word2", F.col("c12").alias("n"), "c1", "c2",
        pair_score(*as_double, F.lit(float(counts.total))).alias("score"),
    )


def collocations(df: DataFrame, text: str, stop_words: Sequence[str] = CLOUD, threshold: float = PAIR_THRESHOLD) -> DataFrame:
    """The pairs that score above the threshold."""
    return score_pairs(store_counts(df, text, stop_words)).filter(F.col("score") > threshold)


def word_frequencies(
    df: DataFrame,
    text: str,
    stop_words: Sequence[str] = CLOUD,
    top: int = TOP_WORDS,
    pairs: bool = True,
    threshold: float = PAIR_THRESHOLD,
) -> DataFrame:
    """The ``top`` words and collocations with counts, and counts relative to the largest.

    A collocation is a term of its own, and its count is taken off both of its
    words; terms left with nothing vanish. Equal counts are in term order.
    """
    if pairs:
        counts = store_counts(df, text, stop_words)
        found = score_pairs(counts).filter(F.col("score") > threshold)
        changes = found.select(F.inline(F.array(
            F.struct(F.col("pair").alias("term"), F.col("n").alias("n")),
            F.struct(F.col("word1").alias("term"), (-F.col("n")).alias("n")),
            F.struct(F.col("word2").alias("term"), (-F.col("n")).alias("n")),
        )))
        terms = counts.words.select("term", "n").unionByName(changes).groupBy("term").agg(F.sum("n").alias("n"))
        terms = terms.filter(F.col("n") > 0)
    else:
        terms = fold_spellings(_single_counts(count_words(df, text, stop_words))).select("term", "n")
    best = terms.orderBy(F.desc("n"), F.asc("term")).limit(top)
    # At most ``top`` rows are left for the one-task window.
    return best.withColumn("relative", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def _less_last(text: Column) -> Column:
    return F.substring(text, F.lit(1), F.length(text) - 1)
