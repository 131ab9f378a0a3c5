"""Two tables side by side: row i of one with row i of the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.columns import free_name, named
from opinion_spark.operators.numbering import positioned


def join_positions(left: DataFrame, right: DataFrame, at: str, right_at: str, out: str = "eval_id") -> DataFrame:
    """Columns of both tables by the row numbers ``at`` and ``right_at``, and that number as ``out``, first.

    Numbers count from 0 without gaps, as ``numbering`` gives them. A number that
    one table has and the other has not, as where one is longer, fails the
    job when the result is read, whatever columns are read of it.
    """
    own = [c for c in left.columns if c != at]
    other = [c for c in right.columns if c != right_at]
    names = [c.lower() for c in [out, *own, *other]]
    if len(set(names)) < len(names):
        raise ValueError(f"columns of the tables clash: {sorted({c for c in names if names.count(c) > 1})}")
    a, b = free_name(names, "_at"), free_name(names, "_right_at")
    both = left.withColumnRenamed(at, a).join(right.withColumnRenamed(right_at, b), F.col(a) == F.col(b), "full")
    wrong = F.raise_error(F.concat(F.lit("the tables differ in length: row "), F.coalesce(a, b).cast("string"), F.lit(" has no partner")))
    paired = both.withColumn(out, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(a)).otherwise(wrong.cast("bigint")))
    # A condition on the number keeps the check where its column is not read; its random part,
    # which changes nothing, keeps later conditions above it: they could take unpaired rows away before.
    return paired.filter(named(out) + F.rand() >= 0).select(named(out), *(named(c) for c in [*own, *other]))


def concat_columns(left: DataFrame, right: DataFrame, out: str = "eval_id") -> DataFrame:
    """Columns of both tables, joined by the order their rows have now, numbered 0, 1, ... in ``out``.

    For scores that arrive as a table of their own, in the order of the texts
    that were sent. Both tables are written once. Tables of several files that
    were read as they lie go through ``numbering.file_positions`` and
    ``join_positions`` instead.
    """
    at = free_name([*left.columns, *right.columns, out], "_position")
    return join_positions(positioned(left, at, "left-rows"), positioned(right, at, "right-rows"), at, at, out)
