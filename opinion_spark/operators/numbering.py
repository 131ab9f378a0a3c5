"""Dense numbers over a whole table in a given order, without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinion_spark.functions.columns import free_name
from opinion_spark.session import stage

#: Row numbers within a task are the low bits of Spark's increasing id, the task the high ones.
TASK_BITS = 33


def numbered(df: DataFrame, order: list[Column], out: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``out``: 0, 1, ... in ``order``, which must leave no ties; written.

    Rows are dealt out by ranges of the order and sorted in each. Counts per
    range, one row a task, then give the number that each range begins with.
    """
    return positioned(df.repartitionByRange(*order).sortWithinPartitions(*order), out, name)


def positioned(df: DataFrame, out: str, name: str = "numbered") -> DataFrame:
    """``df`` with ``out``: 0, 1, ... in the order its rows have now, as after a sort; written, without a shuffle of its rows.

    A table read from several files has an order only by ``file_positions`` or
    a sort: Spark reads large files first and puts small ones together.
    """
    n, part, rows, begin = (free_name([*df.columns, out], c) for c in ("_n", "_part", "_rows", "_begin"))
    written = stage(df.withColumn(n, F.monotonically_increasing_id()), name)
    task = F.shiftright(n, TASK_BITS)
    # As many rows as there were tasks.
    counts = written.groupBy(task.alias(part)).agg(F.count(F.lit(1)).alias(rows))
    begins = counts.select(part, (F.sum(rows).over(Window.orderBy(part)) - F.col(rows)).alias(begin))
    local = F.col(n).bitwiseAND(F.lit((1 << TASK_BITS) - 1))
    return written.withColumn(part, task).join(begins, part).withColumn(out, F.col(begin) + local).drop(part, begin, n)


def file_positions(spark: SparkSession, path: str, out: str) -> DataFrame:
    """The rows of a Parquet table with ``out``: 0, 1, ... by file name and place in the file.

    Nothing is sorted or written: one count per file says what its rows begin with.
    """
    table = spark.read.parquet(path)
    file, begin, at = (free_name([*table.columns, out], c) for c in ("_file", "_begin", "_at"))
    rows = table.select("*", F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(at))
    counts = rows.groupBy(file).agg(F.count(F.lit(1)).alias(begin))
    begins = counts.select(file, (F.sum(begin).over(Window.orderBy(file)) - F.col(begin)).alias(begin))
    return rows.join(begins, file).withColumn(out, F.col(begin) + F.col(at)).drop(file, begin, at)
