"""Shards by proportional stratified interleaving.

Within each source the rows are put in a seeded random order, and a row's place
in it becomes a fraction of the source. All rows sorted by that fraction carry
the same mixture of sources everywhere, so equal cuts of the sorted table are
shards of equal row counts in which every source has its share.

No task sees a whole source: order within a source and over all rows is found
from counts of slices, and rows are numbered inside a slice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named
from opinion_spark.session import stage

#: Rows that a slice has on average, and the most slices an order is cut into (beyond them slices grow, and are sorted on disk).
SLICE_ROWS = 500
MAX_SLICES = 1 << 16


def stratified_order(rows: DataFrame, stratum: str, tie: list[str], n_rows: int, seed: int = 42, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``rows`` with ``place``: 0 to n - 1 in the interleaved order.

    ``tie``: columns that tell rows apart; rows equal in all of them are
    interchangeable. A null stratum is a stratum of its own.
    """
    slices = max(1, min(MAX_SLICES, -(-n_rows // slice_rows)))
    # 53 bits: exact as a double.
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *(named(c) for c in tie)), 11)
    drawn = rows.withColumn("_h", h).withColumn("_s", F.floor(F.col("_h").cast("double") / float(1 << 53) * slices))
    # Rows before a slice within its stratum, and all rows of the stratum.
    counts = drawn.groupBy(named(stratum).alias("_st"), F.col("_s").alias("_cs")).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.select(
        "_st", "_cs",
        (F.sum("_n").over(Window.partitionBy("_st").orderBy("_cs").rowsBetween(Window.unboundedPreceding, -1))).alias("_before"),
        F.sum("_n").over(Window.partitionBy("_st")).alias("_all"),
    )
    within = Window.partitionBy(named(stratum), "_s").orderBy("_h", *(named(c) for c in tie))
    ranked = drawn.withColumn("_r", F.row_number().over(within)).join(
        counts, named(stratum).eqNullSafe(F.col("_st")) & (F.col("_s") == F.col("_cs"))
    )
    fraction = (F.coalesce(F.col("_before"), F.lit(0)) + F.col("_r") - 0.5) / F.col("_all")
    return _number(ranked.withColumn("_f", fraction).drop("_st", "_cs", "_before", "_all", "_r", "_s"), slices, [stratum, *tie])


def _number(rows: DataFrame, slices: int, tie: list[str]) -> DataFrame:
    """Place of each row by ``_f`` over all rows; fractions are spread evenly, so that slices are alike."""
    cut = rows.withColumn("_s", F.floor(F.col("_f") * slices).cast("bigint"))
    counts = cut.groupBy(F.col("_s").alias("_cs")).agg(F.count(F.lit(1)).alias("_n"))
    # At most MAX_SLICES rows.
    before = counts.select("_cs", F.coalesce(F.sum("_n").over(Window.orderBy("_cs").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_s").orderBy("_f", "_h", *(named(c) for c in tie))
    return (
        cut.withColumn("_r", F.row_number().over(within)).join(before, F.col("_s") == F.col("_cs"))
        .withColumn("place", F.col("_before") + F.col("_r") - 1).drop("_s", "_cs", "_before", "_r", "_f", "_h")
    )


def shard_documents(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 42) -> DataFrame:
    """Shard and slot of every row: ``doc_id, source, size, text_crc32, shard, slot``.

    Law ``rows``: the counts of two shards differ by one at most, and each
    source has its share of every shard. ``size`` is the text's UTF-8 bytes plus
    1. Null texts count as empty, null sources as one source; rows with a null
    or a repeated key are placed like all others. Equal rows may swap places.
    """
    content = F.coalesce(named(text), F.lit(""))
    slim = stage(docs.select(
        named(key).cast("bigint").alias("doc_id"), named(source).cast("string").alias("source"),
        (F.octet_length(content) + F.lit(1)).cast("bigint").alias("size"), F.crc32(F.encode(content, "UTF-8")).alias("text_crc32"),
    ), "shard-rows")
    n_rows = slim.count()
    ordered = stratified_order(slim, "source", ["doc_id", "size", "text_crc32"], n_rows, seed)
    # Shard k begins at the first place that is not under k * n / shards.
    n = max(n_rows, 1)
    shard = f"(place * {shards}) div {n}"
    first = f"({shard} * {n} + {shards - 1}) div {shards}"
    return ordered.select(
        "doc_id", "source", "size", "text_crc32", F.expr(shard).cast("int").alias("shard"), F.expr(f"place - ({first})").cast("bigint").alias("slot"),
    )
