"""Tables of bits that tell which keys are surely not in a list.

A table has a fixed size, whatever the list, and is sent to every task: rows
whose key it rules out need not be shuffled for a join with the list. Those it
lets through are in the list or share a bit with a key that is, so that an exact
join must follow. A list of many more keys than bits costs shuffle, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.llm.batches import free_name, map_batches

#: Bits of a table: 4 MB as sent to the tasks.
TABLE_BITS = 25
_PART_BYTES = 4096  # of Spark's bitmap functions


def bit_place(*keys: str) -> Column:
    """The bit of a key in a table."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << TABLE_BITS))


def bit_table(keys: DataFrame) -> Broadcast:
    """The table of the keys that are the rows of ``keys``."""
    bit = keys.select((bit_place(*keys.columns) + 1).alias("bit"))  # Spark counts bits from 1
    parts = bit.groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = np.zeros((1 << TABLE_BITS) // 8, dtype=np.uint8)
    for row in parts.collect():
        table[(row.part - 1) * _PART_BYTES:row.part * _PART_BYTES] = np.frombuffer(row.bits, dtype=np.uint8)
    return keys.sparkSession.sparkContext.broadcast(table)


def may_hold(table: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Which places have their bit set."""
    return (table[places >> 3] >> (places & 7).astype(np.uint8)) & 1 == 1


def filter_rows(df: DataFrame, table: Broadcast, *keys: str, held: bool = True) -> DataFrame:
    """Rows of ``df`` whose key the table may hold or, without ``held``, those whose key it surely does not."""
    place = free_name(df, "_place")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = may_hold(table.value, batch.column(batch.num_columns - 1).to_numpy()) == held
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(stay))

    return map_batches(df.withColumn(place, bit_place(*keys)), work, df.schema)
