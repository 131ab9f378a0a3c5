"""Arrow batches of documents for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.session import stage

#: Characters of text that are worked on at a time: bounds the memory of a task, whatever the batch.
BLOCK_CHARS = 1 << 20
#: Bytes of an Arrow batch, of which an executor and a worker hold one or two a task: by Spark's default up to 64 MB.
BATCH_BYTES = 4 * BLOCK_CHARS
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores after it as make it one that no column has."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered_rows(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` with a number of its own for every row, whatever its ids, and that column's name, one the table does not have.

    Written, so that it stays the same in every reading.
    """
    row = free_name(df, "_row_number")
    return stage(df.withColumn(row, F.monotonically_increasing_id()), "numbered-rows"), row


def row_slices(batch: pa.RecordBatch, text: str | int, limit: int = BLOCK_CHARS) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of about ``limit`` bytes of ``text``, without a copy: a caller makes Python objects of one at a time."""
    place = text if isinstance(text, int) else batch.schema.get_field_index(text)
    upto = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(place)), 0), dtype=np.int64) + 64)
    start = 0
    while start < len(upto):
        end = int(np.searchsorted(upto, (upto[start - 1] if start else 0) + limit)) + 1
        yield batch.slice(start, end - start)
        start = end


def map_batches(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` on batches of about ``BATCH_BYTES``, whatever the length of the texts.

    The limit is a setting of the session, as Spark reads it where a task runs; one that is set already stays.
    """
    conf = df.sparkSession.conf
    if conf.get(_BATCH_LIMIT, None) is None:
        conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(work, schema)


def map_blocks(
    df: DataFrame,
    run: Callable[[dict[str, list]], dict[str, list] | None],
    schema: str,
    text: str = "text",
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """Apply ``run`` to blocks of rows of about ``block_chars`` characters of ``text``.

    ``run`` takes the columns as lists and returns the columns of ``schema``
    (lists or numpy arrays of any equal length), or None for no rows.
    """
    struct = StructType.fromDDL(schema)
    arrow = to_arrow_schema(struct)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, text, block_chars):
                made = run({n: rows.column(i).to_pylist() for i, n in enumerate(rows.schema.names)})
                if made is not None:
                    yield pa.RecordBatch.from_arrays([pa.array(made[f.name], type=f.type, from_pandas=True) for f in arrow], schema=arrow)

    return map_batches(df, work, struct)


def edit_rows(df: DataFrame, edit: Callable[[list], tuple[list | None, list[bool] | None]], text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Rows of ``df`` with all their columns, with new texts and without those that ``edit`` rejects.

    ``edit`` takes the texts of a block and returns the new texts (None: as they
    are) and which rows stay (None: all).
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.schema.get_field_index(text)
            for rows in row_slices(batch, place, block_chars):
                new, stay = edit(rows.column(place).to_pylist())
                if new is not None:
                    kind = batch.schema.field(place).type
                    rows = rows.set_column(place, batch.schema.field(place), pa.array(new, type=kind))
                yield rows if stay is None else rows.filter(pa.array(stay, type=pa.bool_()))

    return map_batches(df, work, df.schema)
