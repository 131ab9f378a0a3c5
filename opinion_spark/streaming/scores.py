"""Scoring an unbounded stream of texts. Row by row, so no state and no watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from opinion_spark.operators.scoring import Factory, score


def read_text_stream(spark: SparkSession, folder: str, schema: T.StructType | str, glob: str | None = None, fmt: str = "parquet") -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(folder)


def score_stream(
    stream: DataFrame, text: str, scorer: str | Factory, model: str | None = None,
    max_chars: int | None = None, on_error: str = "fail",
) -> DataFrame:
    """The batch scoring on a streaming table, of whole texts unless ``max_chars`` is set; blank texts are not scored."""
    if not stream.isStreaming:
        raise ValueError("score_stream needs a streaming table; use score for a batch")
    return score(stream, text, scorer, model, max_chars, on_error)


def write_scores(scored: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append scored rows to parquet files; by default take what is there, then stop."""
    return (
        scored.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
