"""From raw documents to packed training sequences.

Stages, each over all that the one before it kept: quality rules (rejected
documents go), near duplicates (one document of each group stays), benchmark
decontamination (documents with a benchmark passage go), personal data (masked),
packing (sequences of token pieces). A stage's result is written as Parquet in
the shared folder and read again by the next, so that a lost executor costs no
more than its own tasks. All stages but the last return the columns of
documents, with further columns if the table has them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from opinion_spark.llm import decontamination, jaccard, packing, pii, quality
from opinion_spark.llm.queries import tokenizer_path
from opinion_spark.session import drop_staged, reach_workers, scratch_path, staged_paths

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule; a null or empty text fails."""
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the least id of each group of near copies, those without an id last; each row is a document."""
    return jaccard.keep_one_row(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.mask_pii(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, each with its sequence and offset."""
    return packing.pack_documents(docs, tokenizer_path)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("best-fit packing", packing_stage),
]

# SQL can express neither the tokenizer nor the order in which documents are packed.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages keep."""
    reach_workers(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        before = len(staged_paths(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        drop_staged(spark, before)  # what only this stage has read
        docs = spark.read.parquet(path)
    return docs
