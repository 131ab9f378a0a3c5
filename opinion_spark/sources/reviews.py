"""Reading and writing review tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opinion_spark.constants import LABEL, RATING
from opinion_spark.functions.columns import named
from opinion_spark.sources.csv_ranges import csv_records, parse_records

# Cells of a CSV file that stand for a missing value.
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

#: Options with which a file can be read in ranges.
RANGE_OPTIONS = {"sep", "header", "nullValue", "emptyValue", "nanValue", "ignoreLeadingWhiteSpace", "ignoreTrailingWhiteSpace", "mode", "maxCharsPerColumn"}

INTEGER = r"^\s*[+-]?\d{1,18}\s*$"
NUMBER = r"^\s*[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity))\s*$"
BOOLEAN = r"^(True|TRUE|true|False|FALSE|false)$"


def read_reviews(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    schema: T.StructType | str | None = None,
    null_tokens: Sequence[str] = NULL_TOKENS,
    infer: bool = False,
    multi_line: bool = True,
    cache: bool = False,
    parallel: bool = True,
    **options,
) -> DataFrame:
    """A review table from CSV (default), parquet, JSON, ORC or a catalog table.

    CSV cells are read as text, null tokens become NULL, then the columns get
    their types: those of ``schema``; or inferred from all cells with
    ``infer=True`` (one more pass over the file); or, by default, double for
    the rating and int for the label, text for the rest.

    Quoted line breaks need ``multi_line=True``. A file is then read by many
    tasks (see ``csv_ranges``), after two passes over it that find where quotes
    are open and join what crosses ranges; with ``parallel=False``, or an option that changes quotes, line ends
    or encoding, Spark's reader takes each file in one task. Where no cell holds
    a line break, ``multi_line=False`` saves that pass. Store the result as
    parquet when it is read more than once, or pass ``cache=True`` to parse it
    once for the session.
    """
    df = _read(spark, path, fmt, schema, null_tokens, infer, multi_line, parallel, options)
    return df.persist(StorageLevel.MEMORY_AND_DISK) if cache else df


def _read(spark, path, fmt, schema, null_tokens, infer, multi_line, parallel, options) -> DataFrame:
    if fmt == "table":
        return spark.table(path)
    if fmt != "csv":
        reader = spark.read.format(fmt).options(**options)
        return (reader.schema(schema) if schema is not None else reader).load(path)

    target = _as_struct(schema)
    settings = {
        "header": True, "quote": '"', "escape": '"', "multiLine": multi_line, "encoding": "UTF-8",
        "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "enforceSchema": False, "mode": "FAILFAST", **options,
    }
    reader = spark.read.options(**settings)
    if target is not None:
        reader = reader.schema(T.StructType([T.StructField(f.name, T.StringType()) for f in target]))
    if parallel and multi_line and RANGE_OPTIONS.issuperset(options):
        names = [f.name for f in target] if target is not None else reader.csv(path).columns
        header = str(settings.pop("header")).lower() == "true"
        cells = parse_records(csv_records(spark, path, str(options.get("sep", ","))), names, header, **settings)
    else:
        cells = reader.csv(path)
    cells = cells.select(*(_or_null(c, null_tokens).alias(c) for c in cells.columns))

    if target is not None:
        types = {f.name: f.dataType for f in target}
    elif infer:
        types = infer_types(cells)
    else:
        types = {RATING: T.DoubleType(), LABEL: T.IntegerType()}
    return cells.select(*(_typed(c, types.get(c)).alias(c) for c in cells.columns))


def infer_types(cells: DataFrame) -> dict[str, T.DataType]:
    """Types of text columns, decided by every cell in one aggregation.

    Whole numbers without gaps are bigint; numbers (or nothing at all) are
    double; true/false without gaps is boolean; the rest stays text.
    """
    counts = cells.agg(*(
        F.struct(
            F.count_if(named(c).isNull()).alias("gaps"),
            *(F.count_if(~named(c).rlike(p)).alias(kind) for kind, p in
              (("not_integer", INTEGER), ("not_number", NUMBER), ("not_boolean", BOOLEAN))),
            F.count(named(c)).alias("filled"),
        ).alias(f"c{i}")
        for i, c in enumerate(cells.columns)
    )).first()
    types: dict[str, T.DataType] = {}
    for c, n in zip(cells.columns, counts):
        if n.filled == 0 or n.not_number == 0:
            whole = n.filled and n.not_integer == 0 and n.gaps == 0
            types[c] = T.LongType() if whole else T.DoubleType()
        elif n.not_boolean == 0 and n.gaps == 0:
            types[c] = T.BooleanType()
    return types


def write_reviews(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write a table with a header and without an index, NULL as an empty cell."""
    writer = df.write.mode(mode)
    if fmt != "csv":
        writer.format(fmt).save(path)
        return
    writer.options(
        header=True, quote='"', escape='"', encoding="UTF-8", nullValue="", emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    ).csv(path)


def _as_struct(schema: T.StructType | str | None) -> T.StructType | None:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def _or_null(name: str, null_tokens: Sequence[str]) -> Column:
    return F.when(named(name).isin(*null_tokens), None).otherwise(named(name))


def _typed(name: str, dtype: T.DataType | None) -> Column:
    if dtype is None:
        return named(name)
    if isinstance(dtype, T.IntegralType):
        # "1.0" is a whole number too, as it is written beside gaps; a fraction is not, and fails.
        number = named(name).cast("decimal(38,6)")
        return F.when(number == F.floor(number), number.cast(dtype)).when(
            number.isNotNull(), F.raise_error(F.concat(F.lit(f"column {name} holds a fraction: "), named(name))).cast(dtype)
        )
    return named(name).cast(dtype)
