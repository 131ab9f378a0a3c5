"""CSV files with quoted line breaks, read in parallel.

Whether a line begins inside a quoted cell depends on all lines before it. The
file is read as lines, in the byte ranges of Spark's text reader. Each line,
and so each range, is a function of the state it begins in:

* an even run of quotes changes nothing,
* an odd run at the start of a cell enters or leaves quotes,
* any other odd run leaves them, or is plain text outside.

One pass composes the functions of each range, a running composition over the
ranges of a file gives the state that each begins in. With that, every range
puts its lines together to records by itself; only the records that cross its
borders are joined from their pieces. Records are parsed by Spark's own parser.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named, quoted, sql_text
from opinion_spark.session import reach_workers, stage

RANGE_SCHEMA = "file string, start bigint, leaves boolean, swaps boolean, crlf boolean"
PIECE_SCHEMA = "key bigint, begun boolean, first boolean, crlf boolean, piece string"
RECORD_SCHEMA = "first boolean, crlf boolean, record string"


def _lines(spark: SparkSession, path: str | Sequence[str], sep: str) -> DataFrame:
    """``file, start`` (of the range), ``line``, and ``code``: what its odd runs of quotes do, S to swap and R to leave."""
    # The ranges must be the same in every pass, whatever executors come and go.
    if spark.conf.get("spark.sql.files.minPartitionNum", None) is None:
        spark.conf.set("spark.sql.files.minPartitionNum", str(spark.sparkContext.defaultParallelism))
    lines = spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    mark = sql_text(sep)
    run = sql_text(f"\\Q{sep}\\E?\"+")
    odd = f"filter(regexp_extract_all(concat({mark}, line), {run}, 0), r -> length(replace(r, {mark}, '')) % 2 = 1)"
    code = f"if(instr(line, '\"') = 0, '', array_join(transform({odd}, r -> if(startswith(r, {mark}), 'S', 'R')), ''))"
    return lines.withColumn("code", F.expr(code))


def _after(code: str, inside: bool) -> bool:
    """The state after a line."""
    if not code:
        return inside
    left = code.rfind("R")
    swaps = len(code) - left - 1
    return swaps % 2 == 1 if left >= 0 else inside != (swaps % 2 == 1)


def range_states(lines: DataFrame) -> DataFrame:
    """``file, start, begins_inside, crlf`` of every range of the files; written, a row per range. A file's first line says how its lines end."""
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leaves, swaps, crlf = None, False, False, False
        out: list[tuple] = []
        for batch in batches:
            for file, start, code, cr in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if (file, start) != at:
                    if at is not None:
                        out.append((*at, leaves, swaps, crlf))
                    at, leaves, swaps, crlf = (file, start), False, False, cr
                if code:
                    leaves = leaves or "R" in code
                    swaps = _after(code, swaps)
        if at is not None:
            out.append((*at, leaves, swaps, crlf))
        columns = list(zip(*out, strict=True)) or [()] * 5
        types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["file", "start", "leaves", "swaps", "crlf"])

    ranges = stage(lines.select("file", "start", "code", F.endswith("line", F.lit("\r"))).mapInArrow(compose, RANGE_SCHEMA), "csv-ranges")
    order = Window.partitionBy("file").orderBy("start")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A range that leaves quotes somewhere forgets the state before it: the swaps since the last such range count.
    numbered = ranges.withColumn("era", F.sum(F.col("leaves").cast("int")).over(upto))
    since = Window.partitionBy("file", "era").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = numbered.withColumn("ends_inside", F.sum(F.col("swaps").cast("int")).over(since) % 2 == 1)
    return stage(ends.select("file", "start", F.coalesce(F.lag("ends_inside").over(order), F.lit(False)).alias("begins_inside"), F.first("crlf").over(order).alias("crlf")), "csv-states")


def _range_key(file: str = "file", start: str = "start") -> Column:
    return F.xxhash64(file, start)


def _known_states(states: DataFrame):
    """Of each range whether it begins inside quotes, begins a file, and has lines that end in CRLF, for the tasks.

    One entry for each input split, as the driver plans them.
    """
    found = states.select(_range_key().alias("key"), "begins_inside", (F.col("start") == 0).alias("begins_file"), "crlf").collect()
    return states.sparkSession.sparkContext.broadcast({r.key: (r.begins_inside, r.begins_file, r.crlf) for r in found})


def _records_of(rows: Iterator[tuple[int, str, str]], known: dict[int, tuple[bool, bool, bool]]) -> Iterator[tuple[int, bool, bool, bool, bool, str]]:
    """``key, begun, ended, first, crlf, text`` of every record or piece: whether it begins and ends in this range, and is its file's first."""
    at, parts, begun, inside, first, crlf = None, [], True, False, False, False
    for key, line, code in rows:
        if key != at:
            if parts:
                yield at, begun, False, first, crlf, "\n".join(parts)
            if key not in known:
                raise RuntimeError("the files were read in other ranges than before; read them again")
            at, parts = key, []
            inside, first, crlf = known[key]
            begun = not inside
        parts.append(line)
        inside = _after(code, inside)
        if not inside:
            yield at, begun, True, first, crlf, parts[0] if len(parts) == 1 else "\n".join(parts)
            parts, begun, first = [], True, False
    if parts:
        yield at, begun, False, first, crlf, "\n".join(parts)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)


def _batched(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int = 5_000, limit: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    chars = 0
    for row in rows:
        held.append(row)
        chars += len(row[-1])
        if len(held) >= size or chars >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, chars = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def crossing_records(lines: DataFrame, states: DataFrame, known) -> DataFrame:
    """``first, record``: the records that lie in several ranges, put together from their pieces; written."""
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((key, begun, first, crlf, text) for key, begun, ended, first, crlf, text in _records_of(_rows(batches), known.value) if not (begun and ended))
        yield from _batched(found, [pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()], ["key", "begun", "first", "crlf", "piece"])

    # A range has one piece at most at either end, or is one piece as a whole.
    found = stage(lines.select(_range_key().alias("key"), "line", "code").mapInArrow(pieces, PIECE_SCHEMA), "csv-pieces")
    placed = found.join(states.select(_range_key().alias("key"), "file", "start"), "key")
    upto = Window.partitionBy("file").orderBy("start", "begun").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = placed.withColumn("number", F.sum(F.col("begun").cast("int")).over(upto))
    joined = numbered.groupBy("file", "number").agg(
        F.max("first").alias("first"), F.max("crlf").alias("crlf"), F.array_sort(F.collect_list(F.struct("start", "begun", "piece"))).alias("parts"))
    return stage(joined.select("first", "crlf", F.array_join(F.col("parts.piece"), "\n").alias("record")), "csv-crossing")


def csv_records(spark: SparkSession, path: str | Sequence[str], sep: str = ",") -> DataFrame:
    """``first, record``: every record of the files as text, and whether it is its file's first.

    Lines end in LF, or in CRLF if a file's first line does; in such a file line
    breaks inside quotes become LF, as in Spark's reader, else they are kept.
    Empty records are left out. A quote that is never closed reaches to the end
    of its file.
    """
    reach_workers(spark)
    lines = _lines(spark, path, sep)
    states = range_states(lines)
    known = _known_states(states)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((first, crlf, text) for _, begun, ended, first, crlf, text in _records_of(_rows(batches), known.value) if begun and ended)
        yield from _batched(found, [pa.bool_(), pa.bool_(), pa.string()], ["first", "crlf", "record"])

    inside = lines.select(_range_key().alias("key"), "line", "code").mapInArrow(whole, RECORD_SCHEMA)
    records = inside.unionByName(crossing_records(lines, states, known))
    record = F.col("record")
    bare = F.when(F.col("crlf"), F.replace(F.regexp_replace(record, "\r$", ""), F.lit("\r\n"), F.lit("\n"))).otherwise(record)
    return records.select("first", F.regexp_replace(bare, "^\uFEFF", "").alias("record")).filter("record <> ''")


def parse_records(records: DataFrame, names: Sequence[str], header: bool = True, **options) -> DataFrame:
    """The cells of ``csv_records`` as text columns ``names``.

    With ``header`` every file's first record must name the columns, and is left out.
    """
    schema = ", ".join(f"{quoted(n)} string" for n in names)
    cells = F.from_csv("record", schema, {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()})
    if header:
        # Spark names a repeated column by its place, and one without a name as _c and its place.
        same = [F.coalesce(F.lower(cells[n]).isin(n.lower(), n.lower().removesuffix(str(i))), F.lit(n == f"_c{i}")) for i, n in enumerate(names)]
        wrong = F.raise_error(F.concat(F.lit(f"the header is not {', '.join(names)}: "), "record")).cast("boolean")
        fits = same[0]
        for condition in same[1:]:
            fits = fits & condition
        records = records.filter(F.when(F.col("first"), F.when(fits, F.lit(False)).otherwise(wrong)).otherwise(F.lit(True)))
    return records.select(cells.alias("cells")).select(*(F.col("cells")[n].alias(n) for n in names))
