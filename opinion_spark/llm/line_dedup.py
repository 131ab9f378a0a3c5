"""Repeated lines, paragraphs and sentences across documents, by digests of normalised units.

Units are lines and paragraphs of any length and, so that a passage set into a
longer line is found as well, the longer sentences of a line of several. Units
are normalised (lower case, letters and digits only, single blanks; one without
letters and digits by its signs), digested to 128 bits, and grouped over all
documents. The earliest occurrence by rank stays; the others are reported, and
removed, by their offsets in the original text, a unit inside another with it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import map_blocks, numbered_rows, row_slices
from opinion_spark.session import stage

#: Words below which a part of a line is too common a phrase to be a repetition.
MIN_WORDS = 8

_WORD = re.compile(r"\w+")
_LINES = re.compile(r"[^\n]+")
# Marks at the end of a sentence: each run of them is looked at once, however long.
_ENDS = re.compile(r"(?<![.!?])([.!?]++)[ \t]++")

UNIT_SCHEMA = "row bigint, doc_id bigint, start bigint, end bigint, n_words int, high bigint, low bigint"


def paragraphs(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for gap in [*re.finditer(r"\n[ \t]*\n\s*", text), None]:
        end = gap.start() if gap else len(text)
        if end > at:
            yield at, end
        at = gap.end() if gap else end


def sentences(line: str) -> Iterator[tuple[int, int]]:
    """Sentences of one line: up to the blanks after their marks; one mark alone at the beginning ends none."""
    at = 0
    for m in _ENDS.finditer(line):
        if m.end(1) - at > 1:
            yield at, m.end()
            at = m.end()
    if at < len(line):
        yield at, len(line)


def lines(text: str) -> Iterator[tuple[int, int]]:
    return (m.span() for m in _LINES.finditer(text))


def _line_sentences(text: str) -> Iterator[tuple[int, int]]:
    return ((start + a, start + b) for start, end in lines(text) for a, b in sentences(text[start:end]))


_UNITS = {"sentence": _line_sentences, "line": lines, "paragraph": paragraphs}


def _digest(normal: str) -> bytes:
    return hashlib.blake2b(normal.encode("utf-8", "replace"), digest_size=16).digest()


def _nested_units(text: str, min_words: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Units of every kind. A unit inside another is shorter by a word at least, so that none repeats itself."""
    block: list[tuple[int, int, list[str]]] = []  # lines with words of the open paragraph
    end = 0
    for m in [*_LINES.finditer(text), None]:
        line = m.group() if m else ""
        blank = not line.strip()
        if blank or m.start() > end + 1:
            if len(block) > 1:
                words = [w for *_, own in block for w in own]
                yield block[0][0], block[-1][1], len(words), _digest(" ".join(words))
            block = []
        if m:
            end = m.end()
        if blank:
            continue
        words = _WORD.findall(line.lower())
        yield m.start(), end, len(words), _digest(" ".join(words or line.split()))
        if words:
            block.append((m.start(), end, words))
        if len(words) > min_words:
            for a, b in sentences(line):
                own = _WORD.findall(line[a:b].lower()) if b - a < len(line) else words
                if min_words <= len(own) < len(words):
                    yield m.start() + a, m.start() + b, len(own), _digest(" ".join(own))


def units_of(text: str | None, unit: str = "sentence", min_words: int = MIN_WORDS) -> list[tuple[int, int, int, bytes]]:
    """Start, end, words and digest of every unit; offsets in code points, the end exclusive.

    Of one kind (``sentence``, ``line``, ``paragraph``) those of at least
    ``min_words`` words; of ``any`` kind all lines, paragraphs of several lines,
    and the sentences of at least ``min_words`` words within longer lines.
    """
    if not text:
        return []
    if unit == "any":
        return list(_nested_units(text, min_words))
    out = []
    for start, end in _UNITS[unit](text):
        words = _WORD.findall(text[start:end].lower())
        if len(words) >= min_words:
            out.append((start, end, len(words), _digest(" ".join(words))))
    return out


def find_units(docs: DataFrame, unit: str = "any", min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """The units of every row, written; ``row`` tells rows apart, whatever their ids: the column of that name, or else a number.

    A row without units has one entry with null offsets, so that it is not lost.
    """
    arrow = to_arrow_schema(StructType.fromDDL(UNIT_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 36
        for batch in batches:
            for part in row_slices(batch, 1):
                made = []
                for i, t, given in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    at = number if given is None else given
                    found = [(at, i, a, b, n, int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)) for a, b, n, d in units_of(t, unit, min_words)]
                    made += found or [(at, i, None, None, None, None, None)]
                    number += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow)

    given = named(row) if row else F.lit(None).cast("bigint")
    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"), given.alias("row"))
    return stage(source.mapInArrow(work, UNIT_SCHEMA), "units")


def repeated_units(units: DataFrame) -> DataFrame:
    """Every occurrence of a unit but the first: ``row, doc_id, start, end, n_words, first_doc_id, first_start``.

    Rank: document id (null last), row, offset.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "start")
    real = units.filter("start is not null")
    firsts = real.groupBy("high", "low").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    joined = real.join(firsts, ["high", "low"])
    return joined.filter((F.col("row") != F.col("first.row")) | (F.col("start") != F.col("first.start"))).select(
        "row", "doc_id", "start", "end", "n_words", F.col("first.doc_id").alias("first_doc_id"), F.col("first.start").alias("first_start"),
    )


def dedup_report(docs: DataFrame, unit: str = "any", min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """Per row: ``doc_id, n_units, n_removed, removed_words, removed, first_doc_ids``.

    ``removed`` lists ``start:end`` of the units to take out, in order, those
    inside another left out, and ``first_doc_ids`` the documents whose earlier
    occurrences stay (a null id is left out). A null or blank text has no units
    and loses nothing; of repeated rows the later ones lose all units. With
    ``row``, a column of ``docs`` without repeated or null values, the report has it as ``row``.
    """
    units = find_units(docs, unit, min_words, text, key, row)
    before = Window.partitionBy("row").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = repeated_units(units).withColumn("taken", F.coalesce(F.max("end").over(before), F.lit(0))).filter("start >= taken")
    gone = outer.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_removed"), F.sum("n_words").alias("removed_words"),
        F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"), F.array_sort(F.collect_set("first_doc_id")).alias("first_doc_ids"),
    )
    rows = units.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("start").alias("n_units"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return rows.join(gone, "row", "left").select(
        *(["row"] if row else []), "doc_id", "n_units", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
        F.coalesce(listed, F.lit("")).alias("removed"), F.coalesce("first_doc_ids", F.array().cast("array<bigint>")).alias("first_doc_ids"),
    )


def _cut(c: dict[str, list]) -> dict[str, list]:
    texts, kept = [], []
    for t, spans in zip(c["text"], c["removed"], strict=True):
        at, parts = 0, []
        for a, b in (map(int, s.split(":")) for s in (spans or "").split(",") if s):
            parts.append((at, a))
            at = b
        parts = [(a, b) for a, b in [*parts, (at, len(t or ""))] if b > a]
        texts.append(None if t is None else "".join(t[a:b] for a, b in parts))
        kept.append(",".join(f"{a}:{b}" for a, b in parts))
    return {"doc_id": c["doc_id"], "text": texts, "kept": kept}


def cut_spans(docs: DataFrame, report: DataFrame, text: str = "text", key: str = "doc_id", row: str | None = None) -> DataFrame:
    """``doc_id, text, kept``: texts without the spans of a report; ``kept`` holds original offsets as ``start:end``.

    Joined by ``row``, the column that the report was made with, or else by ids, which must then be unique.
    """
    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"), named(row or key).cast("bigint").alias("_at"))
    spans = report.select(F.col("row" if row else "doc_id").alias("_at"), "removed")
    return map_blocks(source.join(spans, "_at", "left").drop("_at"), _cut, "doc_id bigint, text string, kept string")


def remove_repeats(docs: DataFrame, unit: str = "any", min_words: int = MIN_WORDS, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, text, kept`` of every row, repeated units removed; rows are told apart by themselves, so ids may be null or repeated."""
    numbered, row = numbered_rows(docs)
    return cut_spans(numbered, dedup_report(numbered, unit, min_words, text, key, row), text, key, row)
