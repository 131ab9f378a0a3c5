"""Counts of words and n-grams within a task, before they are shuffled.

Spark splits the texts and adds up the counts. Between the two, each task counts
the word lists of a block of rows on word numbers, so that what reaches Spark's
aggregation is a row per distinct n-gram of a block, not one per occurrence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from opinion_spark.session import reach_workers

#: Words that are counted at a time, or one row: bounds the memory of a task.
BLOCK_WORDS = 1 << 20


def count_grams(df: DataFrame, tokens: str, sizes: tuple[int, int], block_words: int = BLOCK_WORDS) -> DataFrame:
    """``term, df, total_tf`` of all runs of ``sizes[0]`` to ``sizes[1]`` words, joined by a space, a row per block of rows.

    ``tokens`` is a column of word lists without NULL words.
    """
    low, high = sizes
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range {sizes}")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, codes, rows in word_blocks(batches, block_words):
            grams, texts = codes, words
            for n in range(1, high + 1):
                if n > 1:
                    # A gram of n words is one of n - 1 and the word after it, in the same row.
                    inside = rows[: max(len(rows) - n + 1, 0)] == rows[n - 1 :]
                    keys = (grams[: len(grams) - 1] * len(words) + codes[n - 1 :])[inside]
                    found, places = np.unique(keys, return_inverse=True)
                    texts = pc.binary_join_element_wise(texts.take(pa.array(found // len(words))), words.take(pa.array(found % len(words))), " ")
                    # Places that begin no gram of n words begin no longer one.
                    grams = np.zeros(len(inside), dtype=np.int64)
                    grams[inside] = places
                    used, owners = grams[inside], rows[: len(inside)][inside]
                else:
                    used, owners = grams, rows
                if n >= low and len(used):
                    total = np.bincount(used)
                    # A gram's rows: each pair of gram and row once.
                    pairs, _ = _distinct(used * (int(rows[-1]) + 1) + owners)
                    held = np.bincount(pairs // (int(rows[-1]) + 1))
                    yield from _found({"term": texts, "df": held, "total_tf": total})

    return _mapped(df, tokens, work, "term string, df bigint, total_tf bigint")


def count_successors(df: DataFrame, words: str, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``first, second, n``: words by the word after them (NULL at the end of a list), a row per block of rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, codes, rows in word_blocks(batches, block_words):
            none = len(known)
            after = np.full(len(codes), none, dtype=np.int64)
            same = rows[:-1] == rows[1:]
            after[:-1][same] = codes[1:][same]
            found, n = _distinct(codes * (none + 1) + after)
            second = found % (none + 1)
            yield from _found({
                "first": known.take(pa.array(found // (none + 1))),
                "second": known.take(pa.array(second, mask=second == none)), "n": n,
            })

    return _mapped(df, words, work, "first string, second string, n bigint")


def word_blocks(batches: Iterator[pa.RecordBatch], block_words: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Per block of rows: its distinct words, and for each word of its lists the number among them and the row."""
    for batch in batches:
        lists = batch.column(0)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))
        start = 0
        while start < len(ends):
            before = int(ends[start - 1]) if start else 0
            end = max(int(np.searchsorted(ends, before + block_words, side="right")), start + 1)
            part = lists.slice(start, end - start)
            coded = part.flatten().dictionary_encode()
            if len(coded):
                sizes = np.diff(ends[start:end], prepend=before)
                yield coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.repeat(np.arange(len(sizes), dtype=np.int64), sizes)
            start = end


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys and how often each occurs; sorting is faster here than numpy's hashing."""
    keys = np.sort(keys)
    starts = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), dtype=bool), keys[1:] != keys[:-1])))
    return keys[starts], np.diff(starts, append=len(keys))


def _found(columns: dict, rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    made = pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=pa.int64()) for c in columns.values()], names=list(columns))
    for start in range(0, made.num_rows, rows):
        yield made.slice(start, rows)


def _mapped(df: DataFrame, column: str, work, schema: str) -> DataFrame:
    reach_workers(df.sparkSession)
    return df.select(column).mapInArrow(work, schema)
