"""Ranked lexical search: the documents that score highest for each item, by exact matrix products.

1. The items' words make a vocabulary, in blocks of items of a bounded number of
   words. Documents are read once a block and kept as (vocabulary code, times)
   lists with their lengths.
2. Document frequencies and corpus totals are counted over all documents.
3. Items go in tiles of few terms, documents in tiles of few rows. The weights of
   an item tile times the impacts of a document tile is a dense product in
   float64. All numbers are whole, and the terms of a tile are cut so that no
   partial sum can reach 2^53: products are exact in any order of summation.
4. Each task keeps the best documents of every item over its tiles, equal scores
   by id; those of all tasks are ranked at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import BLOCK_CHARS, map_blocks, row_slices
from opinion_spark.llm.wordhash import ALPHANUMERIC, hash_words
from opinion_spark.session import stage

TOP = 10
B_PERCENT = 75
K1_TENTHS = 8
#: Words of items that are worked on at a time; bounds the vocabulary that is broadcast.
BLOCK_WORDS = 1 << 18
#: A product has at most this many items, terms and documents: 16 MB of impacts and 2 MB of weights.
TILE_ITEMS, TILE_TERMS, TILE_DOCS = 64, 4096, 512
#: No impact reaches this.
IMPACT_LIMIT = 1_000_000
EXACT = 1 << 53

DOCUMENT_SCHEMA = "doc_id bigint, n bigint, codes binary, times binary"
RESULT_SCHEMA = "item_row bigint, item_id bigint, doc_id bigint, score bigint"


def _lists(raw: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column of 4-byte numbers, row i from ``bounds[i]`` to ``bounds[i + 1]``."""
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((4 * bounds).astype(np.int32)), pa.py_buffer(raw.astype("<u4"))])


def _unlisted(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of such a column without gaps, and the bounds of its rows."""
    bounds = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype="<u4", offset=int(bounds[0]), count=int(bounds[-1] - bounds[0]) // 4) if data is not None and bounds[-1] > bounds[0] else np.empty(0, dtype="<u4")
    return raw, (bounds - bounds[0]) // 4


def item_words(items: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """``item_row, item_id, n, terms`` of every item with words, written; rows are items whatever their ids."""
    def run(c: dict[str, list]) -> dict[str, list]:
        words = hash_words(c["text"], ALPHANUMERIC)
        own = [words.of(i) for i in range(len(words))]
        return {"item_row": c["item_row"], "item_id": c["item_id"], "n": [len(w) for w in own], "terms": [w.tobytes() for w in own]}

    source = items.select(F.monotonically_increasing_id().alias("item_row"), named(key).cast("bigint").alias("item_id"), named(text).alias("text"))
    return stage(map_blocks(source, run, "item_row bigint, item_id bigint, n bigint, terms binary").filter("n > 0"), "item-words")


def document_terms(docs: DataFrame, vocabulary: np.ndarray, text: str, key: str) -> DataFrame:
    """Per document its number of terms, and which of the sorted ``vocabulary`` it has how often; written."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    arrow = to_arrow_schema(StructType.fromDDL(DOCUMENT_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            for rows in row_slices(batch, 1, BLOCK_CHARS):
                words = hash_words(rows.column(1).to_pylist(), ALPHANUMERIC)
                code = np.minimum(np.searchsorted(known, words.hashes), len(known) - 1)
                found = known[code] == words.hashes
                owner = np.repeat(np.arange(len(words)), np.diff(words.starts))
                pairs, times = np.unique(owner[found] * len(known) + code[found], return_counts=True)
                bounds = np.searchsorted(pairs, np.arange(len(words) + 1) * len(known))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.diff(words.starts)), _lists(pairs % len(known), bounds), _lists(times, bounds)], schema=arrow,
                )

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).cast("binary").alias("text"))
    made = stage(source.mapInArrow(work, DOCUMENT_SCHEMA), "document-terms")
    sent.unpersist()
    return made


def document_frequencies(listed: DataFrame, terms: int) -> np.ndarray:
    """In how many documents each vocabulary code occurs."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, dtype=np.int64)
        for batch in batches:
            total += np.bincount(_unlisted(batch.column(0))[0], minlength=terms)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["code", "df"])

    out = np.zeros(terms, dtype=np.int64)
    # At most a row for each term of the block.
    for code, df in listed.select("codes").mapInArrow(count, "code bigint, df bigint").groupBy("code").agg(F.sum("df").alias("df")).collect():
        out[code] = df
    return out


@dataclass(frozen=True)
class Product:
    """Terms of an item tile whose weighted impacts sum exactly: entries are (term of ``codes``, item of the tile, weight)."""

    codes: np.ndarray
    term: np.ndarray
    item: np.ndarray
    weight: np.ndarray


def exact_products(items: Sequence[dict[int, int]], weights: np.ndarray, max_terms: int = TILE_TERMS, limit: int = EXACT) -> list[Product]:
    """The (code -> times) of a tile's items as products of at most ``max_terms`` terms, in none of which an item's sum can reach ``limit``."""
    most = (limit - 1) // IMPACT_LIMIT
    columns: list[tuple[int, list[tuple[int, int]]]] = []
    by_code: dict[int, list[tuple[int, int]]] = {}
    for i, own in enumerate(items):
        for code, times in own.items():
            if weights[code]:
                by_code.setdefault(code, []).append((i, times * int(weights[code])))
    for code in sorted(by_code):
        entries = by_code[code]
        while entries:  # a weight over the limit is added in several products
            columns.append((code, [(i, min(w, most)) for i, w in entries]))
            entries = [(i, w - most) for i, w in entries if w > most]
    out: list[Product] = []
    part: list[tuple[int, list[tuple[int, int]]]] = []
    sums = [0] * len(items)

    def close() -> None:
        if part:
            flat = [(t, i, w) for t, (_, entries) in enumerate(part) for i, w in entries]
            term, item, weight = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True))
            out.append(Product(np.array([code for code, _ in part], dtype=np.int64), term, item, weight.astype(np.float64)))
            part.clear()

    for code, entries in columns:
        if len(part) == max_terms or any(sums[i] + w > most for i, w in entries) or (part and part[-1][0] == code):
            close()
            sums = [0] * len(items)
        part.append((code, entries))
        for i, w in entries:
            sums[i] += w
    close()
    return out


@dataclass(frozen=True)
class ItemTile:
    first: int  # number of its first item in the block
    size: int
    products: list[Product]


def item_tiles(items: Sequence[dict[int, int]], weights: np.ndarray) -> list[ItemTile]:
    """Consecutive items in tiles of few items and, but for one item of very many, few terms."""
    tiles: list[ItemTile] = []
    start, terms = 0, set()
    for i, own in enumerate(items):
        if i > start and (i - start == TILE_ITEMS or len(terms | own.keys()) > TILE_TERMS):
            tiles.append(ItemTile(start, i - start, exact_products(items[start:i], weights)))
            start, terms = i, set()
        terms |= own.keys()
    if len(items) > start:
        tiles.append(ItemTile(start, len(items) - start, exact_products(items[start:], weights)))
    return tiles


class Best:
    """The best documents of every item so far: by score, equal scores by id, null ids last."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.found = [np.empty((3, 0), dtype=np.int64)] * items  # scores, null marks, ids
        self.least = np.ones(items, dtype=np.int64)  # scores that still matter

    def add(self, first: int, scores: np.ndarray, missing: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the documents (columns) for items from ``first`` on (rows). All that tie with the last place are kept until ids decide."""
        good = scores >= self.least[first:first + len(scores), None]
        for row in np.flatnonzero(good.any(axis=1)).tolist():
            place = np.flatnonzero(good[row])
            new = np.stack([scores[row, place], missing[place], ids[place]])
            if len(place) > self.top:
                new = new[:, new[0] >= np.partition(new[0], -self.top)[-self.top]]
            merged = np.concatenate([self.found[first + row], new], axis=1)
            merged = merged[:, np.lexsort((merged[2], merged[1], -merged[0]))[:self.top]]
            self.found[first + row] = merged
            if merged.shape[1] == self.top:
                self.least[first + row] = merged[0, -1]


def tile_scores(tile: ItemTile, vocabulary: int, docs: int, owner: np.ndarray, codes: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Scores of a document tile (columns) for an item tile (rows), as whole numbers."""
    total = np.zeros((tile.size, docs), dtype=np.int64)
    for product in tile.products:
        place = np.full(vocabulary, -1, dtype=np.int64)
        place[product.codes] = np.arange(len(product.codes))
        column = place[codes]
        used = column >= 0
        dense = np.zeros((len(product.codes), docs))
        dense[column[used], owner[used]] = impacts[used]
        weights = np.zeros((tile.size, len(product.codes)))
        weights[product.item, product.term] = product.weight
        total += (weights @ dense).astype(np.int64)
    return total


def _search_block(listed: DataFrame, items: list, top: int, b_percent: int, k1_tenths: int, vocabulary: np.ndarray, counted: tuple[int, int]) -> DataFrame:
    documents, words = counted
    frequency = document_frequencies(listed, len(vocabulary))
    weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1))) for df in frequency.tolist()], dtype=np.int64)
    own = []
    for row in items:
        code, times = np.unique(np.searchsorted(vocabulary, np.frombuffer(row.terms, dtype="<u8")), return_counts=True)
        own.append({c: t for c, t in zip(code.tolist(), times.tolist(), strict=True) if frequency[c]})
    sent = listed.sparkSession.sparkContext.broadcast((item_tiles(own, weights), [(r.item_row, r.item_id) for r in items]))
    size = len(vocabulary)
    arrow = to_arrow_schema(StructType.fromDDL(RESULT_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles, names = sent.value
        best = Best(len(names), top)
        for batch in batches:
            for at in range(0, batch.num_rows, TILE_DOCS):
                rows = batch.slice(at, TILE_DOCS)
                codes, bounds = _unlisted(rows.column(2))
                tf = _unlisted(rows.column(3))[0].astype(np.int64)
                ids = rows.column(0)
                missing = np.asarray(ids.is_null()).astype(np.int64)
                ids = np.asarray(ids.fill_null(0))
                # Python's whole numbers: a long text in a large corpus passes 64 bits here.
                m = np.array([100 - b_percent + b_percent * n * documents // words for n in rows.column(1).to_pylist()], dtype=np.int64)
                owner = np.repeat(np.arange(len(m)), np.diff(bounds))
                impacts = 1_000_000_000 * tf // (1000 * tf + k1_tenths * m[owner])
                for tile in tiles:
                    best.add(tile.first, tile_scores(tile, size, len(m), owner, codes, impacts), missing, ids)
        out = [(*name, None if gone else doc, score) for name, found in zip(names, best.found, strict=True) for score, gone, doc in found.T.tolist()]
        columns = list(zip(*out, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return listed.mapInArrow(work, RESULT_SCHEMA)


def ranked_search(
    docs: DataFrame, items: DataFrame, top: int = TOP, b_percent: int = B_PERCENT, k1_tenths: int = K1_TENTHS,
    text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``item_id, rank, doc_id, score`` of the ``top`` documents with a score above 0 for each row of ``items``.

    Terms are runs of letters and digits, A-Z lower-cased; a null or empty text
    has none, an item without terms no rows. With N documents that have terms and
    L terms in all, a term of df documents weighs w = floor(1000 ln((2N+2)/(2df+1))),
    a document of n terms has m = 100 - b + (b n N) div L, and a score sums
    w ((10^9 tf) div (1000 tf + k1 m)) over the item's terms with repeats, ``b``
    in percent and ``k1`` in tenths of a percent. Equal scores are ranked by
    ascending id, null ids last; repeated ids are documents, or items, of their
    own. Terms are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    queries = item_words(items, item_text, item_key)
    blocks = -(-(queries.agg(F.sum("n")).first()[0] or 0) // block_words)
    found = spark.createDataFrame([], RESULT_SCHEMA)
    for number in range(blocks):
        # About ``block_words`` words, as rows are dealt by hash.
        rows = queries.filter(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == number).collect()
        if not rows:
            continue
        vocabulary = np.unique(np.frombuffer(b"".join(r.terms for r in rows), dtype="<u8"))
        listed = document_terms(docs, vocabulary, text, key)
        counted = listed.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
        if counted[1]:
            found = found.unionByName(stage(_search_block(listed, rows, top, b_percent, k1_tenths, vocabulary, tuple(counted)), "best-documents"))
    place = Window.partitionBy("item_row", "item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")
