"""Sum-of-squares packing of tokenised documents into sequences of fixed capacity.

A piece goes where the sum, over all residual gaps, of the squared number of
open sequences with that gap becomes smallest. The pieces are dealt out by hash
into blocks of a bounded number of pieces, each packed by one task from lengths
alone. Within a block the longer pieces come first in hashed order, as the
method wants, then the short ones from long to short, which close gaps; the
sequences still open are then dissolved and their pieces placed once more.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import BLOCK_CHARS, map_batches, row_slices
from opinion_spark.llm.wordhash import BLANKS, hash_words
from opinion_spark.session import stage

CAPACITY = 2048
PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces that one task packs. A block leaves a few sequences open at its end, so larger blocks waste less.
BLOCK_PIECES = 1 << 16
#: Pieces under this part of the capacity are placed last.
SHORT_PART = 16
#: Encoded words that a Python worker keeps, some 40 bytes each, and ids of them; beyond that the half met last stays.
CACHED_WORDS = 1 << 19
CACHED_IDS = 1 << 22
#: New words that go through the tokenizer at a time, as it takes far more memory than their ids.
ENCODED_WORDS = 1 << 12

# Words that are surely one word, perhaps with signs behind it, for the tokenizer's
# own splitting: letters with at most one accent, already composed.
_PLAIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+([.,;:!?*$%&#|]*)\Z")


class WordEncoder:
    """Token ids of texts, each distinct word encoded once.

    Exact for tokenizers that never join characters across a blank and drop
    blanks, and whose last token of a word bears a mark of its own (``</w>``).
    A text that names a special token goes through the tokenizer as a whole.
    Words are told apart by 64-bit hashes, and kept with their ids in flat arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        vocab = self._tokenizer.get_vocab(with_added_tokens=True)
        self._special = [t.content.encode() for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self._ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # Sorted hashes; where in the pool each word's ids begin, how many, and when it was met last.
        self._hashes = np.empty(0, dtype=np.uint64)
        self._begin, self._size, self._met = (np.empty(0, dtype=kind) for kind in (np.int64, np.int32, np.int32))
        self._pool = np.empty(0, dtype="<u4")
        self._calls = 0

    def _whole(self, texts: Sequence[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self._tokenizer.encode_batch_fast(list(texts), add_special_tokens=False)]

    def _encode_words(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words, and where each word's begin and how many they are; no ids lie between words."""
        found = [_PLAIN.match(word) for word in words]
        plain = np.array([f is not None for f in found], dtype=bool)
        ids, begin, size = np.empty(0, dtype="<u4"), np.zeros(len(words), dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        if plain.any():
            together = np.array(self._tokenizer.encode_batch_fast([" ".join([f.string for f in found if f])], add_special_tokens=False)[0].ids, dtype="<u4")
            last = np.flatnonzero(self._ends[together]) + 1
            parts = np.cumsum([2 if f.group(1) else 1 for f in found if f])  # words that the tokenizer sees
            if len(last) == parts[-1]:
                cuts = last[parts - 1]
                ids = together[:cuts[-1]]
                size[plain] = np.diff(cuts, prepend=0)
                begin[plain] = cuts - size[plain]
            else:
                plain[:] = False
        rest = np.flatnonzero(~plain)
        if len(rest):
            others = self._whole([words[i] for i in rest.tolist()])
            size[rest] = [len(part) for part in others]
            begin[rest] = np.cumsum(size[rest]) - size[rest] + len(ids)
            ids = np.concatenate([ids, *others])
        return ids, begin, size

    def _learn(self, hashes: np.ndarray, words: Sequence[str]) -> None:
        """Add words by their sorted, unknown ``hashes``."""
        parts = [self._encode_words(words[a:a + ENCODED_WORDS]) for a in range(0, len(words), ENCODED_WORDS)]
        ids = np.concatenate([part for part, _, _ in parts])
        before = np.cumsum([0] + [len(part) for part, _, _ in parts])
        begin = np.concatenate([a + b for a, (_, b, _) in zip(before, parts, strict=False)])
        size = np.concatenate([s for _, _, s in parts])
        if len(self._hashes) + len(words) > CACHED_WORDS or len(self._pool) + len(ids) > CACHED_IDS:
            self._forget()
        at = np.searchsorted(self._hashes, hashes)
        self._begin = np.insert(self._begin, at, begin + len(self._pool))
        self._size = np.insert(self._size, at, size)
        self._met = np.insert(self._met, at, self._calls)
        self._hashes = np.insert(self._hashes, at, hashes)
        self._pool = np.concatenate([self._pool, ids])

    def _forget(self) -> None:
        """Keep the words met last, up to half of what may be kept, and those of this call, needed in any case."""
        latest = np.argsort(-self._met, kind="stable")[:CACHED_WORDS // 2]
        stay = self._met == self._calls
        stay[latest[np.cumsum(self._size[latest]) <= CACHED_IDS // 2]] = True
        # The pool holds the words' ids end to end, in the order in which the words came.
        order = np.argsort(self._begin, kind="stable")
        self._pool = self._pool[np.repeat(stay[order], self._size[order])]
        order = order[stay[order]]
        sizes = self._size[order]
        self._begin[order] = np.cumsum(sizes) - sizes
        self._hashes, self._begin, self._size, self._met = (a[stay] for a in (self._hashes, self._begin, self._size, self._met))

    def encode(self, texts: Sequence[str | bytes | None]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        ids, bounds = self.encode_block(texts)
        raw = ids.tobytes()
        return [raw[4 * a:4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode_block(self, texts: Sequence[str | bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (strings or UTF-8 bytes) end to end, and where each text's begin, with the end of the last."""
        self._calls += 1
        raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
        named_special = [i for i, t in enumerate(raw) if any(s in t for s in self._special)]
        whole = dict(zip(named_special, self._whole([raw[i].decode("utf-8", "replace") for i in named_special]), strict=True)) if named_special else {}
        words = hash_words([b"" if i in whole else t for i, t in enumerate(raw)], BLANKS, lower=False)
        hashes, first, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
        place = np.minimum(np.searchsorted(self._hashes, hashes), max(len(self._hashes) - 1, 0))
        known = self._hashes[place] == hashes if len(self._hashes) else np.zeros(len(hashes), dtype=bool)
        self._met[place[known]] = self._calls
        if not known.all():
            buffer = words.buffer.tobytes()
            new = first[~known]
            spans = zip(words.begin[new].tolist(), (words.begin[new] + words.size[new]).tolist(), strict=True)
            self._learn(hashes[~known], [buffer[a:b].decode("utf-8", "replace") for a, b in spans])
            place = np.searchsorted(self._hashes, hashes)
        size = self._size[place][inverse]
        ids = self._pool[_ranges(self._begin[place][inverse], size)]
        bounds = np.concatenate(([0], np.cumsum(size)))[words.starts]
        if whole:
            parts = [whole.get(i, ids[a:b]) for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True))]
            return np.concatenate(parts), np.cumsum([0] + [len(p) for p in parts])
        return ids, bounds


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, ``size`` many, end to end."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One per worker and vocabulary."""
    return WordEncoder(path)


def token_pieces(docs: DataFrame, tokenizer: Callable[[], str], capacity: int = CAPACITY, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece of at most ``capacity`` tokens.

    A document's tokens are its text's and then ``end_id``, so that a null or
    empty text is one token. Only documents over ``capacity`` are cut.
    ``tokenizer`` gives the vocabulary file's path and is asked where a task runs.
    """
    end = np.array([end_id], dtype="<u4").tobytes()
    arrow = to_arrow_schema(StructType.fromDDL(PIECE_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, 1, BLOCK_CHARS):
                ids, bounds = encoder(tokenizer()).encode_block(rows.column(1).to_pylist())
                # Every document has its end id, too.
                total = np.diff(bounds) + 1
                pieces = -(-total // capacity)
                owner = np.repeat(np.arange(len(total)), pieces)
                piece = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(total[owner] - start, capacity)
                raw, sums = memoryview(ids.tobytes()), []
                for a, size, last in zip((4 * (bounds[owner] + start)).tolist(), length.tolist(), (start + length == total[owner]).tolist(), strict=True):
                    sums.append(zlib.crc32(end, zlib.crc32(raw[a:a + 4 * (size - 1)])) if last else zlib.crc32(raw[a:a + 4 * size]))
                columns = [rows.column(0).take(pa.array(owner)), piece, start, length, sums]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).cast("binary").alias("text"))
    return map_batches(source, work, PIECE_SCHEMA)


class OpenSequences:
    """Sequences of one block, and how many are open with each gap."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, dtype=np.int64)
        self.members: list[list[int]] = []
        self._by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, item: int, size: int) -> None:
        """Put an item where the sum of squares grows least; among equals where the smallest gap is left."""
        top = self.capacity
        fresh = 2 * self.count[top - size] + 1 if size < top else 0
        best, gap = fresh, None
        if size < top:
            here, there = self.count[size:top], self.count[:top - size]
            change = 2 * (there - here) + 2
            change[0] -= 1  # a full sequence has no gap and counts no more
            change[here == 0] = np.iinfo(np.int64).max
            k = int(change.argmin())
            if change[k] <= best:
                best, gap = change[k], k + size
        if gap is None:
            gap, sequence = top, len(self.members)
            self.members.append([])
        else:
            sequence = self._by_gap[gap].pop()
            self.count[gap] -= 1
        self.members[sequence].append(item)
        if gap > size:
            self.count[gap - size] += 1
            self._by_gap[gap - size].append(sequence)


def pack_lengths(lengths: Sequence[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences of item numbers for items in random order, none longer than ``capacity``."""
    sizes = np.asarray(lengths, dtype=np.int64)
    short = sizes * SHORT_PART < capacity
    longest_first = np.argsort(-sizes, kind="stable")
    done: list[list[int]] = []
    order = np.concatenate([np.flatnonzero(~short), longest_first[short[longest_first]]])
    before = None
    while len(order):
        packed = OpenSequences(capacity)
        for i in order.tolist():
            packed.place(i, int(sizes[i]))
        still_open = [m for m in packed.members if sizes[m].sum() < capacity]
        done += [m for m in packed.members if sizes[m].sum() == capacity]
        if before is not None and len(packed.members) >= before:
            return done + still_open  # a further round gains nothing
        before = len(still_open)
        order = np.array([i for m in still_open for i in m], dtype=np.int64)
        order = order[np.argsort(-sizes[order], kind="stable")]
    return done


def pack(pieces: DataFrame, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece in one sequence, gapless from offset 0.

    Takes ``doc_id, piece, start, length, ids_crc32`` with lengths from 1 to
    ``capacity``; null or repeated ids are pieces like all others. They are
    written with a number for each, so that equal pieces are dealt to different
    blocks and every attempt gives the same sequences.
    """
    pieces = stage(pieces.select("doc_id", "piece", "start", "length", "ids_crc32", F.monotonically_increasing_id().alias("_row")), "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    order = F.xxhash64("doc_id", "piece", "ids_crc32", "_row")

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["_order", "_row"], ignore_index=True)
        sequence, offset = np.empty(len(block), dtype=np.int64), np.empty(len(block), dtype=np.int64)
        sizes = block["length"].to_numpy()
        for number, items in enumerate(pack_lengths(sizes, capacity)):
            sequence[items] = number
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        out = block[["doc_id", "piece", "start", "length", "ids_crc32"]].copy()
        out["sequence_id"] = (block["_block"].to_numpy(dtype=np.int64) << 40) + sequence
        out["offset"] = offset
        return out

    dealt = pieces.withColumn("_order", order).withColumn("_block", F.pmod(F.shiftright(F.col("_order"), 17), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").applyInPandas(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: Callable[[], str], capacity: int = CAPACITY, end_id: int = 0, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Tokenise, cut and pack all of ``docs``; texts are read and tokenised once. An empty table gives no sequences."""
    return pack(token_pieces(docs, tokenizer, capacity, end_id, text, key), capacity)

