"""Scores by a probabilistic suffix tree over words.

The tree's nodes are contexts of up to two words. A context stays in the tree if
a divergence test finds that the next words after it differ from those after its
shorter context: its training occurrences, each left out once, must be likelier
under the context than under its parent. A node's next-word distribution is its
counts smoothed by its parent's, the root's is the add-one unigram distribution,
and a word is scored in the state of the longest context that stayed.

Texts are turned once into blocks of word codes. Counts and test sums over all
texts come from rounds of the same exchange: every block sends its distinct keys
with its own sums, cut by key range; a range is added up by one task, which
answers every block with the totals of that block's keys. A frequent key is one
entry per block, so no range is hot, and no count is ever held in one place.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.wordhash import SPACED, hash_words, mix, text_blocks
from opinion_spark.session import stage

#: Characters of text in a block of codes.
BLOCK_CHARS = 1 << 23
#: Training occurrences a context needs, and the sum of the test, in nats, it must exceed.
MIN_COUNT, MIN_GAIN = 2, 1.0
#: Weight of the parent's distribution against the counts of a context, in occurrences, by context length.
SMOOTHING = (0.0, 1.0, 0.5)

# Hashes of the end of a text and of the place before its first word.
_END, _BEGIN = np.uint64(0x6C6C6D5F656E6421), np.uint64(0x6C6C6D5F62656769)
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
# Keys of n-grams are cut to 48 bits: rare collisions merge counts of contexts, never those of words.
_CUT = np.uint64(16)
WORDS, PAIRS, TRIPLES, FIRST_GAIN, SECOND_GAIN = range(5)
_BITS = {WORDS: 64, PAIRS: 48, TRIPLES: 48, FIRST_GAIN: 48, SECOND_GAIN: 48}

BLOCK_SCHEMA = "block bigint, doc_id array<bigint>, n_tokens array<int>, held array<boolean>, vocabulary binary, codes binary"
REQUEST_SCHEMA = "block bigint, space int, part int, n int, keys binary, sums binary"
ANSWER_SCHEMA = "block bigint, space int, part int, sums binary, distinct bigint, total bigint"
SCORE_SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def _press(values: np.ndarray) -> bytes:
    """Bytes of an array, those of equal significance together, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpress(raw: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, -1).T).view(kind).reshape(-1)


def held_out(doc_id: int | None) -> bool:
    """The fold that is not learnt from: crc32 of the id as text, modulo 7, is 2. A null id counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def encode_blocks(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Documents as codes of their block's words; every text ends with a token of its own."""
    arrow = to_arrow_schema(StructType.fromDDL(BLOCK_SCHEMA))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        ids: list[int | None] = []
        parts: list[np.ndarray] = []
        sizes: list[int] = []
        chars = 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            known, code, times = np.unique(tokens, return_inverse=True, return_counts=True)
            frequent = np.argsort(-times, kind="stable")
            rank = np.empty(len(known), dtype="<u4")
            rank[frequent] = np.arange(len(known))
            row = {
                "block": [(TaskContext.get().partitionId() << 32) + made], "doc_id": [ids], "n_tokens": [sizes], "held": [[held_out(i) for i in ids]],
                "vocabulary": [known[frequent].astype("<u8").tobytes()], "codes": [_press(rank[code])],
            }
            return pa.RecordBatch.from_pydict(row, schema=arrow)

        for batch in batches:
            batch_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for some in text_blocks(texts):
                words = hash_words(texts[some], SPACED)
                ends = words.starts[1:]
                parts.append(np.insert(words.hashes, ends, _END))
                sizes += (np.diff(words.starts) + 1).tolist()
                ids += batch_ids[some]
                chars += sum(len(t or "") for t in texts[some])
                if chars >= block_chars:
                    yield block()
                    made += 1
                    ids, parts, sizes, chars = [], [], [], 0
        if ids:
            yield block()

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return source.mapInArrow(work, BLOCK_SCHEMA)


@dataclass(frozen=True)
class Exchange:
    """Totals over all blocks; ``part_bits`` cuts each key space into ranges."""

    part_bits: int

    def requests(self, block: int, space: int, keys: np.ndarray, sums: np.ndarray) -> Iterator[dict]:
        """Rows for sorted distinct ``keys``; sums are counts, or for the tests floats."""
        edges = np.searchsorted(keys >> np.uint64(_BITS[space] - self.part_bits), np.arange((1 << self.part_bits) + 1, dtype=np.uint64))
        kind = "<f4" if space >= FIRST_GAIN else "<u4"
        for part, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            if b > a:
                yield {
                    "block": block, "space": space, "part": part, "n": b - a,
                    "keys": _press(np.diff(keys[a:b], prepend=np.uint64(0)).astype("<u8")), "sums": _press(sums[a:b].astype(kind)),
                }

    @staticmethod
    def totals(requests: DataFrame) -> DataFrame:
        """The answers to all blocks, written; rows of block -1 say how many keys have a sum, and the sum of all."""
        def add(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("block", ignore_index=True)  # floats are added in one order
            space, part = int(rows["space"].iloc[0]), int(rows["part"].iloc[0])
            counted = space < FIRST_GAIN
            keys = np.concatenate([np.cumsum(_unpress(k, "<u8"), dtype=np.uint64) for k in rows["keys"]])
            sums = np.concatenate([_unpress(s, "<u4" if counted else "<f4").astype(np.float64) for s in rows["sums"]])
            _, place = np.unique(keys, return_inverse=True)
            total = np.bincount(place, weights=sums)
            # The blocks need of a test only whether it is passed.
            answer = total[place].astype("<u4") if counted else (total[place] > MIN_GAIN).astype("u1")
            ends = np.cumsum(rows["n"].to_numpy())
            pieces = [_press(answer[e - n:e]) for e, n in zip(ends.tolist(), rows["n"].tolist(), strict=True)]
            out = pd.DataFrame({"block": rows["block"], "space": space, "part": part, "sums": pieces, "distinct": 0, "total": 0})
            out.loc[len(out)] = [-1, space, part, b"", int((total > 0).sum()), int(total.sum()) if counted else 0]
            return out

        return stage(requests.groupBy("space", "part").applyInPandas(add, ANSWER_SCHEMA), "lm-totals")


class Block:
    """Tokens of a block with all that the answers so far say about them."""

    def __init__(self, row: pd.Series, answers: pd.DataFrame):
        self.number = int(row["block"])
        self.doc_id = list(row["doc_id"])
        self.n_tokens = np.asarray(row["n_tokens"], dtype=np.int64)
        self.held = np.asarray(row["held"], dtype=bool)
        self.vocabulary = np.frombuffer(row["vocabulary"], dtype="<u8")
        self.codes = _unpress(row["codes"], "<u4").astype(np.int64)
        self.first = np.cumsum(self.n_tokens) - self.n_tokens
        self.train = ~np.repeat(self.held, self.n_tokens)
        words = self.vocabulary[self.codes]
        begin = np.zeros(len(words), dtype=bool)
        begin[self.first] = True
        self.begin = begin
        before = np.roll(words, 1)
        before[begin] = _BEGIN
        self.pairs = mix(before * _GOLDEN + words) >> _CUT
        self.context = np.roll(self.pairs, 1)  # the two words before; none before the second word
        self.triples = mix((self.context + np.uint64(7)) * _GOLDEN + words) >> _CUT
        self._answers = answers.sort_values("part")

    def answer(self, space: int, kind: str = "<u4") -> np.ndarray:
        """Totals of this block's sorted distinct keys of a space."""
        rows = self._answers[self._answers["space"] == space]
        return np.concatenate([_unpress(s, kind) for s in rows["sums"]]) if len(rows) else np.empty(0, dtype=kind)

    def count_words(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        own = np.bincount(self.codes[self.train], minlength=len(self.vocabulary))
        order = np.argsort(self.vocabulary)
        yield WORDS, self.vocabulary[order], own[order]
        keys, place = np.unique(self.pairs, return_inverse=True)
        yield PAIRS, keys, np.bincount(place[self.train], minlength=len(keys))

    def use_counts(self, n_train: int, n_distinct: int, n_texts: int) -> None:
        """Probabilities at the root and after one word."""
        counts = np.empty(len(self.vocabulary), dtype=np.int64)
        counts[np.argsort(self.vocabulary)] = self.answer(WORDS)
        self.count = counts[self.codes]
        self.base = np.log10((self.count + 1) / (n_train + n_distinct + 1))
        self.p0 = (self.count + 1.0) / (n_train + n_distinct + 1)
        self.context1 = np.roll(self.count, 1)
        self.context1[self.begin] = n_texts
        _, place = np.unique(self.pairs, return_inverse=True)
        self.pair = self.answer(PAIRS)[place].astype(np.int64)
        self.p1 = (self.pair + SMOOTHING[1] * self.p0) / (self.context1 + SMOOTHING[1])
        self.deep = np.roll(self.pair, 1)
        self.deep[self.begin] = 0
        self.wide = np.flatnonzero(self.deep >= MIN_COUNT)  # tokens with a context of two words to look at
        # One-word contexts, the beginning of a text as the last of them.
        self.code1 = np.roll(self.codes, 1)
        self.code1[self.begin] = len(self.vocabulary)
        hashes = np.append(self.vocabulary, _BEGIN) >> _CUT
        self.keys1, self.place1 = np.unique(hashes, return_inverse=True)

    def _gain(self, tokens: np.ndarray, joint: np.ndarray, context: np.ndarray, parent: np.ndarray, weight: float) -> np.ndarray:
        """What the context gains on its parent at each training token, that token left out of the context's counts."""
        left_out = (joint[tokens] - 1 + weight * parent[tokens]) / (context[tokens] - 1 + weight)
        return np.log(left_out / parent[tokens])

    def test_words(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        tokens = np.flatnonzero(self.train & (self.context1 >= MIN_COUNT))
        gain = self._gain(tokens, self.pair, self.context1, self.p0, SMOOTHING[1])
        yield FIRST_GAIN, self.keys1, np.bincount(self.place1[self.code1[tokens]], weights=gain, minlength=len(self.keys1))
        keys, place = np.unique(self.triples[self.wide], return_inverse=True)
        yield TRIPLES, keys, np.bincount(place[self.train[self.wide]], minlength=len(keys))

    def use_words_test(self) -> None:
        stays = self.answer(FIRST_GAIN, "u1").astype(bool)[self.place1[self.code1]] & (self.context1 >= MIN_COUNT)
        self.p = np.where(stays, self.p1, self.p0)
        self.joint = np.zeros(len(self.codes), dtype=np.int64)
        _, place = np.unique(self.triples[self.wide], return_inverse=True)
        self.joint[self.wide] = self.answer(TRIPLES)[place] if len(self.wide) else 0

    def test_pairs(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        tokens = self.wide[self.train[self.wide]]
        keys, place = np.unique(self.context[self.wide], return_inverse=True)
        gain = np.zeros(len(self.wide))
        gain[self.train[self.wide]] = self._gain(tokens, self.joint, self.deep, self.p, SMOOTHING[2])
        yield SECOND_GAIN, keys, np.bincount(place, weights=gain, minlength=len(keys))

    def use_pairs_test(self) -> None:
        if len(self.wide):
            _, place = np.unique(self.context[self.wide], return_inverse=True)
            stays = self.wide[self.answer(SECOND_GAIN, "u1").astype(bool)[place]]
            self.p[stays] = (self.joint[stays] + SMOOTHING[2] * self.p[stays]) / (self.deep[stays] + SMOOTHING[2])

    def scores(self, n_train: int) -> pd.DataFrame:
        return pd.DataFrame({
            "doc_id": pd.array(self.doc_id, dtype="Int64"), "held_out": self.held, "n_tokens": self.n_tokens,
            "n_known": np.add.reduceat((self.count > 0).astype(np.int64), self.first), "train_tokens": n_train,
            "base_score": np.add.reduceat(self.base, self.first), "score": np.add.reduceat(np.log10(self.p), self.first),
        })


def score_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    The tree is learnt from the rows outside the held-out fold and scores all.
    ``score`` is the model's log10 probability of the text with its end,
    ``base_score`` the add-one unigram model's. A null or empty text is its end
    alone; a null id is in training; repeated rows count each time. With nothing
    to learn from, every token has the probability of an unknown one.
    """
    n_blocks_hint = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = encode_blocks(docs, text, key, block_chars).repartition(n_blocks_hint, "block").persist(StorageLevel.DISK_ONLY)
    exchange = Exchange(part_bits=min(16, max(3, math.ceil(math.log2(max(blocks.count(), 1))) + 1)))

    def ask(answers: DataFrame | None, run: Callable[[Block], Iterator[tuple[int, np.ndarray, np.ndarray]]]) -> DataFrame:
        def rows(block: pd.Series, answered: pd.DataFrame) -> pd.DataFrame:
            state = Block(block, answered)
            return pd.DataFrame([r for space, keys, sums in run(state) for r in exchange.requests(state.number, space, keys, sums)])

        if answers is None:
            nothing = pd.DataFrame({"space": [], "part": [], "sums": []})
            return blocks.groupBy("block").applyInPandas(lambda own: rows(own.iloc[0], nothing), REQUEST_SCHEMA)
        return _with(answers, rows, REQUEST_SCHEMA)

    def _with(answers: DataFrame, rows: Callable[[pd.Series, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
        slim = answers.filter("block >= 0").select("block", "space", "part", "sums")
        return blocks.groupBy("block").cogroup(slim.groupBy("block")).applyInPandas(lambda own, answered: rows(own.iloc[0], answered), schema)

    counted = exchange.totals(ask(None, Block.count_words))
    n_distinct, n_train = (x or 0 for x in counted.filter(f"block < 0 and space = {WORDS}").agg(F.sum("distinct"), F.sum("total")).first())
    n_texts = blocks.select(F.explode("held").alias("held")).filter("not held").count()

    def first_tests(state: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        state.use_counts(n_train, n_distinct, n_texts)
        return state.test_words()

    first = exchange.totals(ask(counted, first_tests))

    def second_tests(state: Block) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        state.use_counts(n_train, n_distinct, n_texts)
        state.use_words_test()
        return state.test_pairs()

    second = exchange.totals(ask(counted.unionByName(first), second_tests))

    def final(block: pd.Series, answered: pd.DataFrame) -> pd.DataFrame:
        state = Block(block, answered)
        state.use_counts(n_train, n_distinct, n_texts)
        state.use_words_test()
        state.use_pairs_test()
        return state.scores(n_train)

    scored = stage(_with(counted.unionByName(first).unionByName(second), final, SCORE_SCHEMA), "lm-scores")
    blocks.unpersist()
    return scored
