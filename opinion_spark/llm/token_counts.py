"""Counts of greedy word pieces by a linear longest-match automaton.

The vocabulary is a trie. A state that cannot go on with the next character
follows its failure link, whose number of popped pieces was computed when the
trie was built: the pieces that longest-match-first would have cut off by then.
A word is read once, character by character, and no piece is ever built.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import map_blocks
from opinion_spark.llm.wordhash import SPACED, hash_words

# Fixed value: the mark that begins a word in the vocabulary.
WORD_MARK = "▁"
#: Counts that a worker keeps for the words it has met.
CACHED_WORDS = 500_000


class PieceCounter:
    """Number of pieces that longest-match-first cuts a word into.

    A character of no piece counts as its UTF-8 bytes, as does one that begins
    pieces but is none by itself and is not taken by a longer one.
    """

    def __init__(self, pieces: Iterable[str]):
        self._next: list[dict[str, int]] = [{}]
        weight = [0]  # pieces of a node that is one
        for piece in pieces:
            node = 0
            for c in piece:
                node = self._next[node].setdefault(c, len(self._next))
                if node == len(self._next):
                    self._next.append({})
                    weight.append(0)
            weight[node] = 1
        for c, node in self._next[0].items():
            weight[node] = weight[node] or len(c.encode("utf-8", "replace"))
        self._fail, self._popped = [0] * len(weight), [0] * len(weight)
        queue = deque([0])
        while queue:
            node = queue.popleft()
            for c, child in self._next[node].items():
                if weight[child]:
                    # The node's own text is a piece: it is popped whole.
                    self._popped[child] = weight[child]
                else:
                    back, popped = self._fail[node], self._popped[node]
                    while c not in self._next[back] and back:
                        popped += self._popped[back]
                        back = self._fail[back]
                    if c in self._next[back]:
                        self._fail[child], self._popped[child] = self._next[back][c], popped
                    else:
                        self._fail[child], self._popped[child] = 0, popped + len(c.encode("utf-8", "replace"))
                queue.append(child)

    def count(self, word: str) -> int:
        node = total = 0
        for c in word:
            while c not in self._next[node] and node:
                total += self._popped[node]
                node = self._fail[node]
            if c in self._next[node]:
                node = self._next[node][c]
            else:
                total += len(c.encode("utf-8", "replace"))
        while node:
            total += self._popped[node]
            node = self._fail[node]
        return total


class WordCounts:
    """Piece counts of words by their hashes, each distinct word counted once."""

    def __init__(self, pieces: Iterable[str]):
        self._counter = PieceCounter(pieces)
        self._known: dict[int, int] = {}

    def totals(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text."""
        words = hash_words(texts, SPACED, lower=False)
        hashes, first, place = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self._known) + len(hashes) > CACHED_WORDS:
            self._known = {}
        known, counts = self._known, np.empty(len(hashes), dtype=np.int64)
        for n, (h, i) in enumerate(zip(hashes.tolist(), first.tolist(), strict=True)):
            count = known.get(h)
            if count is None:
                word = words.buffer[words.begin[i]:words.begin[i] + words.size[i]].tobytes().decode()
                count = known[h] = self._counter.count(WORD_MARK + word)
            counts[n] = count
        running = np.concatenate(([0], np.cumsum(counts[place])))
        return np.diff(words.starts), np.diff(running[words.starts])


@lru_cache(maxsize=2)
def word_counts(path: str) -> WordCounts:
    """One per worker and vocabulary, a SentencePiece model file; its control and byte pieces are no text."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return WordCounts(model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))


def count_tokens(docs: DataFrame, vocabulary: Callable[[], str], text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row: words between ASCII white space, and their pieces.

    A null or empty text has none of either. Null and repeated ids are rows like
    all others. ``vocabulary`` gives the model file's path where a task runs.
    """
    def run(c: dict[str, list]) -> dict[str, list]:
        n_words, n_tokens = word_counts(vocabulary()).totals(c["text"])
        return {"doc_id": c["doc_id"], "n_words": n_words, "n_tokens": n_tokens}

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return map_blocks(source, run, "doc_id bigint, n_words bigint, n_tokens bigint")
