"""Quality rules as a short-circuit cascade.

Every rule can reject a text. All rules must pass, so their order decides only
what a run costs: each rule's cost and rejections are measured on a bounded
sample, and the rules then run in the order of rejections per second. A text
that a rule rejects is not measured by the rules after it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property
from time import perf_counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import edit_rows, map_batches, map_blocks, row_slices
from opinion_spark.llm.wordhash import SPACED, gram_hashes, hash_words

SPACES = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
SAMPLE_ROWS = 2000
SEED = 42

# The limits of the base rules, as whole percentages.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS.encode()))
_BEGINS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


class Measured:
    """The texts of a block and what the rules measure of them, each measure computed when first asked for."""

    def __init__(self, texts: Sequence[str | None]):
        self.texts = [t or "" for t in texts]

    @cached_property
    def words(self):
        return hash_words(self.texts, SPACED, lower=False)

    @cached_property
    def n_words(self) -> np.ndarray:
        return np.diff(self.words.starts)

    def _count_bytes(self, wanted: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(wanted[self.words.buffer])))
        return np.diff(total[self.words.places])

    @cached_property
    def word_chars(self) -> np.ndarray:
        return self._count_bytes(SPACED & _BEGINS_CHARACTER)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self._count_bytes(_IS_SYMBOL)

    def dup_lines(self, i: int) -> tuple[int, int]:
        """Lines with a word that equal an earlier one, and all lines with a word."""
        lines = [line for line in self.texts[i].split("\n") if line.strip(SPACES)]
        return len(lines) - len(set(lines)), len(lines)

    def repeat_words(self, i: int) -> int:
        """Words inside a 3-word window that the text has twice or more."""
        grams = gram_hashes(self.words.of(i), 3)
        if len(grams) < 2:
            return 0
        _, group, times = np.unique(grams, return_inverse=True, return_counts=True)
        again = times[group] > 1
        covered = np.zeros(len(grams) + 2, dtype=bool)
        for k in range(3):
            covered[k:k + len(again)] |= again
        return int(covered.sum())

    def letter_words(self, i: int) -> int:
        return sum(any(map(str.isalpha, w)) for w in self.texts[i].split())

    def upper_letters(self, i: int) -> tuple[int, int]:
        """Upper-case letters and all letters."""
        text = self.texts[i]
        return sum(map(str.isupper, text)), sum(map(str.isalpha, text))


@dataclass(frozen=True)
class Rule:
    """``reject`` takes a block and row numbers and says which of those rows fail."""

    name: str
    reject: Callable[[Measured, np.ndarray], np.ndarray]


def _each(test: Callable[[Measured, int], bool]) -> Callable[[Measured, np.ndarray], np.ndarray]:
    return lambda block, rows: np.fromiter((test(block, i) for i in rows), dtype=bool, count=len(rows))


def too_few_words(least: int = MIN_WORDS) -> Rule:
    return Rule("too_few_words", lambda b, rows: b.n_words[rows] < least)


def repeated_words(percent: int = MAX_REPEAT_PERCENT) -> Rule:
    return Rule("repeated_words", _each(lambda b, i: 100 * b.repeat_words(i) > percent * int(b.n_words[i])))


def too_many_symbols(percent: int = 10) -> Rule:
    return Rule("too_many_symbols", lambda b, rows: 100 * b.n_symbols[rows] > percent * b.n_words[rows])


def word_length(least: int = 3, most: int = 10) -> Rule:
    """Mean characters of a word outside the bounds; words of other scripts than Latin may need others."""
    return Rule("word_length", lambda b, rows: (b.word_chars[rows] < least * b.n_words[rows]) | (b.word_chars[rows] > most * b.n_words[rows]))


def repeated_lines(percent: int = 50) -> Rule:
    def test(b: Measured, i: int) -> bool:
        again, lines = b.dup_lines(i)
        return 100 * again > percent * lines
    return Rule("repeated_lines", _each(test))


def few_letter_words(percent: int = 80) -> Rule:
    return Rule("few_letter_words", _each(lambda b, i: 100 * b.letter_words(i) < percent * len(b.texts[i].split())))


def mostly_upper(percent: int = 40) -> Rule:
    def test(b: Measured, i: int) -> bool:
        upper, letters = b.upper_letters(i)
        return 100 * upper > percent * letters
    return Rule("mostly_upper", _each(test))


def base_rules() -> list[Rule]:
    return [too_few_words(), repeated_words()]


def default_rules() -> list[Rule]:
    return [*base_rules(), too_many_symbols(), word_length(), repeated_lines(), few_letter_words(), mostly_upper()]


def run_cascade(block: Measured, rules: Sequence[Rule]) -> np.ndarray:
    """Which texts pass every rule; a rule sees only what the rules before it have passed."""
    rows = np.arange(len(block.texts))
    for rule in rules:
        if not len(rows):
            break
        rows = rows[~rule.reject(block, rows)]
    kept = np.zeros(len(block.texts), dtype=bool)
    kept[rows] = True
    return kept


def order_rules(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """The rules by rejections per second, as measured on about ``sample_rows`` rows drawn evenly from all.

    The order changes no verdict. Rules that reject nothing in the sample go
    last, the cheap ones first; an empty table leaves the order as given.
    """
    rules = list(rules or default_rules())
    sample = docs.select(named(text).alias("text")).sample(min(1.0, sample_rows / max(docs.count(), 1)), seed=SEED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, 0):
                texts = rows.column(0).to_pylist()
                for n, rule in enumerate(rules):
                    block = Measured(texts)
                    start = perf_counter()
                    rejected = int(rule.reject(block, np.arange(len(block.texts))).sum())
                    yield pa.RecordBatch.from_pydict({"n": [n], "s": [perf_counter() - start], "rejected": [rejected]}, schema=pa.schema([("n", pa.int32()), ("s", pa.float64()), ("rejected", pa.int64())]))

    found = map_batches(sample, measure, "n int, s double, rejected bigint").groupBy("n").agg(F.sum("s").alias("s"), F.sum("rejected").alias("rejected"))
    cost = {r.n: (-r.rejected / max(r.s, 1e-9), r.s) for r in found.collect()}  # a row for each rule
    return [rules[n] for n in sorted(range(len(rules)), key=lambda n: cost.get(n, (0.0, 0.0)))]


def filter_quality(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text") -> DataFrame:
    """The rows whose text passes every rule, with all their columns.

    A null or empty text has no words and fails ``too_few_words``. Equal rows
    get equal verdicts. ``rules`` run in the order of ``order_rules``.
    """
    ordered = order_rules(docs, rules, text)
    return edit_rows(docs, lambda texts: (None, run_cascade(Measured(texts), ordered).tolist()), text)


def quality_report(docs: DataFrame, rules: Sequence[Rule] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Base measures of every row, whether it fails the base rules, and the cascade's verdict.

    One row for each row of ``docs``, null keys and repeated rows included. A
    null text counts as empty: all measures 0, failed, not kept. ``kept`` is
    false where ``base_failed``; the other rules run on the rest only.
    """
    base = {r.name for r in base_rules()}
    rest = [r for r in order_rules(docs, rules, text) if r.name not in base]

    def run(c: dict[str, list]) -> dict[str, list]:
        block = Measured(c["text"])
        n_words, rows = block.n_words, np.arange(len(block.texts))
        repeat = np.fromiter((block.repeat_words(i) for i in rows), dtype=np.int64, count=len(rows))
        failed = (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
        left = rows[~failed]
        for rule in rest:
            left = left[~rule.reject(block, left)]
        kept = np.zeros(len(rows), dtype=bool)
        kept[left] = True
        return {
            "doc_id": c["doc_id"], "n_words": n_words, "word_chars": block.word_chars, "n_symbols": block.n_symbols,
            "n_dup_lines": [block.dup_lines(i)[0] for i in rows], "n_repeat_words": repeat, "base_failed": failed, "kept": kept,
        }

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return map_blocks(source, run, "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean")
