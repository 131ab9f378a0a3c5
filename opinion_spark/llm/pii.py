"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust their scores.

The four base kinds (email, ip, card, phone) are kept whenever their own rule
holds. The further kinds start from a prior score; a checksum or a word of the
kind's context close by raises it, and spans at or above ``threshold`` stay.
Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import edit_rows, map_blocks

Span = tuple[int, int, str]

#: Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")

# The base patterns.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin where a run of digits begins, as every pattern takes runs whole.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    """The mod-10 checksum of payment cards."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(text: str) -> bool:
    """The checksum of international bank account numbers (letters count from 10)."""
    moved = text[4:] + text[:4]
    return moved.isalnum() and moved.isascii() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, @ and domain.

    Found from each @ backwards, as trying every start would take time
    quadratic in the length of a run without @.
    """
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
            yield m.span()


_BASE: tuple[tuple[str, Callable[[str], Iterator[tuple[int, int]]]], ...] = (("email", _emails), ("ip", _ips), ("card", _cards), ("phone", _phones))


def base_spans(text: str | None) -> list[Span]:
    """Spans of the base kinds, by start and then kind in order."""
    if not text:
        return []
    found = [(start, rank, end, kind) for rank, (kind, find) in enumerate(_BASE) for start, end in find(text)]
    return [(start, end, kind) for start, _, end, kind in sorted(found)]


@dataclass(frozen=True)
class Recognizer:
    """A further kind: its pattern, checksum, context words and scores.

    ``confirm`` set: a span that fails it is dropped. ``by_groups``: not before
    it has failed at the end of each of its groups, too, longest first.
    ``group``: the part of the match that is the span.
    """

    kind: str
    pattern: str
    prior: float
    context: tuple[str, ...] = ()
    confirm: Callable[[str], bool] | None = None
    group: int = 0
    by_groups: bool = False
    hint: str = ""  # a text without it (any case) has no match: spares the search


def _iban(span: str) -> bool:
    compact = span.replace(" ", "").replace("-", "").upper()
    return 15 <= len(compact) <= 34 and mod97(compact)


def _ssn(span: str) -> bool:
    area, group, serial = span[:3], span[4:6], span[7:]
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


# The score of a checksum that holds and of a context word nearby, and where context is looked for.
CONFIRMED, NEARBY, CONTEXT_CHARS, THRESHOLD = 0.5, 0.35, 60, 0.6

DEFAULT_RECOGNIZERS = (
    Recognizer("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{1,4}){3,8}(?![A-Za-z0-9])", 0.3, ("iban", "account", "bank", "konto", "compte", "cuenta"), _iban, by_groups=True),
    Recognizer("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", 0.05, ("ssn", "social security", "social", "security number", "tax id"), _ssn),
    Recognizer("access_key", r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])", 0.7, ("key", "aws", "access"), hint="ia"),
    Recognizer("secret", r"(?i)(?<![A-Za-z0-9])(?:password|passwd|pwd|secret|token|api[_-]?key)\s{0,4}[=:]\s{0,4}[\"']?([A-Za-z0-9_/+.-]{8,})", 0.7, group=1),
    Recognizer("national_phone", r"(?<![0-9+.-])\(?[0-9]{2,4}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9.-])", 0.3, ("phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono")),
)


def _confirmed(r: Recognizer, text: str) -> Iterator[tuple[int, int]]:
    """Spans of the pattern that hold."""
    pattern, at = re.compile(r.pattern), 0
    while m := pattern.search(text, at):
        start, end = m.span(r.group)
        at = max(m.end(), at + 1)
        if r.confirm is None or r.confirm(text[start:end]):
            yield start, end
        elif r.by_groups:
            # What follows the span, or begins inside of it, may be one of its own.
            at = m.start() + 1
            for k in range(end - 1, start, -1):
                if text[k] in " -" and r.confirm(text[start:k]):
                    yield start, k
                    at = k
                    break


def scored_spans(text: str | None, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS, threshold: float = THRESHOLD) -> list[tuple[int, int, str, float]]:
    """All spans with scores, by start and then kind: the base ones (score 1) and further ones that reach ``threshold``.

    A further span that touches a base one is dropped: those characters are taken.
    """
    base = base_spans(text)
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, b, _ in base), max))
    order = {k: i for i, k in enumerate([*BASE_KINDS, *(r.kind for r in recognizers)])}
    out = [(start, end, kind, 1.0) for start, end, kind in base]
    if text:
        for r in recognizers:
            if r.hint and r.hint not in text and r.hint.upper() not in text:
                continue
            for start, end in _confirmed(r, text):
                score = r.prior + (CONFIRMED if r.confirm is not None else 0)
                if r.context:
                    around = f"{text[max(0, start - CONTEXT_CHARS):start]} {text[end:end + CONTEXT_CHARS]}".lower()
                    if any(re.search(rf"(?<!\w){re.escape(word)}(?!\w)", around) for word in r.context):
                        score += NEARBY
                before = bisect_left(starts, end)  # base spans that begin before this one ends
                if score >= threshold and not (before and reach[before - 1] > start):
                    out.append((start, end, r.kind, round(min(score, 1.0), 2)))
    return sorted(out, key=lambda s: (s[0], order[s[2]], s[1]))


def joined(spans: Sequence[tuple]) -> str:
    return ",".join(f"{s[2]}:{s[0]}:{s[1]}" for s in spans)


def find_pii(docs: DataFrame, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS, text: str = "text", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """Spans of every row: ``doc_id, spans array<struct<start, end, kind, score>>``; none for a null or empty text."""
    def run(c: dict[str, list]) -> dict[str, list]:
        found = [[dict(zip(("start", "end", "kind", "score"), s, strict=True)) for s in scored_spans(t, recognizers, threshold)] for t in c["text"]]
        return {"doc_id": c["doc_id"], "spans": found}

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).alias("text"))
    return map_blocks(source, run, "doc_id bigint, spans array<struct<start: bigint, end: bigint, kind: string, score: double>>")


def base_digest(spans: Sequence[tuple]) -> str:
    return hashlib.sha256(joined([s for s in spans if s[2] in BASE_KINDS]).encode()).hexdigest()


def mask_pii(docs: DataFrame, recognizers: Sequence[Recognizer] = DEFAULT_RECOGNIZERS, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """All rows with all columns; each span of personal data replaced by its kind, as in ``<email>``.

    Overlapping spans become one mark, of the first span's kind. Null texts stay null.
    """
    def clean(value: str | None) -> str | None:
        spans = scored_spans(value, recognizers, threshold)
        if not spans:
            return value
        parts, at = [], 0
        for start, end, kind, _ in spans:
            if start >= at:
                parts += (value[at:start], f"<{kind}>")
            at = max(at, end)
        return "".join(parts) + value[at:]

    return edit_rows(docs, lambda texts: ([clean(t) for t in texts], None), text)
