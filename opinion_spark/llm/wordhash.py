"""Words of many texts as 64-bit hashes, in numpy, for use inside Spark tasks.

A batch of texts is laid end to end in one byte buffer, so that the cost of a
call is shared by all its texts. A word is a maximal run of the bytes that
``word_bytes`` allows; A-Z is lower-cased first. Bytes of 0x80 and above belong
to characters outside ASCII and are word bytes in both of the rules used here.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 256
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [2**64 - 1], dtype=np.uint64)


def _byte_class(excluded: Sequence[range]) -> np.ndarray:
    allowed = np.ones(256, dtype=bool)
    for part in excluded:
        allowed[part.start:part.stop] = False
    return allowed


#: Words for tokenizers: whatever stands between blanks and line feeds.
BLANKS = _byte_class([range(0x20, 0x21), range(0x0A, 0x0B)])
# The two word rules, as the bytes between words.
SPACED = _byte_class([range(0x20, 0x21), range(0x09, 0x0E)])
ALPHANUMERIC = _byte_class([range(0x00, 0x30), range(0x3A, 0x61), range(0x7B, 0x80)])


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the 64 output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass(frozen=True)
class Words:
    """Hashes of the words of a batch; text ``i`` has those from ``starts[i]`` to ``starts[i + 1]``."""

    hashes: np.ndarray
    starts: np.ndarray
    begin: np.ndarray  # place of each word in the buffer, and its bytes
    size: np.ndarray
    buffer: np.ndarray  # the bytes of all texts, lower-cased if asked
    places: np.ndarray  # where each text begins in the buffer; one separator byte follows each

    def __len__(self) -> int:
        return len(self.starts) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.starts[i]:self.starts[i + 1]]


def hash_words(texts: Sequence[str | bytes | None], word_bytes: np.ndarray = SPACED, lower: bool = True) -> Words:
    """The words of each text, as string or UTF-8 bytes; a null text has none. ``lower``: A-Z as a-z."""
    encoded = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "replace") for t in texts]
    places = np.zeros(len(encoded) + 1, dtype=np.int64)
    np.cumsum([len(b) + 1 for b in encoded], out=places[1:])
    raw = b"\n".join(encoded) + b"\n" * 9  # room to load eight bytes anywhere
    buffer = np.frombuffer(raw, dtype=np.uint8)
    if lower:
        buffer = _LOWER[buffer]
    inside = word_bytes[buffer]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    begin, size = edges[::2], edges[1::2] - edges[::2]
    eight = np.ndarray((len(buffer) - 7,), dtype="<u8", buffer=buffer, strides=(1,))
    hashes = mix(size.astype(np.uint64) * _GOLDEN)
    rest = np.flatnonzero(size <= _LONG_WORD)
    step = 0
    while len(rest):
        left = size[rest] - step
        loaded = eight[begin[rest] + step] & _MASKS[np.minimum(left, 8)]
        hashes[rest] = mix(hashes[rest] * _GOLDEN + loaded)
        rest, step = rest[left > 8], step + 8
    for i in np.flatnonzero(size > _LONG_WORD):
        word = buffer[begin[i]:begin[i] + size[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return Words(hashes, np.searchsorted(begin, places), begin, size, buffer, places)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` consecutive words; empty where there are fewer."""
    count = len(words) - n + 1
    if count <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        out = mix(out * _GOLDEN + words[k:k + count])
    return out


def shingle_sets(words: Words, n: int = 5) -> list[np.ndarray]:
    """The distinct ``n``-word shingles of each text, sorted; all words as one where there are fewer."""
    grams = gram_hashes(words.hashes, n)
    sets = []
    for a, b in zip(words.starts[:-1], words.starts[1:], strict=True):
        if b - a >= n:
            sets.append(np.unique(grams[a:b - n + 1]))
        else:
            sets.append(gram_hashes(words.hashes[a:b], b - a) if b > a else np.empty(0, dtype=np.uint64))
    return sets


def text_blocks(texts: Sequence[str | None], limit: int = 1 << 20) -> Iterator[slice]:
    """Consecutive slices of about ``limit`` characters, so that working memory follows the block."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text or "") + 64
        if total >= limit:
            yield slice(start, i + 1)
            start, total = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))
