"""Fill-in-middle transformation: texts cut at unit boundaries and put together anew.

The texts of a block are laid end to end as bytes, each byte with its class
(line feed, blank, end of sentence, inside of a character, other), and a wavelet
matrix over the classes answers where units end: their number in a text is a
sum of ranks, the place of a cut a select (one class) or a bisection on ranks
(several), and code points are bytes less the rank of inner bytes. Both cuts
and the form follow from the document's id alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from opinion_spark.functions.columns import named
from opinion_spark.llm.batches import BLOCK_CHARS, row_slices
from opinion_spark.llm.wavelet import WaveletMatrix

# The markers before prefix, suffix and middle.
MARKERS = ("<P>", "<S>", "<M>")
SEED = 7

OTHER, BLANK, NEWLINE, STOP, INNER = range(5)
CLASS_BITS = 3
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = BLANK
_CLASS[0x0A] = NEWLINE
_CLASS[[ord(c) for c in ".!?"]] = STOP
_CLASS[0x80:0xC0] = INNER

#: The classes of which a character ends a unit; a rest without one is a unit too.
UNITS = {"line": (NEWLINE,), "word": (NEWLINE, BLANK), "sentence": (NEWLINE, STOP)}

SCHEMA = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output binary"


@dataclass(frozen=True)
class Cuts:
    """Per text: units, and where prefix and middle end, in bytes and code points from its start."""

    units: np.ndarray
    first: np.ndarray
    second: np.ndarray
    first_chars: np.ndarray
    second_chars: np.ndarray


def draw_cuts(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, draws: np.ndarray, unit: str = "line") -> Cuts:
    """The cuts of the texts in ``buffer`` at the boundaries that the two ``draws`` of each choose, modulo units + 1."""
    classes = _CLASS[buffer]
    matrix = WaveletMatrix(classes, CLASS_BITS)
    codes = UNITS[unit]
    before = matrix.ranks(codes, starts)
    ended = matrix.ranks(codes, ends) - before
    full = ends > starts
    last = np.full(len(starts), OTHER, dtype=np.uint8)
    last[full] = classes[ends[full] - 1]
    units = ended + (full & ~np.isin(last, codes))
    chosen = np.sort(draws % (units + 1)[:, None], axis=1)

    def place(number: np.ndarray) -> np.ndarray:
        """Where the unit of this number (from 1) ends."""
        out = np.where(number > 0, ends, starts)
        inside = np.flatnonzero((number > 0) & (number <= ended))
        if len(inside):
            wanted = before[inside] + number[inside] - 1
            out[inside] = (matrix.select(codes[0], wanted) if len(codes) == 1 else matrix.bisect(codes, wanted)) + 1
        return out

    first, second = place(chosen[:, 0]), place(chosen[:, 1])
    inner = [matrix.rank(INNER, x) for x in (starts, first, second)]
    return Cuts(units, first - starts, second - starts, first - starts - (inner[1] - inner[0]), second - starts - (inner[2] - inner[0]))


def key_draws(ids: Sequence[int | None], seed: int = SEED) -> np.ndarray:
    """Four numbers below 2^32 for each id, from the hash of seed and id; a null id has an empty name."""
    raw = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(raw, dtype=">u4").reshape(len(ids), 4).astype(np.int64)


def check_markers(markers: Sequence[str]) -> tuple[bytes, bytes, bytes]:
    """Markers as bytes; refused if an end of one begins another, as an output could then be read in two ways."""
    found = tuple(m.encode() for m in markers)
    if len(found) != 3 or not all(found) or len(set(found)) != 3:
        raise ValueError("three different markers are needed")
    for a in found:
        for b in found:
            if any(a.endswith(b[:k]) for k in range(1, min(len(a), len(b)) + (a != b))):
                raise ValueError(f"the end of marker {a.decode()} begins marker {b.decode()}")
    return found


def restore_text(output: bytes, form: str, markers: tuple[bytes, bytes, bytes]) -> bytes:
    """The text of an output, by its form and markers alone."""
    if form == "plain":
        return output
    p, s, m = markers
    head, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(head):
        raise ValueError(f"an output of form {form} must begin with its marker")
    one, rest = output[len(head):].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def fill_in_middle(
    docs: DataFrame,
    unit: str = "line",
    fim_percent: int = 100,
    spm_percent: int = 50,
    seed: int = SEED,
    markers: Sequence[str] = MARKERS,
    text: str = "text",
    key: str = "doc_id",
    digests: bool = False,
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every row, ``output`` a string.

    ``n``: units of the whole text (``line``, ``word`` or ``sentence``: each ends
    with a line feed, a blank or line feed, one of ``.!?`` or a line feed; the rest
    is one as well). The form is plain for an empty or null text, one that
    contains a marker, and ``100 - fim_percent`` of the rest; the others are
    ``spm`` or ``psm``. Lengths are code points, null for plain rows. Repeated
    ids are cut by the same draws, each in its own text; a null id draws as an
    empty name. ``digests`` gives ``output_sha256`` and ``restored_sha256``, of
    the text rebuilt from the output, instead of the output.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit!r}")
    sent = check_markers(markers)
    p, s, m = sent
    schema = SCHEMA.replace("output binary", "output_sha256 string, restored_sha256 string") if digests else SCHEMA
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in row_slices(batch, 1, BLOCK_CHARS):
                ids = rows.column(0).to_pylist()
                texts = [t or b"" for t in rows.column(1).to_pylist()]
                ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
                starts = ends - np.array([len(t) for t in texts], dtype=np.int64)
                draws = key_draws(ids, seed)
                cuts = draw_cuts(np.frombuffer(b"".join(texts), dtype=np.uint8), starts, ends, draws[:, :2], unit)
                forms, outputs, restored = [], [], []
                for i, t in enumerate(texts):
                    a, b = int(cuts.first[i]), int(cuts.second[i])
                    if not t or p in t or s in t or m in t or draws[i, 2] % 100 >= fim_percent:
                        form, out = "plain", t
                    elif draws[i, 3] % 100 < spm_percent:
                        form, out = "spm", b"".join((s, t[b:], p, t[:a], m, t[a:b]))
                    else:
                        form, out = "psm", b"".join((p, t[:a], s, t[b:], m, t[a:b]))
                    forms.append(form)
                    if digests:
                        outputs.append(hashlib.sha256(out).hexdigest())
                        restored.append(hashlib.sha256(restore_text(out, form, sent)).hexdigest())
                    else:
                        outputs.append(out)
                plain = np.array([f == "plain" for f in forms], dtype=bool)
                columns = [
                    rows.column(0), pa.array(cuts.units), pa.array(forms, type=pa.string()),
                    pa.array(cuts.first_chars, mask=plain), pa.array(cuts.second_chars - cuts.first_chars, mask=plain),
                    pa.array(outputs, type=pa.string() if digests else pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(restored, type=pa.string())] if digests else columns, schema=arrow)

    source = docs.select(named(key).cast("bigint").alias("doc_id"), named(text).cast("binary").alias("text"))
    made = source.mapInArrow(work, schema)
    return made if digests else made.withColumn("output", F.col("output").cast("string"))
