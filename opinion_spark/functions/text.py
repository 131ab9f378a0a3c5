"""Text as SQL expressions: the same strings serve DataFrames and ML stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinion_spark.functions.columns import named, sql_text

# Fixed value: where a cut text ends.
MAX_CHARS = 2000

# Token patterns. Letters, numbers and underscore are spelled out
# because \w covers ASCII only in Java.
FEATURE_TOKEN = r"[\p{L}\p{N}_]{2,}"
CLOUD_TOKEN = r"[\p{L}\p{N}_][\p{L}\p{N}_']*"
# Decimal digits of any script, superscripts, subscripts and circled digits.
ALL_DIGITS = r"^[\p{Nd}²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒]+$"


def feature_tokens(text: str) -> str:
    """Lower-case words of two or more characters."""
    return f"regexp_extract_all(lower({text}), {sql_text(FEATURE_TOKEN)}, 0)"


def without_words(tokens: str, stop_words: Sequence[str]) -> str:
    """``tokens`` less the stop words; repeats of other words stay."""
    if not stop_words:
        return tokens
    return f"filter({tokens}, w -> w NOT IN ({', '.join(map(sql_text, stop_words))}))"


def ngrams(tokens: str, sizes: tuple[int, int]) -> str:
    """All runs of ``sizes[0]`` to ``sizes[1]`` neighbouring tokens, joined by a space.

    ``tokens`` must be a column name, as it is used more than once.
    """
    low, high = sizes
    if not 1 <= low <= high:
        raise ValueError(f"bad n-gram range {sizes}")
    parts = []
    for n in range(low, high + 1):
        if n == 1:
            parts.append(tokens)
            continue
        words = ", ' ', ".join(["w"] + [f"get({tokens}, i + {k})" for k in range(1, n)])
        parts.append(f"slice(transform({tokens}, (w, i) -> concat({words})), 1, greatest(size({tokens}) - {n - 1}, 0))")
    return parts[0] if len(parts) == 1 else f"concat({', '.join(parts)})"


def cloud_words(text: str) -> str:
    """Words as written, of any length, less a trailing 's and all-digit words.

    Words that start with a plain letter are never all digits; only the others
    are put to the pattern.
    """
    words = f"regexp_extract_all({text}, {sql_text(CLOUD_TOKEN)}, 0)"
    possessive = "endswith(w, '\\'s') OR endswith(w, '\\'S')"
    cut = f"transform({words}, w -> if({possessive}, left(w, length(w) - 2), w))"
    return f"filter({cut}, w -> NOT ((ascii(w) < 65 OR ascii(w) > 127) AND w RLIKE {sql_text(ALL_DIGITS)}))"


def prepare_text(
    df: DataFrame,
    text: str,
    out: str = "scored_text",
    max_chars: int | None = None,
    drop_blank: bool = True,
    missing: str | None = None,
) -> DataFrame:
    """Add the text a scorer sees in ``out``; the original column stays.

    Rows without text are dropped, or get ``missing`` as their text. Blank
    texts are dropped with ``drop_blank``. Texts are seen in full, unless
    ``max_chars`` cuts them.
    """
    seen = named(text).cast("string")
    seen = seen if missing is None else F.coalesce(seen, F.lit(missing))
    kept = df.filter(seen.isNotNull())
    if drop_blank:
        kept = kept.filter(~seen.rlike(r"(?U)^\s*$"))
    return kept.withColumn(out, cut_text(seen, max_chars))


def cut_text(text: Column, max_chars: int | None = MAX_CHARS) -> Column:
    return text if max_chars is None else F.substring(text, 1, max_chars)
