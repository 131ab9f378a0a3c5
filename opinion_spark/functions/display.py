"""Rounding, display formats and short names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALVES = float(2**27 + 1)  # cuts the 53 bits of a double in two
WHOLE = float(2**52)  # doubles from here on have no fraction


def _scaled(value: Column, digits: int) -> Column:
    """``|value| * 10^digits`` as a whole number, half to even, from the double's exact binary value.

    The product of two doubles is its rounded value and a rest that is a double
    as well; the rest comes from the upper and the lower half of the value's
    bits, whose products with a power of ten are exact. Decimal digits as
    printed are rounded already, so that they cannot tell whether a value lies
    above or below a tie; product and rest can.
    """
    size, tens = F.abs(value), F.lit(float(10**digits))
    product = size * tens
    spread = size * HALVES
    upper = spread - (spread - size)
    rest = (upper * tens - product) + (size - upper) * tens
    # From 2^52 on the product is whole and the rest may hold units of its own.
    units = F.when(product < WHOLE, F.lit(0).cast("bigint")).otherwise(F.floor(rest))
    whole = product.cast("bigint") + units
    # Against one half: the product's fraction, or where that is at it or whole, the rest.
    over = F.when(product < WHOLE, (product - product.cast("bigint").cast("double")) - 0.5).otherwise((rest - units.cast("double")) - 0.5)
    up = (over > 0) | ((over == 0) & F.when((product < WHOLE) & (rest != 0), rest > 0).otherwise(whole % 2 == 1))
    return F.when(size == 0, F.lit(0).cast("bigint")).otherwise(whole + up.cast("bigint"))


def round_even(value: Column, digits: int) -> Column:
    """Round the exact value half to even; for sizes under 2^52 / 10^digits."""
    number = value.cast("double")
    return F.signum(number) * _scaled(number, digits) / F.lit(float(10**digits))


def fixed(value: Column, digits: int) -> Column:
    """A number with a fixed count of decimals, its exact value rounded half to even."""
    number = value.cast("double")
    scaled, tens = _scaled(number, digits), 10**digits
    sign = F.when(number < 0, "-").otherwise("")
    whole = F.call_function("div", scaled, F.lit(tens).cast("bigint"))
    rest = F.lpad((scaled % tens).cast("string"), digits, "0") if digits else None
    return F.concat(sign, whole.cast("string"), *((F.lit("."), rest) if digits else ()))


def thousands(count: Column) -> Column:
    """A whole number with commas, 12345 -> 12,345."""
    return F.format_number(count, 0)


def percent(share: Column, digits: int) -> Column:
    """A share as a percentage, 0.5 -> 50.00%."""
    return F.concat(fixed(share.cast("double") * 100, digits), F.lit("%"))


def short_name(model: Column, width: int | None = None) -> Column:
    """The last part of a model path, optionally cut to ``width`` characters."""
    last = F.substring_index(model, "/", -1)
    return last if width is None else F.substring(last, 1, width)


def preview_text(text: Column, width: int = 200) -> Column:
    """The first characters of a text, always followed by three dots."""
    return F.concat(F.substring(text, 1, width), F.lit("..."))
