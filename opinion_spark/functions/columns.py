"""Small column helpers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def named(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col(quoted(name))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sql_text(value: str) -> str:
    """A SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def lookup(key: Column, table: Mapping, default=None) -> Column:
    """The entry of a small literal table for ``key``."""
    out: Column | None = None
    for k, v in table.items():
        out = F.when(key == F.lit(k), F.lit(v)) if out is None else out.when(key == F.lit(k), F.lit(v))
    return F.lit(default) if out is None else out.otherwise(F.lit(default))


def ratio(numerator: Column, denominator: Column) -> Column:
    """A quotient that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(numerator.cast("double"), denominator.cast("double")), F.lit(0.0))


def free_name(columns: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores after it until no column has the name, in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted
