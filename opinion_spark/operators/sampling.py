"""Exact, repeatable splits and samples.

A draw takes, per group, the rows with the smallest hash of (key, seed). The
largest hash taken, the *cut*, is found from counts alone, so that the draw
itself is a plain filter: rows are neither sorted nor shuffled, whatever the
size of a group. Keys must be set and unique: NULL keys are refused, and so is a
draw that copies of a key would make too large.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Mapping
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructField, StructType

from opinion_spark.constants import LABEL, SEED
from opinion_spark.functions.columns import named

SPAN = 1 << 60  # hashes are compared on their first 15 hex digits until few are left
MAX_CLASSES = 10_000  # class counts are held by the driver
NONE, ALL = "", "g"  # no md5 text is <= "", every one is <= "g"


def draw_hash(key: Column, seed: int = SEED, salt: str = "") -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}{salt}")))


@dataclass(frozen=True)
class Region:
    """A range of hashes that holds the cut of a group."""

    low: int
    high: int
    below: int
    inside: int


def hash_cuts(
    df: DataFrame,
    key: str,
    group: Column,
    take: Mapping[Hashable, int],
    counts: Mapping[Hashable, int],
    seed: int = SEED,
    few: int = 100_000,
    spread: float = 6.0,
) -> dict[Hashable, str]:
    """Per group the hash of its ``take``-th row in hash order.

    Hashes are uniform, so the cut lies near the quantile take/count. Each
    round counts rows per cell of the range (one pass over key and group, map-
    side combined to a handful of rows) and keeps the cell with the cut, until
    it holds at most ``few`` rows; those are ranked. One round is the rule;
    small groups need none, and a wrong guess only costs another round. Groups
    are looked up in a small table, so their number does not blow up the plan.
    Fails where keys are NULL, or repeat so that no cut gives the size.
    """
    cuts: dict[Hashable, str] = {g: NONE if k <= 0 else ALL for g, k in take.items()}
    regions = {g: Region(0, SPAN, 0, counts[g]) for g, k in take.items() if 0 < k < counts[g]}
    if not regions:
        return cuts
    hashes = df.select(group.alias("g"), draw_hash(named(key), seed).alias("h"))
    number = F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint")
    kind = hashes.schema["g"].dataType

    guess = True
    while wide := {g: r for g, r in regions.items() if r.inside > few and r.high - r.low > 1}:
        points = {g: _points(r, take[g], counts[g], spread if guess else None) for g, r in wide.items()}
        guess = False
        ranges = _small_table(df, kind, "low bigint, high bigint, points array<bigint>", [(g, r.low, r.high, points[g]) for g, r in wide.items()])
        found = (
            hashes.withColumn("x", number).join(ranges, "g").filter("x >= low AND x < high")
            .groupBy("g", F.size(F.filter("points", lambda p: p <= F.col("x"))).alias("cell"))
            .count()
            .collect()  # at most a few dozen counts per group
        )
        sizes: dict[Hashable, dict[int, int]] = {}
        for row in found:
            sizes.setdefault(row["g"], {})[row["cell"]] = row["count"]
        for g, r in wide.items():
            edges = [r.low, *points[g], r.high]
            below = r.below
            for c in range(len(edges) - 1):
                inside = sizes.get(g, {}).get(c, 0)
                if below + inside >= take[g]:
                    regions[g] = Region(edges[c], edges[c + 1], below, inside)
                    break
                below += inside
            else:
                raise ValueError(f"column {key!r} has fewer keys than rows to draw; NULL keys cannot be drawn")

    ranges = _small_table(df, kind, "low bigint, high bigint, missing bigint", [(g, r.low, r.high, take[g] - r.below) for g, r in regions.items()])
    ranks = (
        hashes.join(ranges, "g").filter(number.between(F.col("low"), F.col("high") - 1))
        .groupBy("g", "h", "missing").count()
        .withColumn("upto", F.sum("count").over(Window.partitionBy("g").orderBy("h")))
        .filter("upto >= missing")
        .groupBy("g").agg(F.min_by(F.struct("h", "upto", "missing"), "h").alias("cut"))
    )
    for row in ranks.collect():
        if row["cut"]["upto"] != row["cut"]["missing"]:
            raise ValueError(f"keys in {key!r} repeat: no cut draws exactly {take[row['g']]} rows")
        cuts[row["g"]] = row["cut"]["h"]
        del regions[row["g"]]
    if regions:
        raise ValueError(f"column {key!r} has fewer keys than rows to draw; NULL keys cannot be drawn")
    return cuts


def with_draw(df: DataFrame, key: str, label: str | None, cuts: Mapping[Hashable, str], seed: int = SEED, out: str = "is_test") -> DataFrame:
    """Add ``out``: whether a row belongs to the draw described by ``cuts`` (NULL for a group without a cut)."""
    drawn = draw_hash(named(key), seed)
    if label is None:
        return df.withColumn(out, drawn <= F.lit(cuts[0]))
    table = _small_table(df, df.schema[label].dataType, "_cut string", list(cuts.items())).withColumnRenamed("g", "_group")
    return df.join(table, named(label) == F.col("_group"), "left").withColumn(out, drawn <= F.col("_cut")).drop("_group", "_cut")


def check_keys(df: DataFrame, key: str) -> None:
    """Draws need a key in every row."""
    if df.filter(named(key).isNull()).limit(1).count():
        raise ValueError(f"column {key!r} has NULL keys; a draw needs a key in every row")


def class_sizes(df: DataFrame, label: str = LABEL) -> dict[Hashable, int]:
    """Rows per class in class order; rows without a label do not count."""
    counted = df.filter(named(label).isNotNull()).groupBy(named(label).alias("g")).count()
    rows = counted.limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} values; it is no class label")
    return {row["g"]: row["count"] for row in sorted(rows, key=lambda r: r["g"])}


def allocate_test(counts: Mapping[Hashable, int], test_size: float) -> dict[Hashable, int]:
    """Test rows per class: ceil(test_size * n) in all.

    The train rows are shared out in proportion by largest remainder, equal
    remainders in class order; the test set takes the rest of each class.
    """
    if not 0 < test_size < 1:
        raise ValueError(f"test_size must lie between 0 and 1, not {test_size}")
    total = sum(counts.values())
    n_test = math.ceil(test_size * total)
    n_train = total - n_test
    if min(counts.values(), default=0) < 2:
        raise ValueError("every class needs at least two rows")
    if min(n_train, n_test) < len(counts):
        raise ValueError(f"{n_train} train and {n_test} test rows cannot hold {len(counts)} classes each")
    train = {g: n * n_train // total for g, n in counts.items()}
    by_remainder = sorted(counts, key=lambda g: -(counts[g] * n_train % total))
    for g in by_remainder[: n_train - sum(train.values())]:
        train[g] += 1
    return {g: n - train[g] for g, n in counts.items()}


def stratified_split(
    df: DataFrame,
    key: str,
    label: str = LABEL,
    test_size: float = 0.2,
    seed: int = SEED,
    mode: str = "exact",
    counts: Mapping[Hashable, int] | None = None,
) -> DataFrame:
    """Add ``is_test``; class shares are equal on both sides to the row.

    ``mode="hash"`` marks each row by its own hash, without counting: sizes
    are then right on average only, but it works on streams as well.
    """
    if not 0 < test_size < 1:
        raise ValueError(f"test_size must lie between 0 and 1, not {test_size}")
    if mode == "hash":
        return df.withColumn("is_test", draw_hash(named(key), seed) < f"{int(test_size * SPAN):015x}")
    if mode != "exact":
        raise ValueError(f"unknown mode {mode!r}")
    slim = df.select(named(key), named(label))
    check_keys(slim, key)
    sizes = counts or class_sizes(slim, label)
    cuts = hash_cuts(slim, key, named(label), allocate_test(sizes, test_size), sizes, seed)
    return with_draw(df, key, label, cuts, seed)


def sample_size(rows: int, requested: int | None = None, least: int = 50, most: int = 2000) -> int:
    """The evaluation sample size: 500 unless asked, and at most the table.

    A request outside ``least`` to ``most`` is refused, not changed.
    """
    wanted = 500 if requested is None else requested
    if not least <= wanted <= most:
        raise ValueError(f"the sample size must lie between {least} and {most}, not {wanted}")
    return min(wanted, rows)


def stratified_sample(df: DataFrame, key: str, label: str, size: int, seed: int = SEED) -> DataFrame:
    """``size // classes`` rows of each class, or all where it has fewer, shuffled.

    ``eval_id`` numbers the rows 0, 1, ... in the shuffled order. With one
    class or none, the sample is drawn from the whole table.
    """
    slim = df.select(named(key), named(label)) if label in df.columns else None
    counts = class_sizes(slim, label) if slim is not None else {}
    if len(counts) < 2:
        return random_sample(df, key, size, seed)
    check_keys(slim, key)
    take = {g: min(n, size // len(counts)) for g, n in counts.items()}
    cuts = hash_cuts(slim, key, named(label), take, counts, seed)
    return _numbered(df, with_draw(slim, key, label, cuts, seed, "_drawn").filter("_drawn").select(named(key)), key, seed)


def random_sample(df: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """Exactly ``size`` rows (all, if the table has fewer), shuffled, with ``eval_id``."""
    keys = df.select(named(key))
    check_keys(keys, key)
    rows = keys.count()
    cuts = hash_cuts(keys, key, F.lit(0), {0: min(size, rows)}, {0: rows}, seed)
    return _numbered(df, with_draw(keys, key, None, cuts, seed, "_drawn").filter("_drawn").select(named(key)), key, seed)


def _numbered(df: DataFrame, drawn: DataFrame, key: str, seed: int) -> DataFrame:
    """The rows of the drawn keys, whose number is bounded by the requested size: only keys go to one task."""
    shuffled = Window.orderBy(draw_hash(named(key), seed, "-order"))
    numbers = drawn.select(named(key).alias("_drawn_key"), (F.row_number().over(shuffled).cast("bigint") - 1).alias("eval_id"))
    return df.join(numbers, named(key) == F.col("_drawn_key")).drop("_drawn_key")


def _points(region: Region, take: int, count: int, spread: float | None) -> list[int]:
    if spread is None:
        step = max(1, (region.high - region.low) // 16)
        inner = range(region.low + step, region.high, step)
    else:
        share = take / count
        slack = spread * math.sqrt(share * (1 - share) / count) + spread / count
        inner = (int((share - slack) * SPAN), int((share + slack) * SPAN))
    return [p for p in inner if region.low < p < region.high]


def _small_table(df: DataFrame, kind: DataType, columns: str, rows: list[tuple]) -> DataFrame:
    """A table of one row per group, of a size Spark knows."""
    schema = StructType([StructField("g", kind), *StructType.fromDDL(columns)])
    data = [pa.array([r[i] for r in rows], type=to_arrow_type(f.dataType)) for i, f in enumerate(schema)]
    return df.sparkSession.createDataFrame(pa.Table.from_arrays(data, names=schema.names), schema=schema)
