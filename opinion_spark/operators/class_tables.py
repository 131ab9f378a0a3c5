"""Exact stratified splits over any number of classes: counts, quotas and cuts stay tables.

``sampling`` holds one count per class on the driver. Here class counts are
shared out by remainder where they are, and the hash cut of every class is found
in rounds of joins with the ranges still in question: a class is halved by
counting until few of its rows are left, and only those are ranked.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opinion_spark.constants import LABEL, SEED
from opinion_spark.functions.columns import named
from opinion_spark.operators.numbering import numbered
from opinion_spark.operators.sampling import SPAN, check_keys, draw_hash
from opinion_spark.session import stage

#: Cells that a range of hashes is counted in.
CELLS = 64


def class_counts(df: DataFrame, label: str = LABEL) -> DataFrame:
    """``g, n``: rows per class; rows without a label do not count; written."""
    return stage(df.filter(named(label).isNotNull()).groupBy(named(label).alias("g")).agg(F.count(F.lit(1)).alias("n")), "class-counts")


def allocate_test_rows(counts: DataFrame, test_size: float) -> DataFrame:
    """``g, n, take``: test rows per class, ceil(test_size * n) in all.

    Train rows are shared out by largest remainder, equal remainders in class
    order, by the same rules and refusals as ``sampling.allocate_test``.
    """
    if not 0 < test_size < 1:
        raise ValueError(f"test_size must lie between 0 and 1, not {test_size}")
    total, classes, least = counts.agg(F.sum("n"), F.count(F.lit(1)), F.min("n")).first()
    n_test = math.ceil(test_size * (total or 0))
    n_train = (total or 0) - n_test
    if (least or 0) < 2:
        raise ValueError("every class needs at least two rows")
    if min(n_train, n_test) < classes:
        raise ValueError(f"{n_train} train and {n_test} test rows cannot hold {classes} classes each")
    product = F.col("n").cast("decimal(38,0)") * F.lit(n_train).cast("decimal(20,0)")
    low = F.expr(f"CAST(CAST(n AS DECIMAL(20,0)) * {n_train} div {total} AS BIGINT)")
    shared = counts.withColumn("low", low).withColumn("rest", (product - F.col("low") * F.lit(total).cast("decimal(20,0)")).cast("decimal(38,0)"))
    # A remainder depends on the size alone, and n rows have at most sqrt(2 n) different class sizes.
    sizes = shared.groupBy("rest").agg(F.count(F.lit(1)).alias("classes"), F.sum("low").alias("rows")).collect()
    left = n_train - sum(r["rows"] for r in sizes)
    more = F.lit(False)
    for r in sorted(sizes, key=lambda r: -r["rest"]):
        if left <= 0:
            break
        rest = F.lit(r["rest"]).cast("decimal(38,0)")
        if left >= r["classes"]:
            more = F.col("rest") >= rest
        else:  # only the classes of this remainder are put in order, up to the last one that gets a row
            placed = numbered(shared.filter(F.col("rest") == rest).select("g"), [F.asc("g")], "place", "class-remainders")
            last = placed.filter(F.col("place") == left - 1).select(F.col("g").alias("_last"))
            shared = shared.crossJoin(F.broadcast(last))
            more = (F.col("rest") > rest) | ((F.col("rest") == rest) & (F.col("g") <= F.col("_last")))
        left -= r["classes"]
    return shared.select("g", "n", (F.col("n") - F.col("low") - more.cast("bigint")).alias("take"))


def class_cuts(hashes: DataFrame, quotas: DataFrame, few: int = 10_000, cells: int = CELLS) -> DataFrame:
    """``g, cut, rows, over``: per class the hash of its ``take``-th row in hash order, the rows that have it, and how many of them are too many; written.

    ``hashes`` has ``g, h``, written; ``quotas`` has ``g, n, take`` with 0 < take <= n.
    """
    x = F.conv(F.substring("h", 1, 15), 16, 10).cast("bigint")
    ranges = stage(quotas.select("g", F.lit(0).cast("bigint").alias("low"), F.lit(SPAN).alias("high"), F.col("take").alias("missing"), F.col("n").alias("inside"), "take"), "cut-ranges")
    done = ranges.filter(F.col("inside") <= few)
    open_ = ranges.filter(F.col("inside") > few)
    while not open_.isEmpty():
        width = F.ceil((F.col("high") - F.col("low")) / F.lit(float(cells))).cast("bigint")
        counted = hashes.withColumn("x", x).join(open_.withColumn("width", F.greatest(width, F.lit(1))), "g").filter("x >= low AND x < high")
        # Map-side combined to at most ``cells`` rows a class.
        sums = counted.groupBy("g", "low", "high", "missing", "take", "width", F.expr("(x - low) div width").alias("cell")).agg(F.count(F.lit(1)).alias("rows"))
        upto = F.sum("rows").over(Window.partitionBy("g").orderBy("cell"))
        hit = sums.withColumn("upto", upto).filter((F.col("upto") >= F.col("missing")) & (F.col("upto") - F.col("rows") < F.col("missing")))
        begin = F.col("low") + F.col("cell") * F.col("width")
        next_ = stage(hit.select("g", begin.alias("low"), F.least(begin + F.col("width"), "high").alias("high"),
                                 (F.col("missing") - (F.col("upto") - F.col("rows"))).alias("missing"), F.col("rows").alias("inside"), "take"), "cut-ranges")
        # A cell of one hash value holds copies of a key, however many.
        small = (F.col("inside") <= few) | (F.col("high") - F.col("low") <= 1)
        done, open_ = done.unionByName(next_.filter(small)), next_.filter(~small)
    # Most classes are small and never narrowed: their hashes need no number.
    within = ((F.col("low") == 0) & (F.col("high") == SPAN)) | ((x >= F.col("low")) & (x < F.col("high")))
    near = hashes.join(done, "g").filter(within).groupBy("g", "h", "missing", "take").agg(F.count(F.lit(1)).alias("rows"))
    ranked = near.withColumn("upto", F.sum("rows").over(Window.partitionBy("g").orderBy("h"))).filter("upto >= missing AND upto - rows < missing")
    return stage(ranked.select("g", F.col("h").alias("cut"), "rows", (F.col("upto") - F.col("missing")).alias("over")), "class-cuts")


def split_classes(df: DataFrame, key: str, label: str = LABEL, test_size: float = 0.2, seed: int = SEED, few: int = 10_000) -> DataFrame:
    """Add ``is_test`` as ``sampling.stratified_split`` does, for any number of classes.

    Keys must be set. Rows of one key that a cut falls between are told apart by
    a row number, written once with the table, whose hash is the second part of
    the cut: sizes are exact with copies, too. A row without a label has no side.
    ``few``: rows of a class that one task ranks.
    """
    slim = df.select(named(key), named(label))
    check_keys(slim, key)
    hashes = stage(slim.filter(named(label).isNotNull()).select(named(label).alias("g"), draw_hash(named(key), seed).alias("h")), "draw-hashes")
    cuts = class_cuts(hashes, allocate_test_rows(class_counts(hashes, "g"), test_size), few)
    split = cuts.filter("over > 0").select(F.col("g").alias("_g"), F.col("cut").alias("_cut"), "rows", "over")
    drawn = draw_hash(named(key), seed)
    if split.isEmpty():
        found = cuts.withColumn("second", F.lit(None).cast("string"))
        df = df.withColumn("_row", F.lit(0))
    else:
        df = stage(df.withColumn("_row", F.monotonically_increasing_id()), "numbered-rows")
        copies = df.join(split, (named(label) == F.col("_g")) & (drawn == F.col("_cut"))).select(F.col("_g").alias("g"), draw_hash(F.col("_row"), seed, "-row").alias("h"))
        quotas = split.select(F.col("_g").alias("g"), F.col("rows").alias("n"), (F.col("rows") - F.col("over")).alias("take"))
        second = class_cuts(stage(copies, "copies"), quotas, few).select("g", F.col("cut").alias("second"))
        found = cuts.join(second, "g", "left")
    found = found.select(F.col("g").alias("_g"), F.col("cut").alias("_cut"), F.col("second").alias("_second"))
    at_cut = F.col("_second").isNull() | (draw_hash(F.col("_row"), seed, "-row") <= F.col("_second"))
    joined = df.join(found, named(label) == F.col("_g"), "left")
    return joined.withColumn("is_test", (drawn < F.col("_cut")) | ((drawn == F.col("_cut")) & at_cut)).drop("_g", "_cut", "_second", "_row")
