"""Connected components of a graph given as pairs of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinion_spark.session import stage


def _star(edges: DataFrame, upward: bool) -> DataFrame:
    """Link the larger (or else the smaller) neighbours of each node to the least id around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if upward else edges
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
    around = both.join(least, "a")
    if upward:
        made = around.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        made = around.select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select("a", F.col("least").alias("b")))
    return made.filter(F.col("a") > F.col("b")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node in an edge that is not the least of its component.

    Takes ``a, b`` in any direction. Alternates two rounds of linking neighbours
    to the least id in sight, which ends, after a number of rounds logarithmic
    in the longest path, in stars around the least ids. A round's edges are
    written in the shared folder; no neighbourhood is gathered in one place.
    """
    edges = stage(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct(), "edges")
    mark = None
    while True:
        found = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        mark = tuple(found)
        edges = stage(_star(_star(edges, upward=True), upward=False), "edges")
