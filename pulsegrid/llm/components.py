"""Connected components of an edge table by alternating star rounds; nothing but one checksum a round reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.runtime import materialize

MAX_ROUNDS = 100


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges (v, u) with u < v: every v keeps one edge to its least neighbour, its other neighbours move there."""
    least = edges.groupBy("v").agg(F.min("u").alias("m"))
    moved = edges.join(least, "v").where(F.col("u") != F.col("m")).select(F.col("u").alias("v"), F.col("m").alias("u"))
    return least.select("v", F.col("m").alias("u")).union(moved).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every vertex sends its larger neighbours to the least vertex around it."""
    both = edges.select("v", "u").union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
    larger = edges.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return larger.join(least, "v").select(F.col("w").alias("v"), F.col("m").alias("u")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` of every vertex with an edge to another; the component is its least vertex.

    Each round is written to the shared folder, so a lost executor costs one round at most. Loops and repeated edges
    do no harm; an empty table gives an empty table.
    """
    now = edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct()
    now = materialize(now)
    mark = None
    for _ in range(MAX_ROUNDS):
        now = materialize(_small_star(_large_star(now)))
        new = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if new == mark:
            roots = now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(roots)
        mark = new
    raise RuntimeError("components did not settle")
