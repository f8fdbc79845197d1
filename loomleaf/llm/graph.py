"""Connected components by alternating large-star and small-star steps; every step is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _star(edges: DataFrame, small: bool) -> DataFrame:
    """edges: u > v. Each neighbourhood is tied to its least member: that of smaller neighbours, or of all neighbours."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if small:
        found = tied.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        found = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of numbers, in any direction. Returns node and component, its least member, for each node that has an edge to another."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    state = None
    while True:
        before, now = now, stored(_star(_star(now, False), True), "links")
        discard(before)
        found = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(found)
