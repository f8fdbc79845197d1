"""Ranks over whole tables, or over groups of any size, without gathering a group in one task.

Rows are dealt to ranges of the order, numbered within each range, and moved up by the number of rows of the ranges
before. A group that is larger than a range is numbered by several tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stages import cut


def numbered(df: DataFrame, name: str, order: list[Column | str], by: tuple[str, ...] = ()) -> DataFrame:
    """df with the number (from 1) of each row in its order, within equal values of `by`; rows that are equal in all of these are numbered in any order."""
    keys = [F.col(c) for c in by]
    # Written, so that each row stays in the range that it was counted in.
    ranged = cut(df.repartitionByRange(*keys, *order).withColumn("_range", F.spark_partition_id()))
    counts = ranged.groupBy("_range", *by).agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_range").alias("_at"), *(F.col(c).alias(f"_{c}") for c in by), F.coalesce(F.sum("_n").over(along), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range", *by).orderBy(*order))
    same = F.col("_range") == F.col("_at")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    met = ranged.withColumn("_within", within).join(before, same)
    return met.select(*df.columns, (F.col("_within") + F.col("_before")).cast("long").alias(name))


def chunks(pairs: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """key, chunk (from 0), n and values of the distinct pairs, sorted: lists of `size` at most, however many values a key has."""
    placed = numbered(pairs.select(key, value).distinct(), "_place", [value], (key,)).withColumn("chunk", F.floor((F.col("_place") - 1) / size))
    return placed.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(value)).alias("values"))
