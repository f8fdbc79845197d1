"""Mixing sources to target weights, with DataFrame functions only.

Each source's target is its weight's share of what the mix takes in all; no target exceeds `most` times its source's
size, and what exceeds it is shared again by weight. Within each source the documents stand in the order of a
hash-random key; a distributed prefix sum of their sizes (sums of ranges of the key, then running sums within a range)
says where the budget ends. A target of more than the source's size takes all documents once (or more often), then goes on for another
epoch from the start of the order.

Defined results: a null or empty text has size 0 and nothing is taken of it; a null source is a source of its own,
last in order; sources without words have target 0; repeated rows and rows with equal keys are told apart by doc_id,
then by the digest of the text, and rows that are equal in these too stand next to each other and count each for itself; an empty
table gives an empty result. Columns of the input with the names of result columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, fresh, stored, whole_text

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SEED = 9
#: Ranges of the key: a power of 16, one for every RANGE_ROWS rows and 16 ** FEWEST at least.
RANGE_ROWS, FEWEST = 4096, 2


def n_words(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def _name(source: str = "source") -> Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.struct(F.col(source).isNull().alias("none"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("name"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes: key, source_size, a row for each source (so that a single task orders them). Adds weight and target.

    With all excess shared again until none is above its bound, each source has min(weight x level, bound) for one
    level. Bounds are met in the order of bound / weight, so the level is the first at which the next bound isn't met.
    """
    rank = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    ranked = sizes.withColumns({"weight": F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank + 1).cast("int")), "bound": F.col("source_size") * F.lit(float(most))})
    by_ratio = Window.orderBy(F.col("bound") / F.col("weight"), "key")
    everything = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    met = F.coalesce(F.sum("bound").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - met) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    placed = ranked.withColumns({"place": F.row_number().over(by_ratio), "level": level})
    first = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct("place", "level"))).over(everything)
    return placed.withColumn("first", first).select("key", "source_size", "weight", F.when(F.col("place") >= F.col("first.place"), F.least(F.col("weight") * F.col("first.level"), "bound")).otherwise(F.col("bound")).alias("target"))


def mix(df: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = SEED, id_column: str = "doc_id") -> DataFrame:
    """doc_id, text_digest, source, size, source_size, target and `taken` words (repeats counted) of each row of df."""
    text = whole_text()
    sized = stored(df.select(F.col(f"`{id_column}`").alias("doc_id"), "source", F.xxhash64(text).alias("text_digest"), n_words().alias("size")), "mix-sizes")
    digits = max(FEWEST, len(f"{sized.count() // RANGE_ROWS:x}"))
    # Null ids are dealt by their texts.
    random = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("text_digest").cast("string")))))
    keyed = sized.withColumn("key", _name()).withColumn("random", random).withColumn("range", F.substring("random", 1, digits))
    ranges = keyed.groupBy("key", "range").agg(F.sum("size").alias("range_size"))
    bounds = targets(ranges.groupBy("key").agg(F.sum("range_size").alias("source_size")), weights, share, most)
    # A window here holds a source's ranges: one for RANGE_ROWS rows of the input.
    along = Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("key", "range", F.coalesce(F.sum("range_size").over(along), F.lit(0)).alias("start")).join(bounds, "key")
    # A window here holds about RANGE_ROWS rows, however large the source.
    within = Window.partitionBy("key", "range").orderBy("random", "doc_id", "text_digest").rowsBetween(Window.unboundedPreceding, 0)
    placed = keyed.withColumn("end", F.sum("size").over(within)).join(starts, ["key", "range"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size") - (F.col("start") + F.col("end") - F.col("size"))
    taken = epochs * F.col("size") + F.greatest(F.lit(0), F.least("size", left))
    return placed.select("doc_id", "text_digest", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The rows of df as often as the mix takes them. The document in which a budget ends is taken once more if at least half of it lies within."""
    id_, digest, key, times, rows_, copy = fresh(df.columns, "_id", "_digest", "_key", "_times", "_rows", "_copy")
    whole = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    # Rows that are equal in id, text and source share what these take.
    share = mix(df, **options).withColumn(times, whole).groupBy(F.col("doc_id").alias(id_), F.col("text_digest").alias(digest), _name().alias(key)).agg(F.sum(times).alias(times), F.count(F.lit(1)).alias(rows_)).where(F.col(times) > 0)
    rows = df.withColumns({id_: F.col("doc_id"), digest: F.xxhash64(whole_text()), key: _name()})
    same = rows[id_].eqNullSafe(share[id_]) & (rows[digest] == share[digest]) & (rows[key] == share[key])
    found = rows.join(share, same).select(*[rows[f"`{c}`"] for c in df.columns], rows[id_], rows[digest], rows[key], times, rows_)
    order = F.row_number().over(Window.partitionBy(id_, digest, key).orderBy(F.lit(1)))
    several = found.where(F.col(rows_) > 1).withColumn(times, (F.floor(F.col(times) / F.col(rows_)) + (order <= F.col(times) % F.col(rows_)).cast("int")).cast("int"))
    each = found.where(F.col(rows_) == 1).withColumn(times, F.col(times).cast("int")).unionByName(several).where(F.col(times) > 0)
    return each.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.sequence(F.lit(1), F.col(times))).alias(copy)).drop(copy)
