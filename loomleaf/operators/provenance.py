"""Sidecars: staleness, merging, claim lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def resolved(files: DataFrame) -> DataFrame:
    """file, content_hash: the names by which source files are found. A path counts before the first folder that holds the name."""
    direct = files.select(F.col("path").alias("file"), F.lit(0).alias("far"), "path", "content_hash")
    by_name = files.where(F.contains("path", F.lit("/"))).select(T.base_name(F.col("path")).alias("file"), F.lit(1).alias("far"), "path", "content_hash")
    return direct.unionByName(by_name).groupBy("file").agg(F.min(F.struct("far", "path", "content_hash")).alias("r")).select("file", "r.content_hash")


def stale_sources(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """stem, file of each sidecar's sources that have changed or are gone."""
    now = resolved(files).withColumnRenamed("content_hash", "now")
    found = sidecars.where("file IS NOT NULL").join(now, "file", "left")
    return found.where(F.col("now").isNull() | (F.col("now") != F.coalesce("file_hash", F.lit("")))).select("stem", "file")


def stale_pages(sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """stem, files: pages with stale sources, and these."""
    return stale_sources(sidecars, files).groupBy("stem").agg(F.array_sort(F.collect_set("file")).alias("files"))


def _first(items: Column, keys) -> Column:
    """The items whose keys no item before has."""
    both = F.transform(items, lambda x: F.struct(x.alias("item"), keys(x).alias("key")))
    return T.held(both, lambda each: T.held(F.transform(each, lambda x: x["key"]), lambda seen: F.transform(F.filter(each, lambda x, i: F.array_position(seen, x["key"]) == i + 1), lambda x: x["item"])))


def merged(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """stem, sources, claims, derived_concepts of the union of two sets of sidecars: what exists first, each source by file and hash and each claim by text and sources once, claims numbered anew."""
    both = existing.select("stem", *(F.col(c).alias(f"{c}_a") for c in ("sources", "claims", "derived_concepts"))).join(
        incoming.select("stem", *(F.col(c).alias(f"{c}_b") for c in ("sources", "claims", "derived_concepts"))), "stem", "full"
    )

    def joint(name: str) -> Column:
        return F.concat(*(F.coalesce(F.col(f"{name}_{s}"), F.array().cast(existing.schema[name].dataType)) for s in "ab"))

    sources = F.filter(joint("sources"), lambda s: F.coalesce(s["file"], F.lit("")) != "")
    claims = F.filter(joint("claims"), lambda c: F.coalesce(c["text"], F.lit("")) != "")
    claims = _first(claims, lambda c: F.struct(c["text"], F.array_sort(c["sources"])))
    numbered = F.transform(claims, lambda c, i: F.struct(F.concat(F.lit("claim-"), (i + 1).cast("string")).alias("id"), c["text"].alias("text"), c["sources"].alias("sources")))
    return both.select(
        "stem", _first(sources, lambda s: F.struct(s["file"], F.coalesce(s["content_hash"], F.lit("")))).alias("sources"), numbered.alias("claims"), F.array_distinct(joint("derived_concepts")).alias("derived_concepts")
    )


def claim_sources(claims: DataFrame, stem: str, claim_id: str) -> DataFrame:
    """source of one claim."""
    return claims.where((F.col("stem") == stem) & (F.col("id") == claim_id)).select(F.explode("sources").alias("source"))
