"""Quality of pages and coverage of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import pages as P
from . import provenance


def page_quality(pages: DataFrame, issues: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """stem, citations, claims, wikilinks, sections, score: 100 less what sidecar, citations, claims, links, fresh sources and sections are missing, and what the issues cost."""
    cost = F.when(F.col("code") == "BROKEN_LINK", 2).when(F.col("code") == "UNMARKED_INFERENCE", 8).when(F.col("severity") == "ERROR", 20).otherwise(3)
    lost = issues.groupBy(F.col("page").alias("stem")).agg(F.sum(cost).alias("lost"))
    has = sidecars.select("stem").distinct().withColumn("has", F.lit(True))
    stale = provenance.stale_sources(sidecars, files).select("stem").distinct().withColumn("stale", F.lit(True))
    own = P.named(pages).select(
        "stem", "type", F.regexp_count("content", F.lit(T.SOURCE)).cast("long").alias("citations"), F.size(P.claim_array(F.col("content"), F.col("confidence"))).cast("long").alias("n_claims"),
        F.regexp_count("content", F.lit(r"\[\[[^\]]+\]\]")).cast("long").alias("wikilinks"), F.regexp_count("content", F.lit(r"(?m)^##\s+")).cast("long").alias("sections"),
    )
    found = own.join(lost, "stem", "left").join(has, "stem", "left").join(stale, "stem", "left")
    claims = F.when(F.col("has"), F.col("n_claims")).otherwise(0)

    def missing(condition, points: int):
        return F.when(condition, points).otherwise(0)

    score = 100 - missing(F.col("has").isNull(), 25) - missing(F.col("citations") == 0, 20) - missing(claims == 0, 15)
    score = score - missing((F.col("wikilinks") < 2) & (F.col("type") == "concept"), 10) - missing(F.col("stale"), 20) - missing(F.col("sections") < 4, 10) - F.coalesce("lost", F.lit(0))
    return found.select("stem", "citations", claims.cast("long").alias("claims"), "wikilinks", "sections", F.greatest(F.lit(0), score).cast("long").alias("score"))


def wiki_quality(scores: DataFrame) -> DataFrame:
    """pages, score: the mean score to one decimal, 0 without pages."""
    return scores.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.bround(F.avg("score"), 1), F.lit(0.0)).alias("score"))


def coverage(pages: DataFrame, headings: DataFrame) -> DataFrame:
    """source, pages, claims, total, uncovered (count), coverage_ratio, score of each source (headings: source, heading; a source without headings has one, 'document', or null).

    A heading is covered if a page cites it for that source, in any case.
    """
    own = P.wiki(pages)
    inline = P.citations(own).select("stem", T.base_name(F.trim("file")).alias("source"), F.trim("section").alias("section"))
    listed = own.select("stem", F.explode("source_refs").alias("ref")).select("stem", T.base_name(F.col("ref")).alias("source"))
    cited = inline.groupBy("source").agg(F.count(F.lit(1)).alias("claims"))
    users = inline.select("stem", "source").unionByName(listed).groupBy("source").agg(F.countDistinct("stem").alias("pages"))
    known = inline.select("source", F.lower("section").alias("key")).distinct().withColumn("covered", F.lit(1))
    each = headings.withColumns({"heading": F.coalesce("heading", F.lit("document"))}).withColumn("key", F.lower("heading"))
    counted = each.join(known, ["source", "key"], "left").groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("covered").isNull()).alias("uncovered"))
    found = counted.join(cited, "source", "left").join(users, "source", "left").withColumns({"claims": F.coalesce("claims", F.lit(0)).cast("long"), "pages": F.coalesce("pages", F.lit(0)).cast("long")})
    found = found.withColumn("coverage_ratio", F.bround((F.col("total") - F.col("uncovered")) / F.col("total"), 3))
    score = F.bround(F.when(F.col("pages") > 0, 40.0).otherwise(0.0) + F.least("claims", F.lit(10)) * 3.0 + F.col("coverage_ratio") * 30.0, 0)
    return found.select("source", "pages", "claims", "total", "uncovered", "coverage_ratio", F.least(F.lit(100), score).cast("long").alias("score"))
