"""The recheck schedule: a fold over each page's checks, due pages and a run over them. As a stream: schedule.py."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Hours between checks by confidence, growth, and the longest interval.
LEAST = {"HIGH": 6.0, "MEDIUM": 24.0, "LOW": 72.0}
MOST = {"HIGH": 72.0, "MEDIUM": 168.0, "LOW": 168.0}
FACTOR, CAP = 1.5, 168.0
NEVER = 9999.0


def hours(table: dict[str, float], confidence: Column, otherwise: float) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.upper(confidence)), F.lit(otherwise))


def fold(checks: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """checks: page, ts, seq, stale. Returns page, confidence, total_checks, stale_count, clean_count, interval_h, last_checked_at, next_check_after.

    levels: page, confidence; MEDIUM for all others. A clean check after the first makes the interval longer; a stale
    one resets it. Only the run of clean checks since the last stale one matters, so this is two aggregations, and no
    page's checks are gathered.
    """
    at = F.struct("ts", "seq")
    base = checks.groupBy("page").agg(
        F.count(F.lit(1)).alias("total_checks"), F.count_if("stale").alias("stale_count"), F.max(F.when(F.col("stale"), at)).alias("reset"), F.max("ts").alias("last_checked_at")
    )
    base = base.join(levels.select("page", F.upper("confidence").alias("confidence")), "page", "left") if levels is not None else base.withColumn("confidence", F.lit(None).cast("string"))
    base = base.withColumn("confidence", F.coalesce("confidence", F.lit("MEDIUM")))
    after = checks.join(base.select("page", "reset"), "page").where("reset IS NULL OR struct(ts, seq) > reset").groupBy("page").agg(F.count(F.lit(1)).alias("run"))
    grown = F.coalesce("run", F.lit(0)) - F.when(F.col("reset").isNull(), 1).otherwise(0)
    least, most = hours(LEAST, F.col("confidence"), 24.0), F.least(hours(MOST, F.col("confidence"), 168.0), F.lit(CAP))
    found = base.join(after, "page", "left").withColumn("interval_h", F.least(least * F.pow(F.lit(FACTOR), grown.cast("double")), most))
    next_ = F.timestamp_seconds(F.unix_micros(F.col("last_checked_at").cast("timestamp")) / 1e6 + F.col("interval_h") * 3600).cast("timestamp_ntz")
    return found.select("page", "confidence", "total_checks", "stale_count", (F.col("total_checks") - F.col("stale_count")).alias("clean_count"), "interval_h", "last_checked_at", next_.alias("next_check_after"))


def due(schedule: DataFrame, now: str, stale: DataFrame | None = None, confidence: str | None = None) -> DataFrame:
    """page, confidence, interval_h, overdue_h, is_stale of the scheduled pages that are due, most overdue first; a page never checked is due for long."""
    late = F.coalesce((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col("next_check_after").cast("timestamp"))) / 3.6e9, F.lit(NEVER))
    kept = schedule if confidence is None else schedule.where(F.upper("confidence") == confidence.upper())
    flags = (stale if stale is not None else schedule.select(F.col("page").alias("stem")).limit(0)).select(F.col("stem").alias("page"), F.lit(True).alias("is_stale")).distinct()
    found = kept.withColumn("overdue_h", late).where("overdue_h > 0").join(flags, "page", "left")
    return found.select("page", "confidence", "interval_h", "overdue_h", F.coalesce("is_stale", F.lit(False)).alias("is_stale")).orderBy(F.desc("overdue_h"), "page")


def recorded(schedule: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """schedule after one more check of some pages (results: page, stale; confidence if new); pages without an entry get one."""
    met = schedule.join(results.select("page", "stale"), "page", "full")
    level = F.coalesce("confidence", F.lit("MEDIUM"))
    checked, least = F.col("stale").isNotNull(), hours(LEAST, level, 24.0)
    n, before = F.coalesce("total_checks", F.lit(0)), F.coalesce("interval_h", least)
    longer = F.least(before * FACTOR, F.least(hours(MOST, level, 168.0), F.lit(CAP)))
    interval = F.when(~checked, before).when(F.col("stale"), least).when(n > 0, longer).otherwise(before)
    time = F.lit(at).cast("timestamp_ntz")
    next_ = F.timestamp_seconds(F.unix_micros(time.cast("timestamp")) / 1e6 + interval * 3600).cast("timestamp_ntz")
    return met.select(
        "page", level.alias("confidence"), (n + checked.cast("int")).alias("total_checks"), (F.coalesce("stale_count", F.lit(0)) + F.coalesce(F.col("stale").cast("int"), F.lit(0))).alias("stale_count"),
        (F.coalesce("clean_count", F.lit(0)) + F.coalesce((~F.col("stale")).cast("int"), F.lit(0))).alias("clean_count"), interval.alias("interval_h"),
        F.when(checked, time).otherwise(F.col("last_checked_at")).alias("last_checked_at"), F.when(checked, next_).otherwise(F.col("next_check_after")).alias("next_check_after"),
    )


def run(pages: DataFrame, schedule: DataFrame, stale: DataFrame, now: str) -> DataFrame:
    """page, bucket (skipped, stale or clean) of one recheck over pages (stem): those not due are skipped. Confidence comes from the schedule alone."""
    entries = schedule.select(F.col("page").alias("stem"), "next_check_after")
    flags = stale.select("stem", F.lit(True).alias("stale")).distinct()
    is_due = F.coalesce(F.col("next_check_after") <= F.lit(now).cast("timestamp_ntz"), F.lit(True))
    bucket = F.when(~is_due, "skipped").when(F.col("stale"), "stale").otherwise("clean")
    return pages.select("stem").join(entries, "stem", "left").join(flags, "stem", "left").select(F.col("stem").alias("page"), bucket.alias("bucket"))


def summary(schedule: DataFrame) -> DataFrame:
    return schedule.groupBy("confidence").agg(F.count(F.lit(1)).alias("pages"), F.sum("total_checks").alias("checks"), F.sum("stale_count").alias("stale"), F.avg("interval_h").alias("mean_interval_h"))
