"""Ingest of a folder as a stream of files: each new source file joins the registry once.

The stream's checkpoint tells which files were taken in; the registry tells which contents it holds. A batch that runs
again after a crash finds its contents there, so that each takes effect once; a copy under another name is none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.jobs import Wiki
from ..sources import markdown


def read_new(spark: SparkSession, folder: str, endings: tuple[str, ...] = markdown.READABLE) -> DataFrame:
    """filename, text of a folder's source files as a stream, each file a row, whatever lies how deep."""
    files = spark.readStream.option("wholetext", "true").option("recursiveFileLookup", "true").text(folder)
    path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    named = files.select(T.base_name(path).alias("filename"), F.col("value").alias("text"))
    return named.where(F.lower(F.regexp_extract("filename", r"\.([^.]+)$", 1)).isin(*endings) & ~F.col("filename").isin(*markdown.NO_SOURCE))


def ingest_folder(wiki: Wiki, folder: str, checkpoint: str, every: str | None = None, rebuild: bool = True):
    """Registers what came into a folder since the last run, then rebuilds what follows from it; with `every` (a duration) goes on until the query that it returns is stopped."""

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            wiki.register(batch)
            if rebuild:
                wiki.rebuild()

    writer = read_new(wiki.spark, folder).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    if every is None:
        query.awaitTermination()
    return query
