"""Graph and inlinks kept up to date: after edits only what they touch is made anew.

Of each page the store holds a digest of its file and its typed links. A page is parsed again only if its digest
changed. Its edges are made anew, and so are those of unchanged pages that link to a name that came or went (such a
link meets another page now, or none). Inlinks change for the pages that edited pages linked to before or link to now,
and for names that came or went. All else is carried over from the store as it is.

Each update is written beside the last and then named as the present one, so that a job that ends in between changes
nothing. Equal to a full build (`graph.edges`, `graph.linked`) after any edits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph
from ..operators import pages as P
from ..sources import markdown

FACTS = "path string, digest string, dir string, stem string, links array<struct<pos:int,target:string,rel:string>>, targets array<string>"
EDGES = "source string, target string, type string, weight double, pos int"
INLINKS = "stem string, source string"


class Store:
    """The tables facts, edges and inlinks of a wiki below a folder: versions by number, and the number of the present one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def version(self) -> int:
        """The present version; 0 if there is none."""
        found = markdown.read_json(self.spark, f"{self.folder}/present", "version int").agg(F.max("version")).first()[0]
        return found or 0

    def table(self, name: str, schema: str, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        return self.spark.read.schema(schema).parquet(f"{self.folder}/v{version}/{name}") if version else self.spark.createDataFrame([], schema)

    def edges(self) -> DataFrame:
        return self.table("edges", EDGES)

    def inlinks(self) -> DataFrame:
        return self.table("inlinks", INLINKS)

    def update(self, files: DataFrame) -> dict[str, int]:
        """Takes in the present files (path, raw) of a wiki. Returns how many pages were parsed, and how many edges made, of how many."""
        was = self.version()
        old, old_edges, old_inlinks = self.table("facts", FACTS, was), self.table("edges", EDGES, was), self.table("inlinks", INLINKS, was)
        now = was + 1
        out = f"{self.folder}/v{now}"
        # One pass over the files: of those that are as they were only path and digest are written.
        digest = F.sha2("raw", 256)
        met = files.select("path", digest.alias("digest"), "raw").join(old.select("path", "digest", F.lit(True).alias("same")), ["path", "digest"], "left")
        met.select("path", "digest", F.col("same").isNotNull().alias("same"), F.when(F.col("same").isNull(), F.col("raw")).alias("raw")).write.mode("overwrite").parquet(f"{out}/seen")
        seen = self.spark.read.schema("path string, digest string, same boolean, raw string").parquet(f"{out}/seen")
        self._facts(seen.where("NOT same").select("path", "digest", "raw")).write.mode("overwrite").parquet(f"{out}/edited")
        new = self.spark.read.schema(FACTS).parquet(f"{out}/edited")
        kept = old.join(seen.where("same").select("path", "digest"), ["path", "digest"], "left_semi")
        kept.unionByName(new).write.mode("overwrite").parquet(f"{out}/facts")
        facts = self.spark.read.schema(FACTS).parquet(f"{out}/facts")
        gone = old.join(facts.select("path", "digest"), ["path", "digest"], "left_anti")
        touched = gone.unionByName(new)

        # Edges: of edited pages, of links to names that came or went, and of pages that share a source's spelling with these.
        names_then, names_now = graph.page_names(old), graph.page_names(facts)
        moved = names_then.exceptAll(names_now).unionByName(names_now.exceptAll(names_then)).select("key").distinct()
        sources = P.wiki(facts).select("stem", F.explode(F.transform("links", lambda x: T.folded(x["target"]))).alias("key")).join(moved, "key", "left_semi")
        anew = P.wiki(touched).select(F.lower("stem").alias("low")).unionByName(sources.select(F.lower("stem").alias("low"))).distinct()
        typed = P.wiki(facts).join(anew, F.lower("stem") == F.col("low"), "left_semi").select(F.col("stem").alias("source"), F.inline("links"))
        graph.edges_of(typed, names_now).select(*old_edges.columns).write.mode("overwrite").parquet(f"{out}/made")
        made = self.spark.read.schema(EDGES).parquet(f"{out}/made")
        old_edges.join(anew, F.lower("source") == F.col("low"), "left_anti").unionByName(made).write.mode("overwrite").parquet(f"{out}/edges")

        # Inlinks: of what edited pages link or linked to, and of names that came or went.
        aims = P.wiki(touched).select(F.explode("targets").alias("t")).select(F.lower("t").alias("low")).unionByName(P.wiki(touched).select(F.lower("stem").alias("low"))).distinct()
        pages = P.wiki(facts)
        links = pages.select(F.col("stem").alias("source"), F.explode("targets").alias("t")).select("source", F.lower("t").alias("low")).join(aims, "low", "left_semi")
        found = links.join(pages.select("stem", F.lower("stem").alias("low")), "low").select("stem", "source").distinct()
        old_inlinks.join(aims, F.lower("stem") == F.col("low"), "left_anti").unionByName(found).write.mode("overwrite").parquet(f"{out}/inlinks")
        self.spark.createDataFrame([(now,)], "version int").write.mode("append").json(f"{self.folder}/present")
        return {"pages": facts.count(), "parsed": new.count(), "edges": self.edges().count(), "made": made.count()}

    @staticmethod
    def _facts(files: DataFrame) -> DataFrame:
        """FACTS of files (path, digest, raw)."""
        none = F.array().cast("array<struct<pos:int,target:string,rel:string>>")
        links = F.when(F.col("dir").isin("concepts", "entities"), graph.typed_link_array(F.col("content"), F.col("related_concepts"))).otherwise(none)
        return markdown.parsed(files).select("path", "digest", "dir", "stem", links.alias("links"), F.array_distinct(T.link_targets(F.col("content"))).alias("targets"))
