"""Links, the typed graph, and what is asked of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import ranks
from ..plans.stages import cut
from . import pages as P


def links(pages: DataFrame) -> DataFrame:
    """source, pos, target, rel: a row for each link of each page's content."""
    return pages.select(F.col("stem").alias("source"), F.posexplode(T.relations(F.col("content"))).alias("pos", "l")).select("source", "pos", "l.target", "l.rel")


def typed_links(pages: DataFrame) -> DataFrame:
    """As links; an entry [[page]]:type of the head's related_concepts takes the place of all links to the same target."""
    head = pages.select(F.col("stem").alias("source"), F.posexplode("related_concepts").alias("pos", "entry"))
    head = head.select("source", "pos", F.regexp_extract("entry", T.TYPED_ENTRY, 1).alias("target"), F.regexp_extract("entry", T.TYPED_ENTRY, 2).alias("rel")).where("target <> ''")
    last = F.row_number().over(Window.partitionBy("source", "target").orderBy(F.desc("pos")))
    head = head.withColumn("nth", last).where("nth = 1").select("source", (F.col("pos") + (1 << 24)).alias("pos"), "target", "rel")
    return links(pages).join(head.select("source", "target"), ["source", "target"], "left_anti").select("source", "pos", "target", "rel").unionByName(head)


def typed_link_array(content: Column, related: Column) -> Column:
    """Array of (pos, target, rel): the typed links of one page, as `typed_links`, without a shuffle."""
    entries = F.transform(F.coalesce(related, F.array().cast("array<string>")), lambda e, i: F.struct((i + (1 << 24)).alias("pos"), F.regexp_extract(e, T.TYPED_ENTRY, 1).alias("target"), F.regexp_extract(e, T.TYPED_ENTRY, 2).alias("rel")))

    def last(head: Column) -> Column:
        return T.held(F.reverse(F.transform(head, lambda h: h["target"])), lambda back: F.filter(head, lambda h, i: F.array_position(back, h["target"]) == F.size(back) - i))

    def joint(head: Column) -> Column:
        own = F.transform(T.relations(F.coalesce(content, F.lit(""))), lambda l, i: F.struct(i.alias("pos"), l["target"].alias("target"), l["rel"].alias("rel")))
        return F.concat(T.held(F.transform(head, lambda h: h["target"]), lambda names: F.filter(own, lambda l: ~F.array_contains(names, l["target"]))), last(head))

    return T.held(F.filter(entries, lambda h: h["target"] != ""), joint)


def page_names(pages: DataFrame) -> DataFrame:
    """key, stem: by what links meet concepts and entities."""
    return P.wiki(pages).groupBy(T.folded(F.col("stem")).alias("key")).agg(F.max_by("stem", F.struct("dir", "stem")).alias("stem"))


def edges(pages: DataFrame) -> DataFrame:
    """source, target (a page's stem where there is one), type, weight, pos; of equal edges the first."""
    return edges_of(typed_links(P.wiki(pages)), page_names(pages))


def edges_of(typed: DataFrame, names: DataFrame) -> DataFrame:
    """The edges of links (source, pos, target, rel) to pages (names: key, stem)."""
    joined = typed.withColumn("key", T.folded(F.col("target"))).join(names, "key", "left")
    resolved = joined.select("source", "pos", F.coalesce("stem", "target").alias("target"), F.col("rel").alias("type"))
    keys = [F.lower(c).alias(f"k{i}") for i, c in enumerate(("source", "target", "type"))]
    first = resolved.groupBy(*keys).agg(F.min(F.struct("source", "pos", "target", "type")).alias("e"))
    return first.select("e.source", "e.target", "e.type", T.weight(F.col("e.type")).alias("weight"), "e.pos")


def edges_from(pages: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For `traverse`: a function that gives the edges that leave some nodes (node). Only these nodes' pages are parsed."""

    def found(nodes: DataFrame) -> DataFrame:
        low = nodes.select(F.lower("node").alias("low")).distinct()
        some = P.wiki(pages).join(low, F.lower("stem") == F.col("low"), "left_semi")
        return edges_of(typed_links(cut(some.select("stem", "content", "related_concepts"))), page_names(pages))

    return found


def nodes(pages: DataFrame) -> DataFrame:
    """id, type, path, confidence of the graph's pages."""
    return P.named(pages).select(F.col("stem").alias("id"), F.coalesce("type", F.lit("unknown")).alias("type"), "path", "confidence")


def untyped(pages: DataFrame) -> DataFrame:
    """source, target of all links of all pages, head included, repeats kept."""
    names = pages.groupBy(F.lower("stem").alias("key")).agg(F.max("stem").alias("stem"))
    found = pages.select(F.col("stem").alias("source"), F.explode(T.link_targets(P.raw(pages))).alias("target")).withColumn("key", F.lower("target"))
    return found.join(names, "key", "left").select("source", F.coalesce("stem", "target").alias("target"))


#: Links to a list of neighbours.
NEIGHBOURS = 1_000


def linked(pages: DataFrame) -> DataFrame:
    """stem, source: a row for each page that links to another, repeats kept."""
    names = P.wiki(pages).select("stem", F.lower("stem").alias("key"))
    found = P.wiki(pages).select(F.col("stem").alias("source"), F.explode(F.array_distinct(T.link_targets(F.col("content")))).alias("target"))
    return found.withColumn("key", F.lower("target")).join(names, "key").select("stem", "source")


def inlink_chunks(pages: DataFrame, size: int = NEIGHBOURS) -> DataFrame:
    """stem, chunk, n, sources: the distinct pages that link to each page, sorted, in lists of `size` at most, so that no task holds all neighbours of a hub."""
    return ranks.chunks(linked(pages), "stem", "source", size).withColumnRenamed("values", "sources")


def inlinks(pages: DataFrame) -> DataFrame:
    """stem, inlinks (count), sources: the distinct pages that link to each page, sorted. For hubs see inlink_chunks."""
    return linked(pages).groupBy("stem").agg(F.countDistinct("source").alias("inlinks"), F.array_sort(F.collect_set("source")).alias("sources"))


def missing_reverse(pages: DataFrame, all_edges: DataFrame | None = None) -> DataFrame:
    """Typed edges A to B without any edge from B to A."""
    all_edges = edges(pages) if all_edges is None else all_edges
    back = all_edges.select(F.col("target").alias("source"), F.col("source").alias("target")).distinct()
    return all_edges.where("type <> 'neutral'").join(back, ["source", "target"], "left_anti").select("source", "target", "type")


def missing(found: DataFrame, names: DataFrame) -> DataFrame:
    """Of links (source, target) the distinct ones whose target is no name (column stem)."""
    keys = names.select(F.lower("stem").alias("key")).distinct()
    return found.select("source", "target").distinct().withColumn("key", F.lower("target")).join(keys, "key", "left_anti").select("source", "target")


def gaps(pages: DataFrame) -> DataFrame:
    """source, target of links in any page's content to pages that don't exist."""
    return missing(pages.select(F.col("stem").alias("source"), F.explode(T.link_targets(F.col("content"))).alias("target")), pages)


def traverse(seeds: DataFrame, all_edges: DataFrame | Callable[[DataFrame], DataFrame], depth: int, start: float = 10.0) -> DataFrame:
    """node, score, path, ord: seeds (stem, ord) spread along out-edges, `depth` times.

    In each layer the candidates of a target are folded in the order of layer and edge: one that exceeds the target's
    score so far is added to it, its path becomes the target's, and it goes on in the next layer. Targets don't touch
    each other within a layer. A node also follows the edges of a page whose stem is its own in lower case, after its own.

    Only candidates above all before them can be accepted, so that each task first drops those that can't be: a hub
    gathers a few strictly rising candidates, however many edges lead to it.

    all_edges: the graph, or a function from nodes to the edges that leave them (`edges_from`), called for each layer.
    """
    seeds, given = cut(seeds), all_edges
    if not callable(given):
        all_edges = cut(given.select("source", "target", "type", "weight", "pos"))
    first = seeds.select(F.col("stem").alias("node"), F.lit(start).alias("score"), F.array("stem").alias("path"), F.array(F.col("ord").cast("long")).alias("ord"))
    visited = layer = first
    for d in range(depth):
        if callable(given):
            all_edges = cut(given(layer.select("node")).select("source", "target", "type", "weight", "pos"))
        outward = all_edges.select("source", "target", "weight", F.array(F.lit(0).cast("long"), F.col("pos").cast("long"), F.xxhash64("target", "type")).alias("at"))
        own = layer.join(outward, layer["node"] == outward["source"])
        other = layer.where(F.lower("node") != F.col("node")).join(outward, F.lower("node") == F.col("source")).withColumn("at", F.concat(F.array(F.lit(1).cast("long")), F.slice("at", 2, 2)))
        both = own.unionByName(other).join(visited.select(F.col("node").alias("to"), F.col("score").alias("had")), F.col("target") == F.col("to"), "left")
        candidates = both.select("target", (F.col("score") * F.col("weight") / F.lit(float(d + 1))).alias("new"), F.concat("ord", "at").alias("at"), F.concat("path", F.array("target")).alias("path"), "had")
        # Strictly rising maxima, first within a share of the candidates, then over all shares.
        dealt = candidates.where("had IS NULL OR new > had").withColumn("share", F.pmod(F.xxhash64("at"), F.lit(64)))
        for by in (("target", "share"), ("target",)):
            before = F.max("new").over(Window.partitionBy(*by).orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
            dealt = dealt.withColumn("before", before).where("before IS NULL OR new > before").drop("before")
        grouped = dealt.groupBy("target").agg(F.array_sort(F.collect_list(F.struct("at", "new", "path"))).alias("found"), F.first("had").alias("had"))
        kept = F.array().cast("array<struct<at:array<bigint>,new:double,path:array<string>>>")
        folded = F.aggregate(
            "found", F.struct(F.col("had").alias("score"), kept.alias("sent")),
            lambda a, c: F.when(a["score"].isNull() | (c["new"] > a["score"]), F.struct((F.coalesce(a["score"], F.lit(0.0)) + c["new"]).alias("score"), F.concat(a["sent"], F.array(c)).alias("sent"))).otherwise(a),
        )
        met = cut(grouped.select("target", folded.alias("f")))
        layer = met.select(F.col("target").alias("node"), F.explode("f.sent").alias("s")).select("node", F.col("s.new").alias("score"), "s.path", F.col("s.at").alias("ord"))
        again = met.join(visited.select("node", F.col("ord").alias("seen")), met["target"] == F.col("node"), "left")
        moved = again.select(F.col("target").alias("node"), F.col("f.score").alias("score"), F.element_at("f.sent", -1)["path"].alias("path"), F.coalesce("seen", F.get("f.sent", F.lit(0))["at"]).alias("ord"))
        visited = cut(visited.join(met, visited["node"] == met["target"], "left_anti").unionByName(moved))
    return visited


def reached(seeds: DataFrame, all_edges: DataFrame | Callable[[DataFrame], DataFrame], names: DataFrame, depth: int = 2) -> DataFrame:
    """rank, stem, score (two decimals), path of the existing pages (names: stem) that a traversal reaches, best first; without edges the seeds."""
    found = traverse(seeds, all_edges, depth)
    best = found.join(names.select("stem").distinct(), F.col("node") == F.col("stem"))
    placed = ranks.numbered(best.withColumn("length", F.size("ord")), "rank", [F.desc("score"), "length", "ord", "stem"])
    return placed.select("rank", "stem", F.bround("score", 2).alias("score"), "path")
