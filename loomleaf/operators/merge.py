"""Duplicates, promotion of drafts, and merging pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import ranks
from ..plans.stages import cut
from . import pages as P


def by_title(pages: DataFrame) -> DataFrame:
    """page_a, page_b, reason: pages of one normalised name, each with the first of them (a group's pairs follow from these)."""
    named = P.by_stem(pages).select("stem", T.normal_name(F.col("stem")).alias("key"))
    first = named.groupBy("key").agg(F.min("stem").alias("first"))
    return named.join(first, "key").where("stem <> first").select(F.col("first").alias("page_a"), F.col("stem").alias("page_b"), F.lit("title_similarity").alias("reason"))


def by_alias(pages: DataFrame) -> DataFrame:
    """page_a, page_b, reason: pages that share an alias, or one's alias is the other's name; each with the first page of the shared name. Pages of one name aren't told again."""
    aliases = F.coalesce("aliases", F.array().cast("array<string>"))
    keys = F.array_distinct(F.concat(F.array(T.normal_name(F.col("stem"))), F.transform(aliases, T.normal_name)))
    each = P.by_stem(pages).select("stem", T.normal_name(F.col("stem")).alias("own"), F.explode(keys).alias("key"))
    first = each.groupBy("key").agg(F.min(F.struct("stem", "own")).alias("f"))
    met = each.join(first, "key").where("stem <> f.stem AND own <> f.own")
    return met.select(F.col("f.stem").alias("page_a"), F.col("stem").alias("page_b"), F.lit("alias_overlap").alias("reason")).distinct()


def joined(old: Column, new: Column) -> Column:
    """What both arrays hold, in order of first occurrence."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(old, none), F.coalesce(new, none)))


def promotable(drafts: DataFrame, issues: DataFrame) -> DataFrame:
    """Those drafts of concepts and entities that have no errors, with the folder that they go to."""
    bad = issues.where("severity = 'ERROR'").select(F.col("page").alias("stem")).distinct()
    going = drafts.where("type IN ('concept', 'entity')").join(bad, "stem", "left_anti")
    return going.withColumn("dir", F.when(F.col("type") == "entity", "entities").otherwise("concepts"))


def promoted(drafts: DataFrame, pages: DataFrame, issues: DataFrame) -> DataFrame:
    """pages with those drafts that have no errors, as concepts or entities by type; a draft's head and content take the place of an existing page's, but sources of both stay."""
    going = promotable(drafts, issues)
    stays = pages.where("dir <> 'drafts'")
    old = stays.select(F.col("dir").alias("d_"), F.col("stem").alias("s_"), F.col("source_refs").alias("old_"))
    met = going.join(old, (going["dir"] == old["d_"]) & (going["stem"] == old["s_"]), "left")
    updates = {"source_refs": joined(F.col("old_"), F.col("source_refs")), "content_hash": T.content_hash(F.col("content")), "path": F.concat("dir", F.lit("/"), "stem", F.lit(".md"))}
    new = met.withColumns(updates).select(*pages.columns)
    return stays.join(new.select("dir", "stem"), ["dir", "stem"], "left_anti").select(*pages.columns).unionByName(new)


def rewritten(content: Column, old: str, new: str) -> Column:
    """A text whose links to one page lead to another; what they show stays."""
    import re

    return F.regexp_replace(content, r"\[\[" + re.escape(old) + r"(\|[^\]]+)?\]\]", "[[" + new.replace("\\", "\\\\").replace("$", "\\$") + "$1]]")


def merged(pages: DataFrame, primary: str, secondary: str, today: str) -> DataFrame:
    """pages without the secondary page, whose text, aliases, sources and tags the primary takes over, and with all links to it led there."""
    other = pages.where(F.col("stem") == secondary).limit(1).select(*(F.col(c).alias(f"{c}_2") for c in ("stem", "title", "content", "aliases", "source_refs", "tags")))
    met = pages.where(F.col("stem") != secondary).join(F.broadcast(other), F.col("stem") == primary, "left")
    there = F.col("stem_2").isNotNull()
    body, extra = F.col("content"), F.col("content_2")
    text = F.when(there & ~F.contains(body, T.strip(extra)), F.concat(F.regexp_replace(body, r"\s+$", ""), F.lit(f"\n\n## Merged from {secondary}\n\n"), T.strip(extra))).otherwise(body)
    names = F.filter(F.array(F.col("title_2"), F.col("stem_2")), lambda x: x.isNotNull())
    updates = {
        "content": text,
        "aliases": F.when(there, F.filter(joined(F.col("aliases"), joined(F.col("aliases_2"), names)), lambda a: a != F.col("stem"))).otherwise(F.col("aliases")),
        "source_refs": F.when(there, joined(F.col("source_refs"), F.col("source_refs_2"))).otherwise(F.col("source_refs")),
        "tags": F.when(there, joined(F.col("tags"), F.col("tags_2"))).otherwise(F.col("tags")),
        "last_updated": F.when(there, F.lit(today)).otherwise(F.col("last_updated")),
    }
    done = met.withColumns(updates).withColumn("content", rewritten(F.col("content"), secondary, primary))
    return done.select(*pages.columns)


def roots(mapping: DataFrame) -> DataFrame:
    """secondary, primary, depth of a mapping's last ends: chains are followed, and of a cycle the page that is first by name is the end.

    mapping: secondary, primary; of several primaries of one page the first by name counts. Steps are doubled until
    nothing moves, so that chains and cycles of up to n pages take some log2(n) joins, however many pages there are.
    Joins are by sorting: no table goes through the driver.
    """
    given = cut(mapping.where("secondary <> primary").groupBy("secondary").agg(F.min("primary").alias("primary")))
    ends = given.select(F.col("primary").alias("secondary")).distinct().join(given.hint("merge"), "secondary", "left_anti")
    # to: the page so many steps on; least: the first by name of those passed; far: steps until the end of a chain; moved: whether least changed.
    now = given.select(F.col("secondary").alias("page"), F.col("primary").alias("to"), F.col("secondary").alias("least"), F.lit(1).cast("long").alias("far"), F.lit(True).alias("moved"))
    now = cut(now.unionByName(ends.select(F.col("secondary").alias("page"), F.col("secondary").alias("to"), F.col("secondary").alias("least"), F.lit(0).cast("long").alias("far"), F.lit(False).alias("moved"))))
    aims = None
    while True:
        # As many pages are led to as a round before: all these are ends, or lie on cycles. No least changed: each cycle was passed whole.
        was, (aims, moved) = aims, now.agg(F.count_distinct("to"), F.count_if("moved")).first()
        if aims == was and not moved:
            break
        ahead = now.select(F.col("page").alias("to"), F.col("to").alias("to_2"), F.col("least").alias("least_2"), F.col("far").alias("far_2"))
        met = now.join(ahead.hint("merge"), "to")
        now = cut(met.select("page", F.col("to_2").alias("to"), F.least("least", "least_2").alias("least"), (F.col("far") + F.col("far_2")).alias("far"), (F.col("least_2") < F.col("least")).alias("moved")))
    # Each page's `to` is at the end, or within the cycle, all of which lies ahead of it.
    last = now.select(F.col("page").alias("to"), F.col("least").alias("first"), (F.col("far") == 0).alias("ends"))
    found = now.join(last.hint("merge"), "to").select(F.col("page").alias("secondary"), F.when(F.col("ends"), F.col("to")).otherwise(F.col("first")).alias("primary"), F.col("far").alias("depth"))
    return found.where("secondary <> primary")


def relinked(pages: DataFrame, leads: DataFrame) -> DataFrame:
    """pages whose links to a page (leads: secondary) lead to another (primary); what they show stays. Each text is rebuilt once, whatever the number of its targets."""
    each = pages.select("dir", "stem", F.explode(F.array_distinct(T.link_targets(F.col("content")))).alias("secondary")).join(leads.select("secondary", "primary"), "secondary")
    news = each.groupBy("dir", "stem").agg(F.map_from_entries(F.collect_list(F.struct("secondary", "primary"))).alias("leads_"))

    def rebuilt(places: Column) -> Column:
        whole = lambda p: F.when(F.element_at("leads_", p["target"]).isNull(), p["link"]).otherwise(F.concat(F.lit("[["), F.element_at("leads_", p["target"]), F.substring(p["link"], F.char_length(p["target"]) + 3, F.char_length(p["link"]))))
        return F.array_join(F.transform(places, lambda p: F.concat(p["part"], F.coalesce(whole(p), F.lit("")))), "")

    parts = F.arrays_zip(F.split("content", T.LINK, -1).alias("part"), F.regexp_extract_all("content", F.lit(T.LINK), F.lit(0)).alias("link"), T.link_targets(F.col("content")).alias("target"))
    met = pages.join(news, ["dir", "stem"], "left")
    return met.withColumn("content", F.when(F.col("leads_").isNull(), F.col("content")).otherwise(rebuilt(parts))).select(*pages.columns)


def merged_all(pages: DataFrame, mapping: DataFrame, today: str) -> DataFrame:
    """pages after many merges at once (mapping: secondary, primary): secondary pages are gone, each chain's or cycle's end has their texts, nearest first and then by name, their aliases, names, sources and tags, and all links lead there. A primary that is no page keeps its secondaries."""
    leads = cut(roots(mapping).join(pages.select(F.col("stem").alias("primary")).distinct(), "primary"))
    rest = ("title", "content", "aliases", "source_refs", "tags")
    gone = pages.join(leads, F.col("stem") == F.col("secondary")).select("primary", F.struct("depth", "stem", "dir", *rest).alias("page"))
    gathered = gone.groupBy("primary").agg(F.array_sort(F.collect_list("page")).alias("others"))
    stays = pages.join(leads.select(F.col("secondary").alias("stem")), "stem", "left_anti").join(gathered, F.col("stem") == F.col("primary"), "left")

    def text(so_far: Column, page: Column) -> Column:
        body = T.strip(F.coalesce(page["content"], F.lit("")))
        return F.when(F.contains(so_far, body), so_far).otherwise(F.concat(F.regexp_replace(so_far, r"\s+$", ""), F.lit("\n\n## Merged from "), page["stem"], F.lit("\n\n"), body))

    def all_of(name: str) -> Column:
        return F.flatten(F.transform("others", lambda p: F.coalesce(p[name], F.array().cast("array<string>"))))

    there = F.col("others").isNotNull()
    names = F.flatten(F.transform("others", lambda p: F.concat(F.coalesce(p["aliases"], F.array().cast("array<string>")), F.filter(F.array(p["title"], p["stem"]), lambda x: x.isNotNull()))))
    updates = {
        "content": F.aggregate("others", F.coalesce("content", F.lit("")), text), "aliases": F.filter(joined(F.col("aliases"), names), lambda a: a != F.col("stem")),
        "source_refs": joined(F.col("source_refs"), all_of("source_refs")), "tags": joined(F.col("tags"), all_of("tags")), "last_updated": F.lit(today),
    }
    done = stays.withColumns({c: F.when(there, v).otherwise(F.col(c)) for c, v in updates.items()}).select(*pages.columns)
    return relinked(done, leads)


def registered(incoming: DataFrame, manifest: DataFrame, at: str) -> DataFrame:
    """New manifest rows for sources (filename, text) whose content no row and no earlier source of the batch has."""
    keyed = incoming.select("filename", T.source_type(F.col("filename")).alias("source_type"), T.content_hash(F.col("text")).alias("content_hash"))
    first = keyed.groupBy("content_hash").agg(F.min(F.struct("filename", "source_type")).alias("f")).select("f.filename", "f.source_type", "content_hash")
    new = first.join(manifest.select("content_hash"), "content_hash", "left_anti")
    return new.select("filename", "source_type", "content_hash", F.lit(at).alias("ingested_at"), F.lit("ingested").alias("status"))


def ingested(incoming: DataFrame, manifest: DataFrame) -> DataFrame:
    """filename, known: whether the manifest holds a source's content already."""
    held = manifest.select("content_hash", F.lit(True).alias("known")).distinct()
    return incoming.select("filename", T.content_hash(F.col("text")).alias("content_hash")).join(held, "content_hash", "left").select("filename", "content_hash", F.coalesce("known", F.lit(False)).alias("known"))


def register(sources: DataFrame) -> DataFrame:
    """Of documents with equal content the first: doc_id, content_hash, copies."""
    return sources.groupBy(T.content_hash(F.col("text")).alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("copies"))


def index_by(pages: DataFrame, key: Column) -> DataFrame:
    """key, n, first_stem, last_stem of each group of concepts and entities; key may be an array."""
    return P.by_stem(pages).select("stem", key.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("stem").alias("first_stem"), F.max("stem").alias("last_stem"))


def listed(pages: DataFrame, key: Column) -> DataFrame:
    """key, ord, line: the lines of an index page, sorted."""
    each = P.by_stem(pages).select("stem", key.alias("key"))
    return ranks.numbered(each, "ord", ["stem"], ("key",)).select("key", "ord", F.concat(F.lit("- [["), "stem", F.lit("]]")).alias("line"))


def types() -> Column:
    return F.coalesce("type", F.lit("unknown"))


def exploded(column: str, missing: str) -> Column:
    values = F.coalesce(column, F.array().cast("array<string>"))
    return F.explode(F.when(F.size(values) == 0, F.array(F.lit(missing))).otherwise(values))


def timeline(pages: DataFrame, least: int = 5) -> DataFrame:
    """month, ord, stem, title, created: pages by date of creation, if there are `least` of them in all."""
    dated = P.wiki(pages).where("created IS NOT NULL")
    total = dated.agg(F.count(F.lit(1)).alias("total"))
    found = dated.withColumn("month", F.substring("created", 1, 7)).join(F.broadcast(total), F.col("total") >= least)
    return ranks.numbered(found, "ord", ["created", "stem", "title"], ("month",)).select("month", "ord", "stem", F.coalesce("title", "stem").alias("title"), "created")


def recently_updated(pages: DataFrame, today: str, days: int = 7) -> DataFrame:
    """date, stem of pages updated (or else created) in the last days, latest first."""
    date = F.coalesce("last_updated", "created")
    since = F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")
    return P.by_stem(pages).select(date.alias("date"), "stem").where(F.col("date") >= since).orderBy(F.desc("date"), F.desc("stem"))
