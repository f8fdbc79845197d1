"""Structural rules on pages. All are decided on one scan: facts() computes what each rule needs, once, as a narrow table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.constitution import Constitution
from ..plans.stages import cut
from . import pages as P
from . import provenance

ISSUE = "struct<check_ord:int,severity:string,code:string,message:string>"
# The rules in the order in which they are reported.
ORDER = ("BROKEN_LINK", "ORPHAN_PAGE", "MISSING_FRONTMATTER", "INVALID_TYPE", "NO_SOURCES", "LOW_CONNECTIVITY", "STALE_PAGE", "UNRESOLVED_CONTRADICTION", "EMPTY_SECTION", "DUPLICATE_CONCEPT", "UNMARKED_INFERENCE", "MISSING_CONTENT_HASH")
ERRORS = ("MISSING_FRONTMATTER", "INVALID_TYPE", "DUPLICATE_CONCEPT", "MISSING_CONTENT_HASH")
FIELD_NAMES = ("title", "type", "confidence", "entity_type", "created", "last_updated", "source_refs", "content_hash", "tags", "aliases", "related_concepts")


def _issue(code: str, message: Column | str) -> Column:
    severity = "ERROR" if code in ERRORS else "WARNING"
    return F.struct(F.lit(ORDER.index(code) if code in ORDER else 0).alias("check_ord"), F.lit(severity).alias("severity"), F.lit(code).alias("code"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def _if(condition: Column, issue: Column) -> Column:
    return F.when(condition, F.array(issue)).otherwise(F.array().cast(f"array<{ISSUE}>"))


def _body(name: str) -> Column:
    """The body of a section (of the array s), null if there is none."""
    return F.get(F.filter("s", lambda x: x["heading"] == name), F.lit(0))["body"]


def unmarked(body: Column) -> Column:
    """Whether a section has a paragraph, not marked as an inference, with a claim that cites nothing."""
    skipped = r"^(#|---|> \[!|[-*]\s*\[source:|[-*]\s*\[\[|[-*]\s*$)"

    def claims(paragraph: Column) -> Column:
        lines = F.transform(F.split(paragraph, "\n", -1), T.strip)
        return ~paragraph.rlike(r"(?m)^>\s*\[!note\]\s*Inference:") & F.exists(lines, lambda l: (F.char_length(l) > 10) & ~l.rlike(skipped) & ~l.rlike(T.ANY_SOURCE))

    return F.exists(F.transform(F.split(body, r"\n\s*\n", -1), T.strip), claims)


def missing_fields(rules: Constitution, wording: str) -> Column:
    """Issues of the head: no type, an unknown type, or fields that its type needs."""
    kinds = rules.types()
    needed = [_if(F.lit(False), _issue("MISSING_FRONTMATTER", ""))]
    for kind in kinds:
        for field in rules.fields(kind):
            absent = F.col(field).isNull() if field in FIELD_NAMES else F.lit(True)
            needed.append(_if((F.col("type") == kind) & absent, _issue("MISSING_FRONTMATTER", f"{wording}: {field}")))
    unknown = F.concat(F.lit("Unknown page type: '"), "type", F.lit(f"'. Valid types: {', '.join(kinds)}"))
    no_type = F.coalesce("type", F.lit("")) == ""
    return F.when(no_type, F.array(_issue("MISSING_FRONTMATTER", "Missing required field: type"))).when(~F.col("type").isin(*kinds), F.array(_issue("INVALID_TYPE", unknown))).otherwise(F.concat(*needed))


def facts(pages: DataFrame, rules: Constitution | None = None) -> DataFrame:
    """What rules need of each page: stem, dir, type, generated, targets of its links, n_links, norm, alias_norms, found (issues that the page alone decides). A written table."""
    rules = rules or Constitution()
    raw, least = P.raw(pages), rules.least_links()
    kept = pages.select("stem", "dir", "path", *FIELD_NAMES, F.coalesce("content", F.lit("")).alias("content"), raw.alias("raw_"))
    kept = kept.withColumns({"generated": P.is_index(), "s": T.sections(F.col("content")), "targets": T.link_targets(F.col("raw_"))})
    n, body = F.size("targets"), F.col("content")
    refs = F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) > 0
    empty = F.get(F.filter("s", lambda x: x["body"] == ""), F.lit(0))["heading"]
    placeholder = F.contains("raw_", F.lit("*To be documented*")) | F.contains("raw_", F.lit("*To be expanded*"))
    facts_only = {k: [n for n, r in rules.section_rules(k).items() if r == "facts_only"] for k in rules.types()}
    cited_sources = F.exists("s", lambda x: (x["heading"] == "Sources") & x["body"].rlike(T.ANY_SOURCE))

    def inference(kind: str, name: str) -> Column:
        section = _body(name)
        there = (F.col("type") == kind) & (F.coalesce(section, F.lit("")) != "")
        no_citation = _issue("UNMARKED_INFERENCE", f"Facts-only section '{name}' has no source citations and relies on page-level provenance — consider adding inline [source: ...] citations for traceability")
        claim = _issue("UNMARKED_INFERENCE", f"Possible unmarked inference in facts_only section '{name}': claims without [source: ...] citation")
        whole = refs & cited_sources
        return F.concat(_if(there & whole & ~section.rlike(T.ANY_SOURCE), no_citation), _if(there & ~whole & unmarked(section), claim))

    proper = ~F.col("generated")
    own = [
        F.when(proper, missing_fields(rules, "Missing required field")),
        _if(proper & ~F.coalesce(F.col("type").isin("index", "timeline"), F.lit(False)) & ~F.col("raw_").rlike(f"(?i){T.ANY_SOURCE}") & ~refs, _issue("NO_SOURCES", "Page contains no source citations")),
        _if(proper & (F.col("type") == "concept") & (n < least), _issue("LOW_CONNECTIVITY", F.concat(F.lit("Concept page has only "), n.cast("string"), F.lit(f" outgoing links (minimum: {least})")))),
        _if(F.contains(body, F.lit("> [!warning] CONTRADICTION")) & F.contains(body, F.lit("Status:** UNRESOLVED")), _issue("UNRESOLVED_CONTRADICTION", "Contains unresolved contradiction(s)")),
        F.when(proper & placeholder, F.array(_issue("EMPTY_SECTION", "Contains placeholder content that needs expansion"))).when(proper & empty.isNotNull(), F.array(_issue("EMPTY_SECTION", F.concat(F.lit("Empty required section: "), empty)))),
        *(F.when(proper, inference(k, s)) for k, names in facts_only.items() for s in names),
    ]
    found = F.flatten(F.transform(F.array(*own), lambda x: F.coalesce(x, F.array().cast(f"array<{ISSUE}>"))))
    aliases = F.array_distinct(F.transform(F.coalesce("aliases", F.array().cast("array<string>")), T.normal_name))
    return cut(kept.select("stem", "dir", "type", "generated", "targets", n.alias("n_links"), T.normal_name(F.col("stem")).alias("norm"), aliases.alias("alias_norms"), found.alias("found")))


def _rows(df: DataFrame, code: str, message: Column) -> DataFrame:
    return df.select(_issue(code, message).alias("i"), F.col("stem").alias("page")).select("i.check_ord", "i.severity", "i.code", "page", "i.message")


def broken_links(known: DataFrame, names: DataFrame | None = None, wording: tuple[str, str] = ("Links to [[", "]] which does not exist")) -> DataFrame:
    names = (known if names is None else names).select(F.lower("stem").alias("key")).distinct()
    found = known.select("stem", F.explode(F.array_distinct("targets")).alias("target")).withColumn("key", F.lower("target"))
    return _rows(found.join(names, "key", "left_anti"), "BROKEN_LINK", F.concat(F.lit(wording[0]), "target", F.lit(wording[1])))


def targets(pages: DataFrame) -> DataFrame:
    """stem, targets: what `broken_links` needs of facts, for those who ask for nothing else."""
    own = P.linted(pages)
    return own.select("stem", T.link_targets(P.raw(own)).alias("targets"))


def orphans(known: DataFrame) -> DataFrame:
    linked = known.select(F.explode("targets").alias("target")).select(F.lower("target").alias("key")).distinct()
    lonely = known.where("NOT generated AND n_links = 0").withColumn("key", F.lower("stem"))
    return _rows(lonely.join(linked, "key", "left_anti"), "ORPHAN_PAGE", F.lit("Page has 0 inlinks and 0 outlinks — isolated node"))


def duplicates(known: DataFrame) -> DataFrame:
    """Pages of one normalised name, then pages of one alias that aren't among them; the others' names in order, from the first WITH at most."""
    proper = known.where("NOT generated")

    def grouped(each: DataFrame, wording: str) -> DataFrame:
        # Of a group's names the few first are told, so that no group is gathered.
        firsts = each.groupBy("key").agg(F.countDistinct("stem").alias("n"), F.min("stem").alias("least"))
        ranked = each.join(firsts.where("n > 1"), "key")
        second = ranked.where("stem <> least").groupBy("key").agg(F.min("stem").alias("second"))
        told = ranked.join(second, "key").select("stem", "key", F.when(F.col("stem") == F.col("least"), F.col("second")).otherwise(F.col("least")).alias("other"), (F.col("n") - 2).alias("more"))
        first = told.groupBy("stem").agg(F.min(F.struct("key", "other", "more")).alias("t"))
        more = F.when(F.col("t.more") > 0, F.concat(F.lit(" and "), F.col("t.more").cast("string"), F.lit(" more"))).otherwise("")
        return first.select("stem", F.concat(F.lit(wording), "t.other", more).alias("message"))

    by_name = grouped(proper.select("stem", F.col("norm").alias("key")), "Possible duplicate of: ")
    by_alias = grouped(proper.select("stem", F.explode("alias_norms").alias("key")).distinct(), "Alias overlaps with: ")
    both = by_name.unionByName(by_alias.join(by_name.select("stem"), "stem", "left_anti"))
    return _rows(both, "DUPLICATE_CONCEPT", F.col("message"))


def stale(known: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    found = provenance.stale_pages(sidecars, files).join(known.select("stem").distinct(), "stem", "left_semi")
    return _rows(found, "STALE_PAGE", F.concat(F.lit("Source content changed: "), F.array_join("files", ", ")))


def missing_hash(known: DataFrame, sidecars: DataFrame) -> DataFrame:
    own = known.where("type IN ('concept', 'entity') AND NOT generated").join(sidecars.select("stem").distinct(), "stem", "left_anti")
    return _rows(own, "MISSING_CONTENT_HASH", F.lit("No .provenance.json sidecar found"))


def alone(known: DataFrame) -> DataFrame:
    """The issues that pages decide alone."""
    return known.select(F.col("stem").alias("page"), F.explode("found").alias("i")).select("i.check_ord", "i.severity", "i.code", "page", "i.message")


def lint(pages: DataFrame, sidecars: DataFrame, files: DataFrame, rules: Constitution | None = None) -> DataFrame:
    """check_ord, severity, code, page, message of all rules on all pages but drafts."""
    known = facts(P.linted(pages), rules)
    parts = (broken_links(known), orphans(known), alone(known), stale(known, sidecars, files), duplicates(known), missing_hash(known, sidecars))
    return reduce(DataFrame.unionByName, parts)


# ---- validation of drafts


def validate(drafts: DataFrame, pages: DataFrame, sidecars: DataFrame, rules: Constitution | None = None) -> DataFrame:
    """severity, code, page, message of what keeps drafts from promotion (errors) or is worth a look: head, sections, links, sidecar, inferences."""
    rules = rules or Constitution()
    kept = drafts.withColumns({"s": T.sections(F.coalesce("content", F.lit(""))), "raw_": P.raw(drafts)})
    parts = [missing_fields(rules, "Missing required frontmatter field")]
    for kind in rules.types():
        for name in rules.sections(kind):
            body = _body(name)
            of = F.col("type") == kind
            parts += [_if(of & body.isNull(), _issue("MISSING_SECTION", f"Missing required section: {name}")), _if(of & (body == ""), _issue("EMPTY_SECTION", f"Empty required section: {name}"))]
        for name, rule in rules.section_rules(kind).items():
            if rule == "facts_only":
                body = _body(name)
                parts.append(_if((F.col("type") == kind) & (body != "") & unmarked(body), _issue("UNMARKED_INFERENCE", f"Possible unmarked inference in facts_only section '{name}': claims without [source: ...] citation")))
    none = F.array().cast(f"array<{ISSUE}>")
    known = kept.select("stem", T.link_targets(F.col("raw_")).alias("targets"), F.flatten(F.array(*(F.coalesce(p, none) for p in parts))).alias("found"))
    names = pages.where("dir <> 'drafts'").select("stem").unionByName(drafts.select("stem"))
    side = sidecars.groupBy("stem").agg(F.min(F.when(F.col("page").isNull() | F.col("content_hash").isNull(), 0).otherwise(1)).alias("whole"))
    states = known.select("stem").join(side, "stem", "left")
    hashless = _rows(states.where("whole IS NULL"), "MISSING_CONTENT_HASH", F.lit("No .provenance.json sidecar found"))
    corrupt = _rows(states.where("whole = 0"), "CORRUPT_PROVENANCE", F.lit("Provenance sidecar missing required fields (page, content_hash)")).withColumn("severity", F.lit("ERROR"))
    return reduce(DataFrame.unionByName, (alone(known), broken_links(known, names, ("Unresolvable wikilink: [[", "]]")), hashless, corrupt)).drop("check_ord")


def report(issues: DataFrame) -> DataFrame:
    """page, errors, warnings."""
    return issues.groupBy("page").agg(F.count_if(F.col("severity") == "ERROR").alias("errors"), F.count_if(F.col("severity") == "WARNING").alias("warnings"))
