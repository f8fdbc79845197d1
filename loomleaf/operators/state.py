"""Snapshots of a wiki: page states, health, refinement tasks, triage, and what is written from them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stages import cut
from . import graph
from . import pages as P
from . import provenance


def page_state(pages: DataFrame, sidecars: DataFrame, files: DataFrame, neighbours: DataFrame | None = None) -> DataFrame:
    """stem, type, confidence, tags, outlinks, inlinks, last_updated, stale, thin, contradictory of concepts and entities.

    neighbours (graph.inlink_chunks): with it inlinks are the first list of each page, and n_inlinks tells how many
    there are in all, so that a hub's row stays small; its further lists are in that table.
    """
    marked = page_marks(pages, sidecars, files)
    if neighbours is None:
        back = graph.inlinks(pages).select("stem", F.col("sources").alias("inlinks"))
    else:
        back = neighbours.groupBy("stem").agg(F.sum("n").alias("n_inlinks"), F.max(F.when(F.col("chunk") == 0, F.col("sources"))).alias("inlinks"))
    return marked.join(back, "stem", "left").withColumn("inlinks", F.coalesce("inlinks", F.array().cast("array<string>")))


def page_marks(pages: DataFrame, sidecars: DataFrame, files: DataFrame) -> DataFrame:
    """page_state without what other pages decide: its inlinks."""
    own = P.wiki(pages)
    stale = provenance.stale_sources(sidecars, files).select("stem").distinct().withColumn("stale", F.lit(True))
    by_dir = F.when(F.col("dir") == "entities", "entitie").otherwise("concept")
    state = own.select(
        "stem", F.coalesce("type", by_dir).alias("type"), F.coalesce("confidence", F.lit("")).alias("confidence"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), T.link_targets(F.col("content")).alias("outlinks"),
        F.coalesce("last_updated", "created", F.lit("")).alias("last_updated"), (F.regexp_count("content", F.lit(r"(?m)^##\s+")) < 2).alias("thin"), F.col("content").rlike(r"(?i)>\s*\[!warning\]\s*CONTRADICTION").alias("contradictory"),
    )
    return state.join(stale, "stem", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))


def recent_changes(state: DataFrame, most: int = 10) -> DataFrame:
    return state.where("last_updated <> ''").orderBy(F.desc("last_updated"), "stem").limit(most).select(F.col("last_updated").alias("date"), "stem")


def compact(state: DataFrame, most: int = 50) -> DataFrame:
    """All pages if they are few; else those that need attention, and of the others the latest up to `most` in all."""
    total = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("stale OR thin OR contradictory")).alias("attention"))
    attention = state.where("stale OR thin OR contradictory")
    healthy = state.where("NOT (stale OR thin OR contradictory)").orderBy(F.desc("last_updated"), "stem").limit(most)
    nth = F.row_number().over(Window.orderBy(F.desc("last_updated"), "stem"))
    rest = healthy.withColumn("nth", nth).join(F.broadcast(total), F.col("nth") <= F.lit(most) - F.when(F.col("n") <= most, 0).otherwise(F.col("attention"))).drop("nth", "n", "attention")
    return attention.unionByName(rest)


def health(issues: DataFrame, strict: bool = False) -> DataFrame:
    """errors, warnings, orphans, broken_links. strict: only the lower-case spellings count as orphans and broken links."""
    severity = F.coalesce("severity", F.lit("WARNING"))
    orphan, broken = ["orphan_pages"], ["broken_links"]
    if not strict:
        orphan, broken = [*orphan, "ORPHAN_PAGE"], [*broken, "BROKEN_LINK"]
    return issues.agg(F.count_if(severity == "ERROR").alias("errors"), F.count_if(severity == "WARNING").alias("warnings"), F.count_if(F.col("code").isin(*orphan)).alias("orphans"), F.count_if(F.col("code").isin(*broken)).alias("broken_links"))


def by_code(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


def status(errors: Column, warnings: Column) -> Column:
    return F.when(errors > 0, "error").when(warnings > 0, "warning").otherwise("ok")


def priority(score: Column) -> Column:
    return F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low")


def tasks(pages: DataFrame, sidecars: DataFrame, files: DataFrame, schedule: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """task_type, severity, page, detail: contradictions and gaps (high), stale sources (medium, high when overdue), scheduled rechecks (low), thin pages (medium), missing counter-arguments (low)."""
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)

    def task(df: DataFrame, kind: str, severity, page: str, detail: Column) -> DataFrame:
        return df.select(F.lit(kind).alias("task_type"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.col(page).alias("page"), detail.cast("string").alias("detail"))

    stale = provenance.stale_sources(sidecars, files).select("stem").distinct()
    parts = [task(P.contradiction_blocks(pages), "contradiction", "high", "stem", F.col("n")), task(graph.gaps(pages), "gap", "high", "source", F.col("target"))]
    if schedule is None:
        parts.append(task(stale, "stale", "medium", "stem", F.lit("source_changed")))
    else:
        late = schedule.select(F.col("page").alias("stem"), (F.col("next_check_after") < F.lit(now).cast("timestamp_ntz")).alias("late"), F.col("next_check_after").isNull().alias("never"))
        parts.append(task(stale.join(late, "stem", "left"), "stale", F.when(F.col("late"), "high").otherwise("medium"), "stem", F.lit("source_changed")))
        parts.append(task(late.where("late OR never").join(stale, "stem", "left_anti"), "scheduled_recheck", "low", "stem", F.lit("backoff_expired")))
    parts += [task(P.thin(pages), "thin_page", "medium", "stem", F.col("n_sections")), task(P.without_counter_arguments(pages), "missing_counter_args", "low", "stem", F.col("confidence"))]
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank)


def missing_pages(issues: DataFrame) -> DataFrame:
    """target, n, sources (first three of the distinct pages), score of the pages that broken links ask for; score: 20 and 10 for each link."""
    target = F.regexp_extract("message", r"\[\[([^\]]+)\]\]", 1)
    found = issues.where("code IN ('BROKEN_LINK', 'BROKEN_LINKS')").select(target.alias("target"), "page").where("target <> ''")
    nth = F.row_number().over(Window.partitionBy("target").orderBy("page"))
    firsts = found.distinct().withColumn("nth", nth).where("nth <= 3").groupBy("target").agg(F.array_join(F.array_sort(F.collect_list("page")), ", ").alias("sources"))
    counted = found.groupBy("target").agg(F.count(F.lit(1)).alias("n"))
    return counted.join(firsts, "target").withColumn("score", 20 + 10 * F.col("n"))


def triage(issues: DataFrame, state: DataFrame) -> DataFrame:
    """id, type, priority, score, title, reason of what is to be done: errors, contradictions, stale and thin pages, missing pages. Of the state only stem, confidence, thin and stale are asked (see page_marks)."""
    # Each is read several times.
    issues, state = cut(issues.select("severity", "code", "page", "message")), cut(state.select("stem", "confidence", "thin", "stale"))
    kind = (
        F.when(F.col("code").isin("BROKEN_LINK", "BROKEN_LINKS"), None).when(F.col("code").isin("STALE_PAGE", "STALE_PAGES"), "stale_page")
        .when(F.col("code").isin("UNRESOLVED_CONTRADICTION", "CONTRADICTION"), "contradiction").when(F.col("severity") == "ERROR", "error")
    )
    base = F.when(F.col("type") == "error", 100).when(F.col("type") == "contradiction", 50).otherwise(25)
    trust = state.select(F.col("stem").alias("page"), F.when(F.col("confidence") == "HIGH", 15).when(F.col("confidence") == "MEDIUM", 8).otherwise(0).alias("more"))
    told = issues.select(kind.alias("type"), "page", F.col("message").alias("reason")).where("type IS NOT NULL").join(trust, "page", "left")
    told = told.select("type", F.col("page").alias("title"), (base + F.coalesce("more", F.lit(0))).cast("long").alias("score"), "reason")
    absent = missing_pages(issues).select(F.lit("missing_page").alias("type"), F.col("target").alias("title"), "score", F.concat(F.lit("Linked from "), F.col("n").cast("string"), F.lit(" page(s): "), "sources").alias("reason"))
    thin = state.where("thin").select(F.lit("thin_page").alias("type"), F.col("stem").alias("title"), F.lit(15).cast("long").alias("score"), F.lit("Page has very few sections").alias("reason"))
    known = told.where("type = 'stale_page'").select("title").distinct()
    stale = state.where("stale").select(F.lit("stale_page").alias("type"), F.col("stem").alias("title"), F.lit(25).cast("long").alias("score"), F.lit("Source content has changed").alias("reason")).join(known, "title", "left_anti")
    items = reduce(DataFrame.unionByName, (told, absent, thin, stale.select("type", "title", "score", "reason")))
    return items.select(F.concat(F.replace("type", F.lit("_"), F.lit("-")), F.lit(":"), "title").alias("id"), "type", priority(F.col("score")).alias("priority"), "score", "title", "reason")


def actions(missing: DataFrame, stale: DataFrame, health_row: DataFrame) -> DataFrame:
    """ord, action: the first three missing pages, the first three stale ones, and whether there are errors."""

    def three(df: DataFrame, column: str, wording: str, base: int) -> DataFrame:
        first = df.select(column).distinct().orderBy(column).limit(3)
        return first.select((F.row_number().over(Window.orderBy(column)) + base).cast("long").alias("ord"), F.concat(F.lit(wording), F.col(column)).alias("action"))

    errors = health_row.where("errors > 0").select(F.lit(7).cast("long").alias("ord"), F.lit("Fix lint errors before creating new content").alias("action"))
    return three(missing, "target", "Scaffold missing page: ", 0).unionByName(three(stale, "stem", "Refresh stale page: ", 3)).unionByName(errors)


# ---- drafts written from tables

# The texts of new pages; {} are title and source.
CONCEPT_STUB = (
    "## Definition\n\n> [!note] Inference: Scaffolded from `{source}`. Add cited facts before promotion.\n\n## Key Properties\n\n- TODO: Add citation-backed properties.\n\n## How It Works\n\nTODO: Add explanation with source citations.\n\n"
    "## Relationships\n\n- TODO: Link related concepts with typed wikilinks.\n\n## Open Questions\n\n- What source should ground `{title}`?\n\n## Sources\n\n- {source}\n"
)
ENTITY_STUB = (
    "## Overview\n\n> [!note] Inference: Scaffolded from `{source}`. Add cited facts before promotion.\n\n## Contributions\n\n- TODO: Add citation-backed contributions.\n\n## Relationships\n\n- TODO: Link related concepts or entities.\n\n## Sources\n\n- {source}\n"
)


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value)
    return out


def scaffolded(titles: DataFrame, pages: DataFrame, source: str = "triage:missing-link", kind: str = "concept", created: str = "", force: bool = False) -> DataFrame:
    """stem, dir, title, type, confidence, entity_type, created, source_refs, content, content_hash: a draft for each title (column title) that has no page yet, or (unless force) no draft."""
    taken = pages if not force else pages.where("dir <> 'drafts'")
    names = taken.select(F.lower("stem").alias("key")).distinct()
    new = titles.select("title").distinct().withColumn("key", F.lower("title")).join(names, "key", "left_anti")
    content = _filled(ENTITY_STUB if kind == "entity" else CONCEPT_STUB, source=F.lit(source), title=F.col("title"))
    made = new.select(F.translate("title", "/\\", "--").alias("stem"), F.lit("drafts").alias("dir"), "title", F.lit(kind).alias("type"), F.lit("LOW" if kind == "concept" else None).cast("string").alias("confidence"), F.lit("unknown" if kind == "entity" else None).cast("string").alias("entity_type"), F.lit(created).alias("created"), F.array(F.lit(source)).alias("source_refs"), content.alias("content"))
    return made.withColumn("content_hash", T.content_hash(F.col("content")))


# Headings of the drafted documents; a part in braces is filled from the pack.
ARTIFACTS = {
    "case-study": ("{topic} Case Study", (("Situation", "{summary}"), ("Problem", "TODO: Define the problem using cited evidence."), ("Insight", "TODO: Identify the key insight."), ("Approach", "TODO: Describe the approach."), ("Design/Implementation Principles", "{evidence}"), ("Evidence", "{evidence}"), ("Risks and Tradeoffs", "{warnings}"), ("Outcome Metrics", "TODO: Add measurable outcomes."), ("Open Questions", "{warnings}"), ("Sources", "{sources}"))),
    "playbook": ("{topic} Playbook", (("When To Use", "TODO: Define trigger conditions."), ("Principles", "{evidence}"), ("Steps", "TODO: Add operational steps."), ("Checks", "{warnings}"), ("Sources", "{sources}"))),
    "decision-memo": ("{topic} Decision Memo", (("Decision", "TODO: State the decision."), ("Context", "{summary}"), ("Evidence", "{evidence}"), ("Risks", "{warnings}"), ("Recommendation", "TODO: Add recommendation."), ("Sources", "{sources}"))),
    "brief": ("{topic} Brief", (("Bottom Line", "{summary}"), ("What We Know", "{evidence}"), ("Gaps", "{warnings}"), ("Recommended Next Actions", "{actions}"), ("Sources", "{sources}"))),
}


def _joined(df: DataFrame, order: str, line: Column, name: str, missing: str) -> DataFrame:
    """One row: the lines of a bounded table as one text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x["l"])
    return df.agg(F.when(F.count(F.lit(1)) == 0, F.lit(missing)).otherwise(F.array_join(lines, "\n")).alias(name))


def artifact(parts: dict[str, DataFrame], kind: str, topic: str, audience: str | None = None) -> DataFrame:
    """content: one document of a kind over the tables of a pack (see retrieval.pack), with at most 10 claims and 5 warnings of a kind."""
    from .retrieval import claim_line

    title, layout = ARTIFACTS[kind]
    claims = parts["claims"]
    evidence = _joined(claims.where("ord <= 10"), "ord", claim_line(), "evidence", "- No citation-backed claims found.")
    summary = _joined(parts["summary"], "ord", F.col("line"), "summary", "TODO: Add situation from cited context.")
    refs = claims.select("ord", F.posexplode("source_refs").alias("pos", "r")).groupBy("r").agg(F.min(F.struct("ord", "pos")).alias("at"))
    sources = _joined(refs, "at", F.concat(F.lit("- [source: "), "r.source", F.lit(", §"), "r.section", F.lit("]")), "sources", "- No sources found.")
    missing = parts["missing"].orderBy("target").limit(5).select(F.concat(F.lit("0"), "target").alias("o"), F.concat(F.lit("- Missing page: [["), "target", F.lit("]]")).alias("l"))
    stale = parts["pages"].where("stale").orderBy("title").limit(5).select(F.concat(F.lit("1"), "title").alias("o"), F.concat(F.lit("- Stale page: [["), "title", F.lit("]]")).alias("l"))
    warnings = _joined(missing.unionByName(stale), "o", F.col("l"), "warnings", "- No substrate warnings.")
    acts = _joined(missing.limit(3), "o", F.regexp_replace("l", "^- Missing page", "- Scaffold missing page"), "actions", "- No suggested actions.")
    row = reduce(DataFrame.crossJoin, (evidence, summary, sources, warnings, acts))  # one row each
    text = f"# {title}\n\nAudience: {audience or 'general'}\n\n" + "\n\n".join(f"## {h}\n\n{b}" for h, b in layout) + "\n"
    return row.select(_filled(text, topic=F.lit(topic), **{k: F.col(k) for k in ("evidence", "summary", "sources", "warnings", "actions")}).alias("content"))


def saved_answer(context: DataFrame, question: str, title: str, created: str, kind: str = "concept", confidence: str = "LOW", most: int = 2000) -> DataFrame:
    """A draft of a query's context (ord, stem, section, source_refs; bounded by its budget): text up to `most` characters, links to its pages, up to five sources."""
    whole = context.agg(F.array_sort(F.collect_list(F.struct("ord", "stem", "section", "source_refs"))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["section"]), "\n")
    cut_text = F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n\n*[Context truncated — see full query output]*"))).otherwise(text)
    refs = F.slice(F.array_distinct(F.flatten(F.transform("c", lambda x: F.coalesce(x["source_refs"], F.array().cast("array<string>"))))), 1, 5)
    links = F.array_join(F.transform("c", lambda x: F.concat(F.lit("- [["), x["stem"], F.lit("]]"))), "\n")
    content = F.concat(F.lit(f"## Definition\n\nSynthesized answer to: *{question}*\n\n## How It Works\n\n"), cut_text, F.lit("\n\n## Relationships\n\n"), links, F.lit(f"\n\n## Open Questions\n\n- Original query: {question}\n\n## Sources\n\n"), F.array_join(F.transform(refs, lambda r: F.concat(F.lit("- "), r)), "\n"), F.lit("\n"))
    made = whole.select(F.lit(title).alias("stem"), F.lit("drafts").alias("dir"), F.lit(title).alias("title"), F.lit(kind).alias("type"), F.lit(confidence).alias("confidence"), F.lit(created).alias("created"), refs.alias("source_refs"), content.alias("content"))
    return made.withColumn("content_hash", T.content_hash(F.col("content")))


def ingest_plan(source: DataFrame, large: int = 100_000, most: int = 24) -> DataFrame:
    """filename, source_type, n_bytes, n_chars, content_hash, large_source, headings (the first ones) of sources (filename, text)."""
    heads = F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^#{1,4}[ \t]+(.+)$"), F.lit(1)), lambda h: F.trim(h))
    return source.select("filename", T.source_type(F.col("filename")).alias("source_type"), F.octet_length("text").cast("long").alias("n_bytes"), F.char_length("text").cast("long").alias("n_chars"), T.content_hash(F.col("text")).alias("content_hash"), (F.char_length("text") > large).alias("large_source"), F.slice(F.filter(heads, lambda h: h != ""), 1, most).alias("headings"))
