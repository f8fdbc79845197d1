"""The queries of the page engine over the driver's tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import tables
from ..functions import text as T
from ..operators import candidates, graph, merge, provenance, quality, retrieval, rules, state
from ..operators import pages as P
from ..sources import markdown, rendered
from ..streaming import recheck, schedule
from . import incremental
from .sql import SQL  # noqa: F401  (registered beside the queries)
from .stages import cut, place

QUESTION = "which document 17 domain en status"
SEARCH = "the thing source licensed"
SOURCE = "Document 17 and Doc 170 share their definition with a source of relationships; both cite others."
NOW, TODAY, CREATED = "2025-01-20 00:00:00", "2025-12-31", "2026-04-15"


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet")


def _pages(spark, d):
    return rendered.pages(spark, d)


def _side(spark, d):
    return rendered.sidecars(spark, d)


def _files(spark, d):
    return rendered.files(spark, d)


def _lint(spark, d):
    return rules.lint(_pages(spark, d), _side(spark, d), _files(spark, d))


def _facts(spark, d):
    return rules.facts(P.linted(_pages(spark, d)))


def _of(code):
    return lambda s, d: rules.alone(_facts(s, d)).where(F.col("code") == code)


def _checks(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("page"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("stale"))


def _levels(spark, d):
    return _checks(spark, d).select("page", F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), (F.pmod("page", F.lit(3)) + 1).cast("int")).alias("confidence")).distinct()


def _schedule(spark, d):
    return recheck.fold(_checks(spark, d), _levels(spark, d))


def _state(spark, d):
    return state.page_state(_pages(spark, d), _side(spark, d), _files(spark, d))


def _stale_users(spark, d):
    """Users with a refund or error amount stand for pages whose sources changed."""
    return _checks(spark, d).where("page % 7 = 3").select(F.col("page").alias("stem")).distinct()


def _drafts(spark, d):
    return _pages(spark, d).where("dir = 'drafts'")


def _sources(spark, d):
    """Documents as source files: two in three Markdown, named by source and id."""
    ending = F.when(F.col("doc_id") % 5 == 0, ".py").when(F.col("doc_id") % 7 == 0, ".pdf").when(F.col("doc_id") % 11 == 0, "_transcript.txt").otherwise(".md")
    return _docs(spark, d).select(F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), ending).alias("filename"), F.coalesce("text", F.lit("")).alias("text"))


def _sidecar_rows(spark, d, shift):
    """Two sets of sidecars that share some sources and claims: every document has them by id; the second's claims differ for some."""
    docs = _docs(spark, d).select("doc_id", "source")
    k = F.col("doc_id")
    sources = F.array(F.struct(F.concat("source", F.lit(".md")).alias("file"), F.lit("h0").alias("content_hash")), F.struct(F.when(k % 4 == 0, "").otherwise("x.md").alias("file"), (k % (2 + shift)).cast("string").alias("content_hash")))
    claims = F.array(F.struct(F.lit("c").alias("id"), F.concat(F.lit("claim of "), (k % (3 + shift)).cast("string")).alias("text"), F.array(F.lit("b"), F.lit("a")).alias("sources")), F.struct(F.lit("c").alias("id"), F.lit("same").alias("text"), F.array(F.lit("a")).alias("sources")))
    kept = docs.where(k % (5 + shift) != 0)
    return kept.select(F.concat(F.lit("Doc "), k.cast("string")).alias("stem"), sources.alias("sources"), claims.alias("claims"), F.array(F.concat(F.lit("t"), (k % (2 + shift)).cast("string"))).alias("derived_concepts"))


def merge_provenance(spark, d):
    found = provenance.merged(_sidecar_rows(spark, d, 0), _sidecar_rows(spark, d, 1))
    told = (
        F.array_join(F.transform("sources", lambda s: F.concat(s["file"], F.lit("#"), s["content_hash"])), "|").alias("sources"),
        F.array_join(F.transform("claims", lambda c: F.concat(c["id"], F.lit("#"), c["text"])), "|").alias("claims"), F.array_join("derived_concepts", "|").alias("derived"),
    )
    return found.select("stem", *told)


def traverse(spark, d, depth):
    own = _pages(spark, d)
    return graph.reached(retrieval.seeds(own, retrieval.variants(QUESTION)), graph.edges(own), P.wiki(own), depth).select("stem", "score", F.array_join("path", " > ").alias("path"))


def traverse_depth1(spark, d):
    return traverse(spark, d, 1).select("stem", "score")


def context_seeds(spark, d):
    found = _pages(spark, d)
    ranked = retrieval.seeds(found, retrieval.variants(QUESTION)).select("stem", "ord").join(found.select("stem", "type", "confidence", "content"), "stem")
    return retrieval.context(ranked).select("ord", "stem", "n_chars")


def index_boost(spark, d):
    lines = _pages(spark, d).select(F.col("doc_id").alias("ord"), F.concat(F.lit("- [["), "stem", F.lit("]] — "), "topic").alias("line"))
    return retrieval.index_boost(lines, QUESTION)


def expand_query(spark, d):
    """Each turn of the conversations as a question."""
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("text").alias("question"))
    return retrieval.expanded(turns).select("conv_id", "turn", "ord", F.md5("variant").alias("variant_md5"))


def _pack(spark, d):
    stale = provenance.stale_sources(_side(spark, d), _files(spark, d)).select("stem").distinct()
    return retrieval.pack(_pages(spark, d), stale, lambda: rules.broken_links(rules.targets(_pages(spark, d))), QUESTION)


def pack_pages(spark, d):
    found = _pack(spark, d)["pages"]
    return found.select("reading", "stem", "title", "type", "confidence", "stale", "score", "rank_score", F.array_join("path", " > ").alias("path"), F.array_join("headings", "|").alias("headings"))


def pack_claims(spark, d):
    return _pack(spark, d)["claims"].select("ord", "stem", "claim_no", "text", F.array_join("sources", ",").alias("sources"))


def claims(spark, d):
    refs = F.array_join(F.transform("source_refs", lambda r: F.concat(r["source"], F.lit("#"), r["section"])), "|")
    return P.claims(_pages(spark, d)).select("stem", "claim_no", "id", F.md5("text").alias("text_md5"), "confidence", "section", F.array_join("sources", "|").alias("sources"), refs.alias("refs"), "corroborated")


def state_pages(spark, d):
    joined = {c: F.array_join(c, "|") for c in ("tags", "outlinks", "inlinks")}
    return _state(spark, d).withColumns(joined).select("stem", "type", "confidence", "tags", "outlinks", "inlinks", "last_updated", "stale", "thin", "contradictory")


def source_coverage(spark, d):
    """Headings of a source: the languages of its documents, and two that nobody cites."""
    rows = _docs(spark, d).select(F.concat("source", F.lit(".md")).alias("source"), F.upper("lang").alias("heading")).distinct()
    more = rows.select("source").distinct().select("source", F.explode(F.array(F.lit("Risks"), F.lit("Evidence"))).alias("heading"))
    return quality.coverage(_pages(spark, d), rows.unionByName(more))


def page_quality(spark, d):
    return quality.page_quality(_pages(spark, d), _lint(spark, d), _side(spark, d), _files(spark, d))


def promote_upsert(spark, d):
    """Drafts get pages of concepts with their names as predecessors."""
    all_ = _pages(spark, d)
    drafts = _drafts(spark, d)
    old = drafts.where("doc_id % 2 = 1").withColumns({"dir": F.lit("concepts"), "source_refs": F.array(F.lit("first.md"), F.concat("source", F.lit(".md"))), "content": F.lit("old")})
    issues = rules.validate(drafts, all_, _side(spark, d))
    done = merge.promoted(drafts, all_.unionByName(old), issues)
    return done.select("stem", "dir", F.array_join("source_refs", "|").alias("source_refs"), F.md5("content").alias("content_md5"))


def merge_pages(spark, d):
    done = merge.merged(_pages(spark, d), "Doc 20", "Doc 21", TODAY)
    return done.select("stem", F.md5("content").alias("content_md5"), F.array_join("aliases", "|").alias("aliases"), F.array_join("source_refs", "|").alias("source_refs"), F.array_join("tags", "|").alias("tags"), "last_updated")


def _lateral(table, columns):
    """A table function in SQL over the pages."""

    def query(spark, d):
        tables.register(spark)
        return spark.sql(f"SELECT stem, {columns} FROM {{pages}}, LATERAL {table}(content)", pages=_pages(spark, d))

    return query


def merge_roots(spark, d):
    """Chains and cycles of names: a third of them lead to a third of their number, the others to each other."""
    k = F.col("doc_id")
    to = F.when(k % 3 == 0, F.floor(k / 3)).when(k % 3 == 1, k + 1).otherwise(k - 1)
    mapping = _docs(spark, d).where("doc_id > 0").select(F.concat(F.lit("Doc "), k.cast("string")).alias("secondary"), F.concat(F.lit("Doc "), to.cast("long").cast("string")).alias("primary"))
    return merge.roots(mapping).select(F.col("secondary").alias("page"), F.col("primary").alias("leads_to"))


def incremental_edges(spark, d):
    """The graph of all pages, taken in as edits: at first half of them say something else."""
    files = cut(markdown.rendered(_pages(spark, d)))
    other = F.when(F.pmod(F.xxhash64("path"), F.lit(2)) == 0, F.lit("[[Doc 1]]\n")).otherwise(F.col("raw"))
    store = incremental.Store(spark, place(spark, "graph"))
    store.update(files.withColumn("raw", other))
    store.update(files)
    return store.edges().select("source", "target", "type", "weight")


def page_reader(spark, d):
    """Pages written out with their heads, and read again by the parser of heads."""
    files = markdown.rendered(_pages(spark, d))
    read = markdown.parsed(files)
    lists = [F.array_join(c, "|").alias(c) for c in ("source_refs", "tags", "aliases", "related_concepts")]
    return read.select("stem", "dir", "title", "type", "confidence", "entity_type", "created", "last_updated", "content_hash", *lists, F.size("fields").cast("long").alias("n_fields"), F.md5("content").alias("content_md5"))


def registry_new(spark, d):
    sources = _sources(spark, d)
    held = sources.where("filename LIKE 'src1%'").select(T.content_hash(F.col("text")).alias("content_hash"))
    return merge.registered(sources, held, TODAY).select("filename", "source_type", "content_hash")


def scaffold(spark, d):
    issues = rules.broken_links(_facts(spark, d))
    asked = state.missing_pages(issues).select(F.col("target").alias("title"))
    return state.scaffolded(asked, _pages(spark, d), created=TODAY).select("stem", "type", "confidence", "created", F.array_join("source_refs", "|").alias("source_refs"), "content_hash")


def migrate(spark, d):
    bare = _pages(spark, d).withColumns({"content_hash": F.lit(None).cast("string"), "confidence": F.lit(None).cast("string")})
    done = P.migrated(bare, CREATED)
    return done.select("stem", "content_hash", "confidence", "created", F.array_join("source_refs", "|").alias("source_refs"))


def ingest_plan(spark, d):
    return state.ingest_plan(_sources(spark, d)).withColumn("headings", F.array_join("headings", "|"))


def save_answer(spark, d):
    found = _pages(spark, d)
    ranked = retrieval.seeds(found, retrieval.variants(QUESTION)).select("stem", "ord").join(found.select("stem", "type", "confidence", "content", "source_refs"), "stem")
    held = retrieval.context(ranked).join(found.select("stem", "source_refs"), "stem")
    return state.saved_answer(held, QUESTION, "Answer", TODAY).select("stem", "type", "confidence", F.array_join("source_refs", "|").alias("source_refs"), "content_hash")


def draft_artifacts(spark, d):
    """The four kinds of documents over one pack."""
    parts = _pack(spark, d)
    return reduce(DataFrame.unionByName, (state.artifact(parts, kind, "Document 17").select(F.lit(kind).alias("kind"), "content") for kind in state.ARTIFACTS))


def pack_ranked(spark, d):
    """A pack's pages over a traversal of one step."""
    own, stale = _pages(spark, d), provenance.stale_sources(_side(spark, d), _files(spark, d))
    found = graph.reached(retrieval.seeds(own, retrieval.variants(QUESTION)), graph.edges(own), P.wiki(own), 1)
    return retrieval.pack_pages(own, found, stale, QUESTION).select("stem", "title", "type", "confidence", "stale", "score", "rank_score")


def suggested_actions(spark, d):
    issues = _lint(spark, d)
    stale = provenance.stale_pages(_side(spark, d), _files(spark, d))
    return state.actions(state.missing_pages(issues).select("target"), stale, state.health(issues))


def stream_recheck(spark, d):
    """The checks as a stream of files, taken in by the stateful operator, which begins with the pages' confidence."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    checks = events.select(F.col("user_id").cast("string").alias("page"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("stale"))
    none = {c: F.lit(None).cast(k) for c, k in (("total_checks", "long"), ("stale_count", "long"), ("interval_h", "double"), ("last_checked_at", "timestamp_ntz"))}
    folder = place(spark, "recheck")
    schedule.run_stream(checks, f"{folder}/updates", f"{folder}/state", _levels(spark, d).withColumns(none))
    found = schedule.latest(schedule.read_updates(spark, f"{folder}/updates"))
    return found.select(F.col("page").cast("long").alias("page"), "confidence", "total_checks", "stale_count", "clean_count", "interval_h", "next_check_after")


QUERIES = {
    "page_scan": lambda s, d: _pages(s, d).select("stem", "dir", "type", "confidence", "created", T.content_hash(F.col("content")).alias("content_hash")),
    "page_reader": page_reader,
    "tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(T.tokens(F.col("text")))).cast("long").alias("n_distinct")),
    "slugs": lambda s, d: _docs(s, d).select("doc_id", T.slug(F.substring("text", 1, 40)).alias("slug"), T.normal_name(F.substring("text", 1, 40)).alias("normal")),
    "classify_source": lambda s, d: _sources(s, d).select("filename", T.source_type(F.col("filename")).alias("source_type"), T.stem_of(F.concat(F.lit("a/b/"), "filename")).alias("stem")),
    "find_by_meta": lambda s, d: P.find(_pages(s, d), "domain/en", "HIGH").select("stem", "type", F.array_join("tags", "|").alias("tags")),
    "page_sets": lambda s, d: _pages(s, d).select("stem", P.is_index().alias("generated")).join(P.by_stem(_pages(s, d)).select("stem", F.lit(True).alias("wiki")), "stem", "left").select("stem", "generated", F.coalesce("wiki", F.lit(False)).alias("wiki")),
    "sections": lambda s, d: P.sections(_pages(s, d)).select("stem", F.col("ord").cast("long").alias("ord"), "heading", F.md5("body").alias("body_md5")),
    "headings": lambda s, d: P.headings(_pages(s, d).select("stem", "content"), "content").select("stem", F.col("ord").cast("long").alias("ord"), F.col("level").cast("long").alias("level"), "heading"),
    "citations": lambda s, d: P.citations(_pages(s, d)).groupBy("file", "section").agg(F.count(F.lit(1)).alias("n")),
    "claims": claims,
    "links": lambda s, d: graph.links(_pages(s, d)).select("source", F.col("pos").cast("long").alias("pos"), "target", "rel"),
    "typed_edges": lambda s, d: graph.edges(_pages(s, d)).select("source", "target", "type", "weight"),
    "graph_nodes": lambda s, d: graph.nodes(_pages(s, d)),
    "graph_counts": lambda s, d: graph.edges(_pages(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight")),
    "untyped_graph": lambda s, d: graph.untyped(_pages(s, d)).groupBy("source", "target").agg(F.count(F.lit(1)).alias("n")),
    "inlink_chunks": lambda s, d: graph.inlink_chunks(_pages(s, d), 3).select("stem", "chunk", "n", F.array_join("sources", "|").alias("sources")),
    "inlinks": lambda s, d: graph.inlinks(_pages(s, d)).select("stem", "inlinks", F.array_join("sources", "|").alias("sources")),
    "missing_reverse_links": lambda s, d: graph.missing_reverse(_pages(s, d)),
    "gap_pages": lambda s, d: graph.gaps(_pages(s, d)),
    "expand_query": expand_query,
    "index_boost": index_boost,
    "seed_pages": lambda s, d: retrieval.seeds(_pages(s, d), retrieval.variants(QUESTION)),
    "traverse_depth1": traverse_depth1,
    "traverse_depth2": lambda s, d: traverse(s, d, 2),
    "context_seeds": context_seeds,
    "search_sources": lambda s, d: retrieval.search(_docs(s, d).select("doc_id", "text"), SEARCH),
    "snippets": lambda s, d: retrieval.snippets(_docs(s, d), SEARCH, "doc_id").select("doc_id", "n", F.md5("snippet").alias("snippet_md5")),
    "source_candidates": lambda s, d: candidates.candidates(s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").cast("string").alias("source"), "text"), rendered.pages(s, d, once=True)),
    "merge_candidates": lambda s, d: retrieval.merge_candidates(_pages(s, d), SOURCE),
    "pack_pages": pack_pages,
    "pack_claims": pack_claims,
    "pack_relationships": lambda s, d: _pack(s, d)["relationships"],
    "pack_ranked": pack_ranked,
    "draft_artifacts": draft_artifacts,
    "save_answer": save_answer,
    "suggested_actions": suggested_actions,
    "lint_broken_links": lambda s, d: rules.broken_links(_facts(s, d)),
    "lint_orphans": lambda s, d: rules.orphans(_facts(s, d)),
    "lint_missing_frontmatter": _of("MISSING_FRONTMATTER"),
    "lint_invalid_type": _of("INVALID_TYPE"),
    "lint_no_sources": _of("NO_SOURCES"),
    "lint_low_connectivity": _of("LOW_CONNECTIVITY"),
    "lint_stale_pages": lambda s, d: rules.stale(_facts(s, d), _side(s, d), _files(s, d)),
    "lint_contradictions": _of("UNRESOLVED_CONTRADICTION"),
    "lint_empty_sections": _of("EMPTY_SECTION"),
    "lint_duplicates": lambda s, d: rules.duplicates(_facts(s, d)),
    "lint_unmarked_inference": _of("UNMARKED_INFERENCE"),
    "lint_missing_hash": lambda s, d: rules.missing_hash(_facts(s, d), _side(s, d)),
    "lint_all": _lint,
    "lint_by_code": lambda s, d: state.by_code(_lint(s, d)),
    "health": lambda s, d: state.health(_lint(s, d)),
    "health_strict": lambda s, d: state.health(_lint(s, d), strict=True).withColumn("status", state.status(F.col("errors"), F.col("warnings"))),
    "validate_drafts": lambda s, d: rules.validate(_drafts(s, d), _pages(s, d), _side(s, d)),
    "validation_report": lambda s, d: rules.report(rules.validate(_drafts(s, d), _pages(s, d), _side(s, d))),
    "stale_pages": lambda s, d: provenance.stale_pages(_side(s, d), _files(s, d)).select("stem", F.array_join("files", "|").alias("files")),
    "merge_provenance": merge_provenance,
    "claim_sources": lambda s, d: provenance.claim_sources(P.claims(_pages(s, d)), "Doc 1", "claim-2"),
    "page_quality": page_quality,
    "wiki_quality": lambda s, d: quality.wiki_quality(page_quality(s, d)),
    "source_coverage": source_coverage,
    "index_by_type": lambda s, d: merge.index_by(_pages(s, d), merge.types()),
    "index_by_topic": lambda s, d: merge.index_by(_pages(s, d), merge.exploded("tags", "untagged")),
    "index_by_source": lambda s, d: merge.index_by(_pages(s, d), merge.exploded("source_refs", "no-source")),
    "index_lines": lambda s, d: merge.listed(_pages(s, d), merge.types()),
    "timeline": lambda s, d: merge.timeline(_pages(s, d)),
    "recently_updated": lambda s, d: merge.recently_updated(_pages(s, d), TODAY),
    "dup_title": lambda s, d: merge.by_title(_pages(s, d)),
    "dup_alias": lambda s, d: merge.by_alias(_pages(s, d)),
    "promote_upsert": promote_upsert,
    "sql_sections": _lateral("wiki_sections", "bigint(ord) AS ord, heading, md5(body) AS body_md5"),
    "sql_links": _lateral("wiki_links", "bigint(pos) AS pos, target, rel"),
    "sql_claims": _lateral("wiki_claims", "bigint(claim_no) AS claim_no, md5(text) AS text_md5, section, array_join(sources, '|') AS sources"),
    "incremental_edges": incremental_edges,
    "merge_roots": merge_roots,
    "merge_pages": merge_pages,
    "register_dedup": lambda s, d: merge.register(_docs(s, d)),
    "registry_new": registry_new,
    "check_ingested": lambda s, d: merge.ingested(_sources(s, d), _sources(s, d).where("filename LIKE 'src1%'").select(T.content_hash(F.col("text")).alias("content_hash"))),
    "ingest_plan": ingest_plan,
    "migrate": migrate,
    "scaffold": scaffold,
    "thin_pages": lambda s, d: P.thin(P.wiki(_pages(s, d))),
    "thin_all": lambda s, d: P.thin(_pages(s, d), 4),
    "missing_counter_arguments": lambda s, d: P.without_counter_arguments(_pages(s, d)),
    "contradiction_pages": lambda s, d: P.contradicting(P.wiki(_pages(s, d))),
    "contradiction_blocks": lambda s, d: P.contradiction_blocks(_pages(s, d)),
    "state_pages": state_pages,
    "recent_changes": lambda s, d: state.recent_changes(_state(s, d)),
    "compact_state": lambda s, d: state.compact(_state(s, d)).select("stem", "last_updated", "stale", "thin", "contradictory"),
    "refine_tasks": lambda s, d: state.tasks(_pages(s, d), _side(s, d), _files(s, d)).select("task_type", "severity", "page", "detail"),
    "task_totals": lambda s, d: state.tasks(_pages(s, d), _side(s, d), _files(s, d)).groupBy("severity").agg(F.count(F.lit(1)).alias("n")),
    "triage_missing_pages": lambda s, d: state.missing_pages(_lint(s, d)),
    "triage": lambda s, d: state.triage(_lint(s, d), state.page_marks(_pages(s, d), _side(s, d), _files(s, d))).select("id", "type", "priority", "score", "title"),
    "recheck_fold": lambda s, d: _schedule(s, d).drop("last_checked_at"),
    "recheck_due": lambda s, d: recheck.due(_schedule(s, d), NOW, _stale_users(s, d), "HIGH").select("page", "confidence", "interval_h", F.bround("overdue_h", 6).alias("overdue_h"), "is_stale"),
    "recheck_run": lambda s, d: recheck.run(_levels(s, d).select(F.col("page").alias("stem")), _schedule(s, d), _stale_users(s, d), NOW),
    "recheck_recorded": lambda s, d: recheck.recorded(_schedule(s, d), _stale_users(s, d).select(F.col("stem").alias("page"), (F.col("stem") % 2 == 0).alias("stale")), NOW).select("page", "confidence", "total_checks", "stale_count", "clean_count", "interval_h"),
    "recheck_summary": lambda s, d: recheck.summary(_schedule(s, d)).select("confidence", "pages", "checks", "stale"),
    "stream_recheck": stream_recheck,
}
