"""Operators of the page engine on small hand-made wikis, against plain models where they are iterative."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from loomleaf.functions import text as T
from loomleaf.functions.constitution import Constitution
from loomleaf.operators import graph, merge, provenance, quality, retrieval, rules, state
from loomleaf.operators import pages as P
from loomleaf.sources import markdown
from loomleaf.streaming import recheck

KIND = "stem string, dir string, path string, title string, type string, confidence string, entity_type string, created string, last_updated string, source_refs array<string>, content_hash string, tags array<string>, aliases array<string>, related_concepts array<string>, content string"


def page(stem, content="", dir="concepts", **fields):
    base = dict(title=stem, type="concept", confidence="HIGH", entity_type=None, created="2025-01-01", last_updated=None, source_refs=["a.md"], content_hash="h", tags=[], aliases=[], related_concepts=[])
    base |= fields
    return (stem, dir, f"{dir}/{stem}.md", *(base[k] for k in ("title", "type", "confidence", "entity_type", "created", "last_updated", "source_refs", "content_hash", "tags", "aliases", "related_concepts")), content)


def wiki(spark, *rows):
    return spark.createDataFrame(list(rows), KIND)


def relations_model(text):
    import re

    found = []
    for m in re.finditer(T.LINK, text):
        suffix = re.match(":(" + "|".join(T.RELATIONS) + r")\b", text[m.end() :])
        words = re.findall(r"\S+", text[: max(0, m.start() - 1)].rstrip())[-3:]
        near = [w.lower() for w in reversed(words) if w.lower() in T.RELATIONS]
        found.append((m.group(1), suffix.group(1) if suffix else near[0] if near else "neutral"))
    return found


def test_relations_as_plain_model(spark):
    rng = random.Random(4)
    parts = ["[[A]]", "[[B|x]]", "[[C c]]:cites", "[[D]]:citesx", "extends", "Cites", "and", "\n", " ", "  ", "IMPLEMENTS", ",", "[[E]]"]
    texts = ["", "cites [[A]][[B]][[C]][[D]][[E]] [[F]]", "extends [[A]] [[B]]", "[[A]]", "Cites\n[[A]]"] + ["".join(rng.choice(parts) + rng.choice(["", " "]) for _ in range(rng.randrange(14))) for _ in range(300)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.relations(F.col("t")).alias("r")).orderBy("i").collect()
    assert [[(x.target, x.rel) for x in r.r] for r in got] == [relations_model(t) for t in texts]


def test_heads_take_the_place_of_links(spark):
    pages = wiki(spark, page("A", "cites [[B]] and [[B]] or [[C]]", related_concepts=["[[B]]:extends", "[[B]]:custom", "[[C]]"]), page("B"), page("b_c"), page("C", "[[B C]] [[Gone]]:cites"))
    got = {(r.source, r.target, r.type, r.weight) for r in graph.edges(pages).collect()}
    assert got == {("A", "B", "custom", 1.0), ("A", "C", "neutral", 1.0), ("C", "b_c", "neutral", 1.0), ("C", "Gone", "cites", 4.0)}


def walk(seeds, edges, depth):
    visited, paths, layer = {}, {}, []
    for s in seeds:
        visited[s], paths[s] = 10.0, [s]
        layer.append((s, 10.0, [s]))
    for d in range(depth):
        after = []
        for node, score, path in layer:
            own = [e for e in edges if e[0] == node] + ([e for e in edges if e[0] == node.lower()] if node.lower() != node else [])
            for _, target, weight in own:
                new = score * weight / (d + 1)
                if target not in visited or new > visited[target]:
                    visited[target] = visited.get(target, 0.0) + new
                    paths[target] = path + [target]
                    after.append((target, new, path + [target]))
        layer = after
    return {n: (s, paths[n]) for n, s in visited.items()}


@pytest.mark.parametrize("seed", range(4))
def test_traversal_as_plain_walk(spark, seed):
    rng = random.Random(seed)
    names = ["A", "a", "B", "c", "D", "d", "e"]
    pairs = sorted({(rng.choice(names), rng.choice(names)) for _ in range(22)})
    edges = [(s, t, float(rng.choice([1, 2, 3, 4]))) for s, t in pairs]
    made = spark.createDataFrame([(s, t, "x", w, i) for i, (s, t, w) in enumerate(edges)], "source string, target string, type string, weight double, pos int")
    seeds = ["A", "c"]
    got = graph.traverse(spark.createDataFrame([(s, i) for i, s in enumerate(seeds, 1)], "stem string, ord int"), made, 3)
    assert {r.node: (r.score, r.path) for r in got.collect()} == walk(seeds, edges, 3)


def test_traversal_without_edges_keeps_seeds(spark):
    none = spark.createDataFrame([], "source string, target string, type string, weight double, pos int")
    pages = wiki(spark, page("A"), page("B"))
    got = graph.reached(spark.createDataFrame([("A", 1), ("Gone", 2)], "stem string, ord int"), none, pages, 2).collect()
    assert [(r.stem, r.score, r.path) for r in got] == [("A", 10.0, ["A"])]


def test_seeds(spark):
    pages = wiki(spark, page("RAG", "x", title="Retrieval Augmented", aliases=["rag"]), page("Other", "about retrieval of things"), page("T", tags=["topic/retrieval"]), page("_index", title="retrieval"), page("E", dir="entities", title="retrieval"))
    got = [(r.stem, r.score) for r in retrieval.seeds(pages, ["rag retrieval"], 5).orderBy("ord").collect()]
    assert got == [("RAG", 18), ("E", 10), ("T", 3), ("Other", 1)]
    boosts = spark.createDataFrame([("T", 50)], "stem string, boost long")
    assert retrieval.seeds(pages, ["rag retrieval"], 2, boosts).orderBy("ord").first().stem == "T"


def test_variants():
    assert retrieval.variants("What is the RAG system?") == ["What is the RAG system?", "rag system", "system rag"]
    assert retrieval.variants("") == [""] and retrieval.variants("IS it") == ["IS it"]


def test_pack_score_and_documents(spark):
    pages = wiki(spark, page("RAG", "## Definition\n\n- Retrieval grounds what models say [source: a.md, §1]\n\n[[Old]]:extends"), page("Old", "## D\n\nx", confidence="LOW"))
    stale = spark.createDataFrame([("Old",)], "stem string")
    issues = spark.createDataFrame([("BROKEN_LINK", "Links to [[Gone]] which does not exist")], "code string, message string")
    pack = retrieval.pack(pages, stale, issues, "rag")
    # 10 + 100 + 35 + 14 + 10 + 8; the other: 20 - 30.
    assert [(r.stem, r.rank_score, r.stale) for r in pack["pages"].orderBy("reading").collect()] == [("RAG", 177.0, False), ("Old", -10.0, True)]
    text = state.artifact(pack, "brief", "RAG").first().content
    assert "- Retrieval grounds what models say [source: a.md, §1]" in text and "- Missing page: [[Gone]]" in text and "- Stale page: [[Old]]" in text
    assert state.artifact(retrieval.pack(pages, stale, issues, "nothing here"), "playbook", "x").first().content.count("- No citation-backed claims found.") == 1


def test_context_stops_at_the_first_that_overflows(spark):
    rows = spark.createDataFrame([(i, f"P{i}", "concept", "HIGH", "Content " * (500 if i == 2 else 5)) for i in range(1, 5)], "ord long, stem string, type string, confidence string, content string")
    assert [r.ord for r in retrieval.context(rows, 1000).collect()] == [1]


def test_claims(spark):
    text = "# T\n## Definition\n- **RAG** joins  search and text [source: a.md, §x] [source: b.md, §y].\nshort [source: a.md, §x]\n- [source: a.md, §x] is skipped as a line\n## Sources\n- A long line that is a source [source: a.md, §x]\n"
    got = P.claims(wiki(spark, page("A", text, confidence=None))).collect()
    assert [(r.id, r.text, r.section, r.sources, r.corroborated, r.confidence) for r in got] == [("claim-1", "RAG joins search and text", "Definition", ["a.md", "b.md"], True, "MEDIUM")]


def test_sections_fold_equal_headings(spark):
    got = P.sections(wiki(spark, page("A", "before\n## X\none\n### sub\n## Y\n## X\nthree"))).orderBy("ord").collect()
    assert [(r.heading, r.body) for r in got] == [("X", "three"), ("Y", "")]


def test_empty_wiki(spark):
    none = wiki(spark).where("false")
    side = spark.createDataFrame([], "stem string, page string, content_hash string, file string, file_hash string")
    files = spark.createDataFrame([], "path string, content_hash string")
    issues = rules.lint(none, side, files)
    assert issues.count() == 0 and graph.edges(none).count() == 0 and state.page_state(none, side, files).count() == 0
    assert quality.wiki_quality(quality.page_quality(none, issues, side, files)).first().score == 0.0


def test_unknown_type_and_null_lists(spark):
    rows = wiki(spark, page("A", "[[B]] [[C]]", type="odd", source_refs=None, tags=None, aliases=None, related_concepts=None), page("B", None))
    side = spark.createDataFrame([("A", "A", "h", None, None)], "stem string, page string, content_hash string, file string, file_hash string")
    codes = {(r.page, r.code) for r in rules.lint(rows, side, spark.createDataFrame([], "path string, content_hash string")).collect()}
    assert ("A", "INVALID_TYPE") in codes and ("A", "NO_SOURCES") in codes and ("A", "BROKEN_LINK") in codes and ("B", "MISSING_CONTENT_HASH") in codes


def test_staleness_trio(spark):
    side = spark.createDataFrame([("same", "a.md", "1"), ("changed", "b.md", "1"), ("gone", "c.md", "1"), ("unhashed", "a.md", None)], "stem string, file string, file_hash string")
    files = spark.createDataFrame([("article/a.md", "1"), ("article/b.md", "2"), ("paper/b.md", "1")], "path string, content_hash string")
    assert {r.stem for r in provenance.stale_sources(side, files).collect()} == {"changed", "gone", "unhashed"}


def test_merge_rewrites_piped_links(spark):
    pages = wiki(spark, page("RAG", "text", tags=["a"]), page("Retrieval (x)", "more", title="Long", aliases=["q"], tags=["b", "a"]), page("T", "[[Retrieval (x)]] and [[Retrieval (x)|shown]] and [[Retrieval]]"))
    got = {r.stem: r for r in merge.merged(pages, "RAG", "Retrieval (x)", "2025-02-02").collect()}
    assert set(got) == {"RAG", "T"} and got["T"].content == "[[RAG]] and [[RAG|shown]] and [[Retrieval]]"
    assert got["RAG"].content == "text\n\n## Merged from Retrieval (x)\n\nmore" and got["RAG"].aliases == ["q", "Long", "Retrieval (x)"] and got["RAG"].tags == ["a", "b"]


def test_promotion_joins_sources(spark):
    pages = wiki(spark, page("A", "old", source_refs=["first.md"]))
    drafts = wiki(spark, page("A", "new", dir="drafts", source_refs=["second.md"]), page("B", "x", dir="drafts", type="timeline"), page("C", "x", dir="drafts"))
    issues = spark.createDataFrame([("ERROR", "X", "C", "")], "severity string, code string, page string, message string")
    got = merge.promoted(drafts, pages, issues).collect()
    assert [(r.stem, r.dir, r.content, r.source_refs) for r in got] == [("A", "concepts", "new", ["first.md", "second.md"])]


def test_health_spellings(spark):
    issues = spark.createDataFrame([("ERROR", "orphan_pages"), (None, "BROKEN_LINK")], "severity string, code string")
    assert tuple(state.health(issues).first()) == (1, 1, 1, 1) and tuple(state.health(issues, strict=True).first()) == (1, 1, 1, 0)


def test_tasks_by_schedule(spark):
    pages = wiki(spark, page("A", "## x\n## y\n## Counter-Arguments"), page("B", "## x\n## y\n## Counter-Arguments"))
    side = spark.createDataFrame([("A", "gone.md", "1")], "stem string, file string, file_hash string")
    when = datetime.datetime(2025, 1, 1)
    schedule = spark.createDataFrame([("A", when), ("B", when)], "page string, next_check_after timestamp_ntz")
    got = {(r.task_type, r.severity, r.page) for r in state.tasks(pages, side, spark.createDataFrame([], "path string, content_hash string"), schedule, "2025-01-02 00:00:00").collect()}
    assert got == {("stale", "high", "A"), ("scheduled_recheck", "low", "B")}


def test_schedule_steps(spark):
    at = [f"2025-01-0{i} 00:00:00" for i in range(1, 6)]
    schedule = spark.createDataFrame([], "page string, confidence string, total_checks long, stale_count long, clean_count long, interval_h double, last_checked_at timestamp_ntz, next_check_after timestamp_ntz")
    seen = []
    for t, bad in zip(at, (False, False, False, True, False)):
        schedule = recheck.recorded(schedule, spark.createDataFrame([("A", bad)], "page string, stale boolean"), t)
        seen.append(schedule.first().interval_h)
    assert seen == [24.0, 36.0, 54.0, 24.0, 36.0]
    assert recheck.due(schedule, "2025-01-05 12:00:00").count() == 0 and recheck.due(schedule, "2025-01-07 00:00:00").first().overdue_h == 12.0


def test_files_there_and_back(spark, tmp_path):
    base = str(tmp_path / "wiki")
    pages = wiki(spark, page("A b", "## D\n\ntext: [[x]]", tags=["t"], created="2025-01-01"), page("E", "y", dir="entities", type="entity"))
    markdown.write_pages(pages, base)
    (tmp_path / "wiki" / "concepts" / "bad.md").write_text("---\na: [\n---\nbody")
    (tmp_path / "wiki" / "concepts" / "plain.md").write_text("no head\r\nhere")
    got = {r.stem: r for r in markdown.read_pages(spark, base).collect()}
    assert set(got) == {"A b", "E", "bad", "plain"} and got["A b"].content == "## D\n\ntext: [[x]]" and got["A b"].created == "2025-01-01" and got["A b"].tags == ["t"] and got["E"].dir == "entities"
    assert got["bad"].error and got["bad"].type is None and got["plain"].content == "no head\nhere" and "aliases" in got["A b"].fields
    assert {r.stem for r in markdown.read_pages(spark, base, ("entities",)).collect()} == {"E"}
    assert markdown.read_pages(spark, str(tmp_path / "nothing")).count() == 0
    side = spark.createDataFrame([("concepts", "A b", "A b", "h", [("a.md", "1", [])], [], ["d"])], "dir string, stem string, page string, content_hash string, sources array<struct<file:string,content_hash:string,sections_used:array<string>>>, claims array<struct<id:string,text:string,sources:array<string>>>, derived_concepts array<string>")
    markdown.write_sidecars(side, base)
    (tmp_path / "wiki" / "entities" / "E.md.provenance.json").write_text("[1")
    held = {r.stem: r for r in markdown.read_sidecars(spark, base).collect()}
    assert held["A b"].corrupt is False and held["A b"].sources[0].file == "a.md" and held["E"].corrupt is True
    assert markdown.flat(markdown.read_sidecars(spark, base)).where("stem = 'A b'").first().file_hash == "1"


def test_sources_manifest_and_log(spark, tmp_path):
    folder = tmp_path / "sources"
    (folder / "article").mkdir(parents=True)
    (folder / "article" / "a.md").write_bytes(b"x\r\ny")
    (folder / "article" / "b.bin").write_bytes(b"z")
    (folder / "README.md").write_text("no")
    got = markdown.read_sources(spark, str(folder)).collect()
    assert [(r.path, r.filename, r.source_type, r.text) for r in got] == [("article/a.md", "a.md", "article", "x\ny")]
    (folder / "manifest.json").write_text('{"sources": [{"filename": "a.md", "content_hash": "' + got[0].content_hash + '"}]}')
    held = markdown.read_manifest(spark, str(folder / "none.json"), str(folder / "manifest.json"))
    new = spark.createDataFrame([("again.md", "x\ny"), ("new_transcript.pdf", "q"), ("same.md", "q")], "filename string, text string")
    assert [(r.filename, r.source_type) for r in merge.registered(new, held, "now").collect()] == [("new_transcript.pdf", "transcript")]
    assert markdown.read_manifest(spark, str(folder / "none.json")).count() == 0
    for i in range(3):
        markdown.append_log(spark, str(tmp_path / "log"), f"2025-01-0{i + 1}", "lint", "done", {"n": "1"})
    assert [r.ts for r in markdown.last_log(spark, str(tmp_path / "log"), 2).collect()] == ["2025-01-03", "2025-01-02"]


def test_constitution(tmp_path):
    (tmp_path / "c.yaml").write_text("page_types:\n  note:\n    required_frontmatter: [title]\nvalidation:\n  low_connectivity: {min_outlinks: 5}\n")
    own = Constitution.load(str(tmp_path / "c.yaml"))
    assert own.types() == ["note"] and own.fields("note") == ["title"] and own.least_links() == 5 and own.sections("note") == []
    with pytest.raises(ValueError):
        own.of_type("concept")
    assert Constitution().template("paper")[0] == "abstract" and "HIGH" in Constitution().confidence_levels()


def test_coverage(spark):
    text = "x [source: s.md, §Strategy] y [source: s.md, §Strategy] z [source: s.md, §Evidence]"
    heads = spark.createDataFrame([("s.md", h) for h in ("Strategy", "Evidence", "Risks")] + [("t.md", None)], "source string, heading string")
    got = {r.source: r for r in quality.coverage(wiki(spark, page("A", text)), heads).collect()}
    assert (got["s.md"].claims, got["s.md"].coverage_ratio, got["s.md"].score) == (3, 0.667, 69) and (got["t.md"].uncovered, got["t.md"].score) == (1, 0)
