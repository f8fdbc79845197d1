"""Commands over a wiki's folder, from pages to health."""

import pytest

from loomleaf import cli

HEAD = "---\ntitle: {0}\ntype: concept\nconfidence: HIGH\ncreated: 2025-01-01\nsource_refs: [a.md]\ncontent_hash: x\ntags: [t]\n---\n\n"


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("root")
    for folder in ("wiki/concepts", "wiki/drafts", "sources"):
        (base / folder).mkdir(parents=True)
    (base / "wiki/concepts/RAG.md").write_text(HEAD.format("RAG") + "## Definition\n\nRetrieval grounds what models say [source: a.md, §One].\n\n## Relationships\n\n- [[Index]]:extends\n- [[Gone]]\n")
    (base / "wiki/concepts/RAG.md.provenance.json").write_text('{"page": "RAG", "content_hash": "x", "sources": [{"file": "a.md", "content_hash": "old"}]}')
    (base / "wiki/concepts/Index.md").write_text(HEAD.format("Index") + "## Definition\n\nWhat is looked up, in a table of words [source: a.md, §Two].\n")
    (base / "wiki/drafts/New.md").write_text(HEAD.format("New") + "## Definition\n\n[[RAG]]\n")
    (base / "wiki/drafts/New.md.provenance.json").write_text('{"page": "New", "content_hash": "x", "sources": []}')
    (base / "a.md").write_text("# One\n\ntext\n\n## Three\n")
    return base


def command(spark, root, *argv):
    found = cli.run(spark, cli.parser().parse_args(["--root", str(root), "--now", "2025-02-01 00:00:00", *argv]))
    return found if isinstance(found, (str, list)) else found.collect()


def test_commands(spark, root):
    assert [r.source_type for r in command(spark, root, "register", str(root / "a.md"))] == ["article"]
    assert command(spark, root, "register", str(root / "a.md")) == [] and command(spark, root, "check", str(root / "a.md"))[0].known
    assert {r.code for r in command(spark, root, "lint")} >= {"BROKEN_LINK", "STALE_PAGE", "MISSING_CONTENT_HASH"}
    assert [(r.source, r.target) for r in command(spark, root, "link")] == [("RAG", "Index")]
    assert [r.stem for r in command(spark, root, "query", "rag")] == ["Index", "RAG"] and command(spark, root, "query", "What is RAG", "--expand-only")
    assert command(spark, root, "pack", "rag")[0].stem == "RAG" and "Bottom Line" in command(spark, root, "draft", "brief", "--topic", "rag")[0].content
    assert {r.type for r in command(spark, root, "triage")} >= {"error", "missing_page", "stale_page"}
    assert command(spark, root, "coverage", "a.md")[0].uncovered == 1 and command(spark, root, "quality")[0].pages == 2 and command(spark, root, "quality", "rag")[0].claims == 1
    assert len(command(spark, root, "find", "--tag", "t", "--confidence", "HIGH")) == 3 and command(spark, root, "provenance", "rag")[0].page == "RAG"
    assert command(spark, root, "agent-ingest", str(root / "a.md"))[0].headings == ["One", "Three"]
    assert command(spark, root, "scaffold", "Gone")[0].stem == "Gone" and (root / "wiki/drafts/Gone.md").exists() and command(spark, root, "scaffold", "gone") == []
    assert {r.code for r in command(spark, root, "validate", "--promote") if r.page == "New"} == {"MISSING_SECTION"} and (root / "wiki/concepts/New.md").exists()
    assert command(spark, root, "rebuild")[0].broken_links >= 0 and "[[RAG]]" in (root / "wiki/indexes/_index.md").read_text()
    assert {r.bucket for r in command(spark, root, "recheck", "run")} == {"stale", "clean"} and {r.bucket for r in command(spark, root, "recheck", "run")} == {"skipped"}
    assert command(spark, root, "recheck", "due") == [] and command(spark, root, "recheck", "summary")[0].pages == 3
    assert command(spark, root, "save-answer", "rag", "--title", "Answer")[0].stem == "Answer" and {r.task_type for r in command(spark, root, "refine")} >= {"stale", "thin_page"}
    assert command(spark, root, "consolidate") == [] and command(spark, root, "state") and command(spark, root, "health")[0].status == "error"
    assert len(command(spark, root, "log", "-n", "2")) == 2 and "facts only" in command(spark, root, "generate-instructions") and "abstract" in command(spark, root, "extract-prompt", "x.pdf")
    assert command(spark, root, "migrate")
