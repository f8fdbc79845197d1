"""A folder taken in as a stream of files, and commands that go on from what an earlier one kept."""

import pytest

from loomleaf import cli
from loomleaf.plans import jobs
from loomleaf.sources import markdown
from loomleaf.streaming import ingest

PAGE = "---\ntitle: RAG\ntype: concept\nconfidence: HIGH\ncreated: 2025-01-01\nsource_refs: [a.md]\ncontent_hash: x\n---\n\n## Definition\n\nRetrieval grounds answers [source: a.md, §One].\n"


@pytest.fixture
def wiki(spark, tmp_path):
    for folder in ("wiki/concepts", "wiki/drafts", "sources", "in/deep"):
        (tmp_path / folder).mkdir(parents=True)
    (tmp_path / "wiki/concepts/RAG.md").write_text(PAGE)
    (tmp_path / "wiki/concepts/RAG.md.provenance.json").write_text('{"page": "RAG", "content_hash": "x", "sources": [{"file": "a.md", "content_hash": "old"}]}')
    return jobs.Wiki(spark, str(tmp_path), "2025-02-01 00:00:00")


def known(wiki):
    return sorted((r.filename, r.source_type) for r in wiki.manifest().collect())


def test_files_between_runs_copies_and_a_restart(wiki, tmp_path, monkeypatch):
    run = lambda: ingest.ingest_folder(wiki, str(tmp_path / "in"), str(tmp_path / "state"), rebuild=False)
    (tmp_path / "in/a.md").write_text("first")
    (tmp_path / "in/no.bin").write_text("x")
    run()
    assert known(wiki) == [("a.md", "article")]
    (tmp_path / "in/deep/b transcript.txt").write_text("second")
    (tmp_path / "in/copy.md").write_text("first")
    # The job dies once the texts and the registry are written, before the batch is done.
    with monkeypatch.context() as m:
        m.setattr(jobs.Wiki, "log", lambda *_: 1 / 0)
        with pytest.raises(Exception, match="division"):
            run()
    run()
    run()
    assert known(wiki) == [("a.md", "article"), ("b transcript.txt", "transcript")]
    assert (tmp_path / "sources/article/a.md").read_text() == "first" and (tmp_path / "sources/transcript/b transcript.txt").read_text() == "second"
    assert not (tmp_path / "sources/article/copy.md").exists()


def command(spark, root, *argv):
    return cli.run(spark, cli.parser().parse_args(["--root", str(root), "--now", "2025-02-01 00:00:00", *argv])).collect()


def test_commands_go_on_from_earlier_ones(spark, wiki, tmp_path):
    with pytest.raises(ValueError, match="asked"):
        command(spark, tmp_path, "save-answer")
    assert [r.stem for r in command(spark, tmp_path, "query", "what is rag")] == ["RAG"]
    made = command(spark, tmp_path, "save-answer", "--title", "Kept")[0]
    assert made.stem == "Kept" and "what is rag" in made.content and "[[RAG]]" in made.content and made.source_refs == ["a.md"]
    assert markdown.parse((tmp_path / "wiki/drafts/Kept.md").read_text())["title"] == "Kept"
    assert ("stale", "RAG") in {(r.task_type, r.page) for r in command(spark, tmp_path, "refine")}
    entry = wiki.schedule().collect()
    assert [(r.page, r.total_checks, r.stale_count, r.interval_h) for r in entry] == [("RAG", 1, 1, 24.0)]
    (tmp_path / "in/a.md").write_text("text")
    assert [r.filename for r in command(spark, tmp_path, "ingest-folder", str(tmp_path / "in"))] == ["a.md"]
    assert (tmp_path / "tables/health").exists() and (tmp_path / "tables/inlinks").exists()
