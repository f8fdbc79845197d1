"""Promotion and merging in a folder: what moves, what stays, and steps that are taken up again."""

import json

import pytest

from loomleaf.operators import merge
from loomleaf.plans import jobs
from loomleaf.sources import markdown

HEAD = "---\ntitle: {0}\ntype: concept\nconfidence: HIGH\ncreated: 2025-01-01\nsource_refs: [{1}]\ncontent_hash: x\naliases: [{2}]\n---\n\n"
GOOD = "## Definition\n\nWhat {0} is and does in a longer sentence [source: {1}, §One].\n\n## How It Works\n\nIt works by steps that follow one another [source: {1}, §Two].\n"


def side(page, file, claim):
    return json.dumps({"page": page, "content_hash": "old", "sources": [{"file": file, "content_hash": "h", "sections_used": ["s"]}], "claims": [{"id": "claim-1", "text": claim, "sources": [file]}], "derived_concepts": [page]})


@pytest.fixture
def root(tmp_path):
    for folder in ("wiki/concepts", "wiki/drafts", "sources"):
        (tmp_path / folder).mkdir(parents=True)
    for folder, source in (("concepts", "first.md"), ("drafts", "second.md")):
        (tmp_path / f"wiki/{folder}/P.md").write_text(HEAD.format("P", source, "") + GOOD.format("P", source))
        (tmp_path / f"wiki/{folder}/P.md.provenance.json").write_text(side("P", source, f"of {source}"))
    (tmp_path / "wiki/concepts/Other.md").write_text(HEAD.format("Other", "o.md", "") + GOOD.format("Other", "o.md"))
    (tmp_path / "wiki/drafts/bad.md").write_text("---\ntitle: bad\ntype: concept\n---\n\nnothing\n")
    (tmp_path / "wiki/drafts/note.md").write_text("---\ntitle: note\ntype: memo\n---\n\nnothing\n")
    return tmp_path


def wiki(spark, root):
    return jobs.Wiki(spark, str(root), "2025-02-01 00:00:00")


def state(root):
    return {str(p.relative_to(root)): p.read_text() for p in sorted((root / "wiki").rglob("*.*")) if p.is_file() and not p.name.endswith(".crc")}


def promoted(files):
    assert "wiki/drafts/P.md" not in files and "wiki/drafts/P.md.provenance.json" not in files
    assert {"wiki/drafts/bad.md", "wiki/drafts/note.md"} <= set(files)
    page, sidecar = markdown.parse(files["wiki/concepts/P.md"]), json.loads(files["wiki/concepts/P.md.provenance.json"])
    assert page["source_refs"] == ["first.md", "second.md"] and "second.md" in page["content"] and "first.md" not in page["content"]
    assert [s["file"] for s in sidecar["sources"]] == ["first.md", "second.md"] and sidecar["sources"][0]["sections_used"] == ["s"]
    assert sidecar["content_hash"] == page["content_hash"] != "old" and {c["sources"][0] for c in sidecar["claims"]} == {"second.md"} and len(sidecar["claims"]) == 2


def test_promotion_moves(spark, root):
    before = state(root)
    assert {r.page for r in wiki(spark, root).promote().where("severity = 'ERROR'").collect()} >= {"bad"}
    after = state(root)
    promoted(after)
    assert after["wiki/concepts/Other.md"] == before["wiki/concepts/Other.md"]
    wiki(spark, root).promote()
    assert state(root) == after and not (root / "tables/pending").exists()


@pytest.mark.parametrize("step", ["_write", "remove"])
def test_promotion_is_taken_up_again(spark, root, monkeypatch, step):
    """The job dies before it writes, or between writing and removing; whoever comes next ends what it began, and no source is lost."""

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(markdown, step, dies)
        with pytest.raises(KeyboardInterrupt):
            wiki(spark, root).promote()
    assert (root / "wiki/drafts/P.md").exists()
    assert wiki(spark, root).recover() and not wiki(spark, root).recover()
    promoted(state(root))


def test_step_that_was_never_whole_is_dropped(spark, root):
    (root / "tables/pending").mkdir(parents=True)
    (root / "tables/pending/part-0.parquet").write_text("half")
    wiki(spark, root).promote()
    promoted(state(root))


def test_roots(spark):
    given = [("A", "B"), ("B", "C"), ("C", "D"), ("x", "y"), ("y", "z"), ("z", "y"), ("w", "x"), ("s", "s"), ("m", "p2"), ("m", "p1")]
    got = {(r.secondary, r.primary) for r in merge.roots(spark.createDataFrame(given, "secondary string, primary string")).collect()}
    assert got == {("A", "D"), ("B", "D"), ("C", "D"), ("x", "y"), ("z", "y"), ("w", "y"), ("m", "p1")}
    assert merge.roots(spark.createDataFrame([], "secondary string, primary string")).collect() == []


def test_many_pages_merge_at_once(spark, tmp_path):
    """A chain A to B to C, two pages into one, a text that is there already, links with and without other names."""
    for folder in ("wiki/concepts", "wiki/drafts", "sources"):
        (tmp_path / folder).mkdir(parents=True)
    texts = {"A": "text of A", "B": "text of B, to [[A]]", "C": "text of C [[A|shown]] [[B]] [[X y]]", "P": "text of P with text of S", "S": "text of S", "X y": "[[S]] and [[A]][[B|b]] and [[P]]"}
    for name, text in texts.items():
        (tmp_path / f"wiki/concepts/{name}.md").write_text(HEAD.format(name, f"{name}.md", f"also {name}") + text)
    (tmp_path / "wiki/concepts/A.md.provenance.json").write_text(side("A", "A.md", "c"))
    (tmp_path / "wiki/drafts/D.md").write_text("---\ntitle: D\ntype: concept\n---\n\n[[A]]\n")
    mapping = spark.createDataFrame([("A", "B"), ("B", "C"), ("S", "P"), ("Q", "Nowhere")], "secondary string, primary string")
    assert {tuple(r) for r in wiki(spark, tmp_path).merge(mapping).collect()} == {("A", "C"), ("B", "C"), ("S", "P")}
    files = {k: markdown.parse(v) for k, v in state(tmp_path).items() if k.endswith(".md")}
    assert set(files) == {"wiki/concepts/C.md", "wiki/concepts/P.md", "wiki/concepts/X y.md", "wiki/drafts/D.md"}
    c = files["wiki/concepts/C.md"]
    assert c["content"] == "text of C [[C|shown]] [[C]] [[X y]]\n\n## Merged from B\n\ntext of B, to [[C]]\n\n## Merged from A\n\ntext of A"
    assert c["aliases"] == ["also C", "also B", "B", "also A", "A"] and c["source_refs"] == ["C.md", "B.md", "A.md"] and c["last_updated"] == "2025-02-01"
    assert files["wiki/concepts/P.md"]["content"] == texts["P"] and "S" in files["wiki/concepts/P.md"]["aliases"]
    assert files["wiki/concepts/X y.md"]["content"] == "[[P]] and [[C]][[C|b]] and [[P]]" and files["wiki/drafts/D.md"]["content"] == "[[C]]"
    assert json.loads(state(tmp_path)["wiki/concepts/C.md.provenance.json"])["sources"][0]["file"] == "A.md"
    assert wiki(spark, tmp_path).merge(mapping).collect() == []


def test_names_with_signs(spark, tmp_path):
    (tmp_path / "wiki/concepts").mkdir(parents=True)
    names = ["A#1", "50% off", "q?", "x[y]", "a+b", "é 日"]
    for name in names:
        (tmp_path / f"wiki/concepts/{name}.md").write_text("text")
    assert {r.stem for r in markdown.read_pages(spark, str(tmp_path / "wiki")).collect()} == set(names)
