"""Merge candidates: a page's words stay one row, but for names of several pages."""

from loomleaf.operators import candidates

PAGE = "dir string, stem string, title string, content string"


def test_words_of_a_page_are_one_row(spark):
    """A row for each word of each page was shuffled."""
    pages = spark.createDataFrame([("concepts", "A", "One two", "three three four"), ("entities", "A", None, "four five"), ("concepts", "B", "Title", None), ("drafts", "C", "x", "y")], PAGE)
    got = {r.stem: (set(r.title), set(r.content)) for r in candidates.page_words(pages).collect()}
    assert candidates.page_words(pages).count() == 2
    assert got == {"A": ({"one", "two"}, {"three", "four", "five"}), "B": ({"title"}, set())}


def test_more_pages_than_a_slice(spark):
    """Hot words alone: the best of many pages, ties by name, some below all that came before."""
    pages = [("concepts", f"P{i:03d}", "all", "common words " + ("more " if i % 7 == 0 else "") + ("most" if i in (9, 150) else "")) for i in range(300)]
    sources = spark.createDataFrame([("s", "common words more most"), ("t", "more")], "source string, text string")
    got = candidates.candidates(sources, spark.createDataFrame(pages, PAGE).coalesce(1), rare=0).collect()
    score = lambda i: 2 + (i % 7 == 0) + (i in (9, 150))
    want = {("s", n, f"P{i:03d}", score(i)) for n, i in enumerate(sorted(range(300), key=lambda i: (-score(i), i))[:5], 1)}
    want |= {("t", n + 1, f"P{7 * n:03d}", 1) for n in range(5)}
    assert {tuple(r) for r in got} == want
