"""Merge candidates read sources and contents whole, whatever their length."""

import pytest

from loomleaf.operators import candidates

PAGE = "dir string, stem string, title string, content string"


@pytest.mark.parametrize("rare", [0, 1000])
def test_whole_texts_count(spark, rare):
    """Words behind a content's first 5,000 characters and a source's first 50,000 were left out."""
    pages = [
        ("concepts", "Far", "one", "filler " * 20_000 + "needle"),
        ("concepts", "Near", "two", "needle"),
        ("concepts", "Across", "three", "x" * 4_997 + " haystack needle"),
        ("concepts", "None", "four", "filler"),
    ]
    sources = [("short", "needle haystack"), ("long", "padding " * 20_000 + "needle four")]
    got = candidates.candidates(spark.createDataFrame(sources, "source string, text string"), spark.createDataFrame(pages, PAGE), rare=rare).collect()
    want = {("short", 1, "Across", 2), ("short", 2, "Far", 1), ("short", 3, "Near", 1)}
    want |= {("long", 1, "None", 10), ("long", 2, "Across", 1), ("long", 3, "Far", 1), ("long", 4, "Near", 1)}
    assert {tuple(r) for r in got} == want


def test_hot_words_of_long_pages_in_parts(spark):
    """A page's hot words are added up in parts: pages of more words than a part, and blocks of sources by their words."""
    n = candidates.ROWS + 1_000
    word = lambda i: f"word{i}"
    pages = [("concepts", f"P{i}", "all", " ".join(map(word, range(0, n, i + 1)))) for i in range(8)]
    asked = {"all": range(n), "tail": range(n - 12, n), "thirds": range(0, n, 3), **{f"s{i}": range(n) for i in range(8)}}
    got = candidates.candidates(spark.createDataFrame([(s, " ".join(map(word, w))) for s, w in asked.items()], "source string, text string"), spark.createDataFrame(pages, PAGE).coalesce(1), rare=0).collect()
    want = set()
    for s, w in asked.items():
        scores = sorted((-sum(i % (p + 1) == 0 for i in w), f"P{p}") for p in range(8))
        want |= {(s, r, stem, -x) for r, (x, stem) in enumerate(scores[:5], 1) if x}
    assert {tuple(r) for r in got} == want
