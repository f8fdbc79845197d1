"""Merge candidates of many sources against plain loops, with few and many hot words."""

import random

import pytest

from loomleaf.operators import candidates

PAGE = "dir string, stem string, title string, content string, type string, path string"


def plain(sources, pages, top):
    def words(t):
        import re

        return {w for w in re.findall("[a-z0-9]+", t.lower()) if len(w) > 2}

    out = set()
    for s, text in sources:
        told = []
        for _, stem, title, content, *_ in pages:
            score = 10 * len(words(text or "") & words(title or stem)) + len(words(text or "") & words((content or "")[:5000]))
            if score:
                told.append((-score, stem))
        out |= {(s, i, stem, -score) for i, (score, stem) in enumerate(sorted(told)[:top], 1)}
    return out


@pytest.mark.parametrize("rare", [0, 2, 12, 1000])
def test_as_plain_loops(spark, rare):
    rng = random.Random(rare)
    often, seldom = [f"hot{i}" for i in range(6)], [f"word{i}" for i in range(60)]
    text = lambda n, share: " ".join(rng.choice(often if rng.random() < share else seldom) for _ in range(n))
    pages = [("concepts", f"P{i}", rng.choice([None, text(3, 0.5)]), rng.choice([None, "", text(rng.randrange(30), 0.7)]), "concept", f"concepts/P{i}.md") for i in range(80)]
    sources = [(f"s{i}", text(rng.choice([1, 3, 20]), rng.choice([0, 0.5, 1]))) for i in range(25)] + [("none", None), ("empty", ""), ("other", "zzzz qqqq")]
    got = candidates.candidates(spark.createDataFrame(sources, "source string, text string"), spark.createDataFrame(pages, PAGE).repartition(3), rare=rare, block=4)
    assert {tuple(r) for r in got.collect()} == plain(sources, pages, 5)
    assert candidates.candidates(spark.createDataFrame([], "source string, text string"), spark.createDataFrame(pages, PAGE)).collect() == []


def test_expanded_as_variants(spark):
    from loomleaf.operators import retrieval

    asked = ["What is RAG", "", "  ", "the of", "one two three four five six", "aaa aaa", "Gamma", "gamma beta", "Été sur l'eau, NOW", "a-b_c? Which Index, where", "x" * 5000, "alpha\tbeta\nGamma"]
    got = retrieval.expanded(spark.createDataFrame([*enumerate(asked), (99, None)], "i int, question string")).collect()
    assert sorted(tuple(r) for r in got) == [(i, n, v) for i, q in enumerate(asked) for n, v in enumerate(retrieval.variants(q), 1)]
