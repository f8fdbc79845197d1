"""Packs: the traversal over the edges of what it passes, and no table that isn't asked for."""

import random

import pytest

from loomleaf.operators import graph, retrieval
from loomleaf.plans import queries

DIR = "/root/testdata/sf0.001"


def test_edges_from_as_all_edges(spark):
    rng = random.Random(9)
    names = [f"P{i}" for i in range(30)] + ["p3", "p4", "P_5", "gone"]
    pages = [(n, rng.choice(["concepts", "entities"]), [f"[[{rng.choice(names)}]]:cites"] * rng.randrange(2), " ".join(f"{rng.choice(['', 'extends '])}[[{rng.choice(names)}]]" for _ in range(4))) for n in names[:-1]]
    df = spark.createDataFrame(pages, "stem string, dir string, related_concepts array<string>, content string")
    seeds = spark.createDataFrame([("P1", 1), ("P3", 2), ("P_5", 3)], "stem string, ord long")
    told = [sorted(tuple(r) for r in graph.traverse(seeds, e, 2).collect()) for e in (graph.edges(df), graph.edges_from(df))]
    assert told[0] == told[1] and len(told[0]) > 10


def test_pack_makes_only_what_is_asked(spark, monkeypatch):
    def never(*_):
        raise AssertionError("not asked for")

    pages = queries._pages(spark, DIR)
    stale = pages.select("stem").limit(0)
    parts = retrieval.pack(pages, stale, never, queries.QUESTION)
    with monkeypatch.context() as m:
        m.setattr(graph, "edges", never)
        assert parts["pages"].count() > 5 and parts["claims"].count() == 20 and parts["summary"].count() == 3
    assert parts["relationships"].count() > 50
    with pytest.raises(AssertionError):
        parts["missing"]
