"""Incremental graph and inlinks against full builds, over random edits."""

import random

from pyspark.sql import functions as F

from loomleaf.operators import graph
from loomleaf.plans.incremental import Store
from loomleaf.sources import markdown

NAMES = ["A", "a", "B c", "b_c", "D", "E", "F", "Hub"]


def page(rng):
    links = " ".join(rng.choice(["", "cites ", "extends "]) + f"[[{rng.choice([*NAMES, 'hub', 'Gone'])}]]" for _ in range(rng.randrange(4)))
    head = f"related_concepts: ['[[{rng.choice(NAMES)}]]:extends']\n" if rng.random() < 0.4 else ""
    return f"---\ntitle: x\n{head}---\n\n{links}\n"


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_equals_a_full_build(spark, tmp_path):
    rng = random.Random(11)
    wiki, store = {}, Store(spark, str(tmp_path / "store"))
    for turn in range(5):
        for _ in range(6 if turn == 0 else 2):
            path = f"{rng.choice(['concepts', 'concepts', 'entities', 'drafts'])}/{rng.choice(NAMES)}.md"
            wiki[path] = page(rng)
        for path in rng.sample(sorted(wiki), 1 if turn else 0):
            del wiki[path]
        files = spark.createDataFrame(sorted(wiki.items()), "path string, raw string")
        told = store.update(files)
        pages = markdown.parsed(files)
        want = ("source", "target", "type", "weight", "pos")
        assert rows(store.edges(), *want) == rows(graph.edges(pages), *want)
        assert rows(store.inlinks(), "stem", "source") == rows(graph.linked(pages).distinct(), "stem", "source")
        assert told["pages"] == len(wiki) and (turn == 0 or told["parsed"] <= 2)
    assert store.update(files)["parsed"] == 0 and store.version() == 6


def test_a_job_that_ends_in_between_changes_nothing(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    files = spark.createDataFrame([("concepts/A.md", "[[B]]"), ("concepts/B.md", "x")], "path string, raw string")
    store.update(files)
    other = files.withColumn("raw", F.concat("raw", F.lit(" [[A]]")))
    with monkeypatch.context() as m:
        m.setattr(graph, "edges_of", lambda *_: 1 / 0)
        try:
            store.update(other)
        except ZeroDivisionError:
            pass
    assert store.version() == 1 and rows(store.edges(), "source", "target") == [("A", "B")]
    store.update(other)
    assert rows(store.inlinks(), "stem", "source") == [("A", "A"), ("A", "B"), ("B", "A")]
