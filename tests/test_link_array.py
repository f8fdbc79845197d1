"""Typed links of a page as an array, and each file taken in once."""

import random

from pyspark.sql import functions as F

from loomleaf.operators import graph
from loomleaf.plans import incremental


def test_link_array_as_rows(spark):
    rng = random.Random(5)
    links = ["[[A]]", "[[B|x]]", "extends [[A]]", "[[C]]:cites", "words [[D]]", "\n"]
    heads = ["[[A]]:extends", "[[A]]:cites", "[[D|y]]:implements", "[[C]]", "none", None]
    pages = [(f"P{i}", "concepts", None if i % 7 == 0 else [rng.choice(heads) for _ in range(rng.randrange(5))], " ".join(rng.choice(links) for _ in range(rng.randrange(6)))) for i in range(150)]
    df = spark.createDataFrame([*pages, ("none", "concepts", ["[[A]]:extends"], None)], "stem string, dir string, related_concepts array<string>, content string")
    want = sorted(tuple(r) for r in graph.typed_links(df).collect())
    got = df.select("stem", F.inline(graph.typed_link_array(F.col("content"), F.col("related_concepts"))))
    assert want and sorted(tuple(r) for r in got.collect()) == want


def test_update_reads_files_once(spark, tmp_path):
    """An update read, and so rendered, all files some five times."""
    seen = spark.sparkContext.accumulator(0)

    def told(raw):
        seen.add(1)
        return raw

    files = spark.createDataFrame([(f"concepts/P{i}.md", f"[[P{i + 1}]]") for i in range(20)], "path string, raw string")
    counted = files.select("path", F.udf(told, "string").asNondeterministic()("raw").alias("raw"))
    store = incremental.Store(spark, str(tmp_path))
    store.update(counted)
    assert seen.value == 20 and store.edges().count() == 20
