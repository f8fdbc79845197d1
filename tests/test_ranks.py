"""Ranks and lists of neighbours by ranges of the order."""

import random

import pytest
from pyspark.sql import functions as F

from loomleaf.operators import graph
from loomleaf.plans import ranks


@pytest.mark.parametrize("by", [(), ("g",)])
def test_as_one_window(spark, by):
    """One group holds nearly all rows; one is null."""
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 20 + ["a", "b", None]), rng.randrange(50), i) for i in range(3000)]
    got = ranks.numbered(spark.createDataFrame(rows, "g string, x int, i int").repartition(7), "n", [F.desc("x"), "i"], by).collect()
    want = {}
    for g, x, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        want.setdefault(g if by else 0, []).append((g, x, i))
    assert {tuple(r) for r in got} == {(*r, n) for rs in want.values() for n, r in enumerate(rs, 1)}


def test_empty(spark):
    assert ranks.numbered(spark.createDataFrame([], "g string, x int"), "n", ["x"], ("g",)).collect() == []


def test_lists_of_a_hub(spark):
    pairs = [("hub", f"p{i:05}") for i in range(2500)] * 2 + [("leaf", "p1")]
    got = {(r.stem, r.chunk): (r.n, r["values"]) for r in ranks.chunks(spark.createDataFrame(pairs, "stem string, source string"), "stem", "source", 1000).collect()}
    assert {k: n for k, (n, _) in got.items()} == {("hub", 0): 1000, ("hub", 1): 1000, ("hub", 2): 500, ("leaf", 0): 1}
    assert got["hub", 1][1] == [f"p{i:05}" for i in range(1000, 2000)] and graph.NEIGHBOURS == 1000
