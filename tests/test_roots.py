"""Ends of many merges: rounds by the length of chains and cycles, and nothing through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from loomleaf.operators import merge


def plain_roots(lead):
    out = set()
    for page in lead:
        path, at = [], page
        while at in lead and at not in path:
            path.append(at)
            at = lead[at]
        end = min(path[path.index(at) :]) if at in lead else at
        if end != page:
            out.add((page, end))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_roots_of_long_chains_and_cycles(spark, seed):
    rng, lead = random.Random(seed), {}
    for n, length in enumerate((1, 2, 3, 37, 64, 96)):
        names = [f"c{n}-{x}" for x in rng.sample(range(1000), length)]
        lead |= dict(zip(names, [*names[1:], names[0] if n % 2 else f"end{n}"]))
        for tail in (1, 5, 33):
            more = [f"{rng.choice('az')}{n}-{tail}-{x}" for x in rng.sample(range(1000), tail)]
            lead |= dict(zip(more, [*more[1:], rng.choice(names)]))
    got = merge.roots(spark.createDataFrame(list(lead.items()), "secondary string, primary string"))
    assert {(r.secondary, r.primary) for r in got.collect()} == plain_roots(lead)


def test_roots_take_rounds_by_length_and_broadcast_nothing(spark, monkeypatch):
    made = []
    monkeypatch.setattr(merge, "cut", lambda df, f=merge.cut: made.append(df._jdf.queryExecution().executedPlan().toString()) or f(df))
    k = F.col("id")
    mapping = spark.range(4000).select(k.cast("string").alias("secondary"), F.when(k % 2 == 0, k + 1).otherwise(k - 1).cast("string").alias("primary"))
    found = merge.roots(mapping)
    assert found.count() == 2000 and len(made) <= 6
    assert all("Broadcast" not in p for p in [*made, found._jdf.queryExecution().executedPlan().toString()])
