"""Triage makes no table that it doesn't read."""

from loomleaf.operators import graph
from loomleaf.plans import queries

DIR = "/root/testdata/sf0.001"


def test_triage_reads_no_inlinks(spark, monkeypatch):
    monkeypatch.setattr(graph, "inlinks", None)
    assert queries.QUERIES["triage"](spark, DIR).count() > 100
