"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from loomleaf.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
#: A page cites nothing, is an orphan and so on on both sides: no rule may be without a case.
EMPTY: set[str] = set()


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in found)


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for f in os.listdir(DIR):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DIR}/{f}'")
    return db


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR)
    got = rows(found.columns, found.collect())
    assert got or name in EMPTY
    if name in SQL:
        want = duck.sql(SQL[name])
        assert sorted(want.columns) == sorted(found.columns)
        assert got == rows(want.columns, want.fetchall())
