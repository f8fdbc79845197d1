"""SQL table functions."""

from loomleaf.functions import tables


def test_table_functions_take_small_batches(spark):
    tables.register(spark)
    for name in ("wiki_sections", "wiki_links", "wiki_claims"):
        found = spark.sql(f"SELECT * FROM VALUES ('a', '## H\n[[X]] is known to all [source: a.md, §b]') v(k, t), LATERAL {name}(t)")
        assert found.count() == 1 and "ArrowEvalPythonUDTF" not in found._jdf.queryExecution().executedPlan().toString()
