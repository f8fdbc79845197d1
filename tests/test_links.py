"""Links and sections of long pages, against plain loops."""

import random
import re
import time

from pyspark.sql import functions as F

from loomleaf.functions import text as T


def plain(content):
    out = []
    for m in re.finditer(T.LINK, content):
        suffix = re.match(rf":({'|'.join(T.RELATIONS)})\b", content[m.end() :])
        before = content[: m.start()]
        words = re.split(r"[ \t\n\x0b\f\r]+", before[: max(0, len(before) - 1)])
        near = [w.lower() for w in reversed([w for w in words if w][-3:]) if w.lower() in T.RELATIONS]
        out.append((m[1], suffix[1] if suffix else near[0] if near else "neutral"))
    return out


def found(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.relations(F.col("t")).alias("r")).collect()
    return [[(x.target, x.rel) for x in r.r] for r in sorted(rows)]


def test_relations_as_plain_loops(spark):
    rng = random.Random(3)
    pieces = ["[[A]]", "[[B c|d]]", "[[extends x cites]]", "[[Q]]:extends", "[[Q]]:extendsx", " ", " ", "\n", "cites", "Contradicts", "xcites", "word", "trades_off ", "implements", "[[", "]]", ":", "é", "w" * 50, "z" * 2500]
    texts = ["", "no link", "[[A]]", "x[[A]]", "cites [[A]]", "cites[[A]]"] + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    texts += ["".join(rng.choice(pieces) for _ in range(1500)), "cites " + "[[A]]" * 700 + " [[B]]"]
    assert found(spark, texts) == [plain(t) for t in texts]


def test_table_functions_as_column_forms(spark):
    """In SQL, over texts of links, headings and claims, and over null and empty ones."""
    from loomleaf.functions import tables
    from loomleaf.operators import pages as P

    rng = random.Random(7)
    pieces = ["[[A]]", "[[B c|d]]", "[[e cites]]", "[[Q]]:extends", " ", " ", "\n", "\n## Head\n", "\n## Sources\n", "\n##  x  \n", "cites", "cites ", "w" * 50, "- A claim of some length ", "**bold** words here ", "[source: a.md, §One]", "[source: b.md,§ Two ]", "\n[source: c.md, §1] more of it\n", ".", "\t"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    pages = spark.createDataFrame([*enumerate(texts), (1000, None), (1001, "")], "i int, content string").withColumn("confidence", F.lit(None).cast("string"))
    tables.register(spark)
    ask = lambda table, what: sorted(tuple(r) for r in spark.sql(f"SELECT i, {what} FROM {{pages}}, LATERAL {table}(content)", pages=pages).collect())
    assert ask("wiki_sections", "ord, heading, body") == sorted(tuple(r) for r in pages.select("i", F.posexplode(T.sections(F.col("content"))).alias("ord", "s")).select("i", "ord", "s.heading", "s.body").collect())
    assert ask("wiki_links", "pos, target, rel") == sorted(tuple(r) for r in pages.select("i", F.posexplode(T.relations(F.col("content"))).alias("pos", "r")).select("i", "pos", "r.target", "r.rel").collect())
    want = pages.select("i", F.posexplode(P.claim_array(F.col("content"), F.col("confidence"))).alias("n", "c")).select("i", F.col("n") + 1, "c.text", "c.section", "c.sources", "c.source_refs").collect()
    assert ask("wiki_claims", "claim_no, text, section, sources, refs") == sorted(tuple(r) for r in want) and len(want) > 100


def test_ten_thousand_links_on_a_page(spark):
    text = "a body of some words. " * 2000 + "\n".join(f"- word cites [[Page {i}]] and [[Other {i}]]:extends" for i in range(5000))
    found(spark, ["warm [[up]]"])
    began = time.time()
    assert found(spark, [text]) == [[x for i in range(5000) for x in ((f"Page {i}", "cites"), (f"Other {i}", "extends"))]]
    assert time.time() - began < 20


def test_many_sections(spark):
    names = [f"H{i % 2500}" for i in range(5000)]
    text = "start\n" + "\n".join(f"## {h}\nbody {i}" for i, h in enumerate(names))
    want = {h: f"body {i}" for i, h in enumerate(names)}
    began = time.time()
    got = spark.createDataFrame([(text,)], "t string").select(F.explode(T.sections(F.col("t"))).alias("s")).select("s.heading", "s.body").collect()
    assert [tuple(r) for r in got] == list(want.items()) and time.time() - began < 20
