"""Pages, sidecars and source files rendered from the driver's relational tables.

The texts are valid in Spark SQL and in DuckDB alike ({array} is the engine's array constructor); documents and labels
are tables. Each document is one page with its whole text. Remainders of doc_id decide which pages lack a field, cite
nothing, dangle, repeat a name, hold a placeholder or a contradiction, so that each rule has pages on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGES = """
SELECT k AS doc_id, stem, dir, dir || '/' || stem || '.md' AS path, title, type, confidence, entity_type, created, last_updated, source_refs, content_hash, tags, aliases, related_concepts, topic, source,
 '## Definition' || chr(10) || chr(10) || CASE WHEN k % 16 = 9 THEN '*To be documented*' || chr(10) || chr(10) ELSE '' END
 || body || CASE WHEN k % 9 = 0 THEN '' ELSE cite END || chr(10) || chr(10)
 || CASE WHEN k % 13 = 0 THEN '> [!warning] CONTRADICTION' || chr(10) || '> **Status:** UNRESOLVED' || chr(10) || chr(10)
   WHEN k % 13 = 1 THEN '> [!warning] CONTRADICTION' || chr(10) || '> **Status:** RESOLVED' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN k % 4 = 3 THEN '' ELSE '## Key Properties' || chr(10) || chr(10) || CASE WHEN k % 11 = 5 OR k % 36 = 0 THEN ''
   ELSE '- **Property** of document ' || k || ' holds in general' || cite || ' [source: other.md, §notes].' || chr(10) || chr(10) END END
 || CASE WHEN k % 11 = 0 THEN '' ELSE '## Relationships' || chr(10) || chr(10) || '- [[' || t1 || ']]'
   || CASE WHEN r1 = 'neutral' THEN '' ELSE ':' || r1 END || chr(10) || '- Cites [[Doc ' || t2 || '|alias]]' || chr(10)
   || CASE WHEN k % 8 = 2 THEN '- extends [[Doc ' || t2 || ']] [[' || t1 || ']] and [[' || t1 || ']]' || chr(10) ELSE '' END || chr(10) END
 || CASE WHEN k % 2 = 0 THEN '## Counter-Arguments' || chr(10) || chr(10) || 'None known' || chr(10) || chr(10) ELSE '' END
 || CASE WHEN k % 3 = 1 OR k % 18 = 0 THEN '' ELSE '## Sources' || chr(10) || chr(10) || '-' || cite || chr(10) END AS content
FROM (SELECT d.doc_id AS k, d.source, coalesce(d.text, '') AS body, 'domain/' || d.lang AS topic,
  ' [source: ' || d.source || '.md, §' || d.lang || ']' AS cite,
  CASE WHEN d.doc_id % 97 = 5 THEN 'DOC-' || (d.doc_id - 1) ELSE 'Doc ' || d.doc_id END AS stem,
  CASE WHEN d.doc_id % 41 = 7 THEN 'drafts' WHEN d.doc_id % 61 = 8 THEN 'indexes' WHEN d.doc_id % 5 = 4 THEN 'entities' ELSE 'concepts' END AS dir,
  CASE WHEN d.doc_id % 23 = 6 THEN NULL ELSE 'Document ' || d.doc_id END AS title,
  CASE WHEN d.doc_id % 31 = 4 THEN NULL WHEN d.doc_id % 29 = 3 THEN 'memo' WHEN d.doc_id % 61 = 8 THEN 'index' WHEN d.doc_id % 5 = 4 THEN 'entity' ELSE 'concept' END AS type,
  CASE WHEN l.quality = 1 THEN 'HIGH' WHEN l.quality = 0 THEN 'LOW' ELSE 'MEDIUM' END AS confidence,
  CASE WHEN d.doc_id % 10 = 4 THEN 'tool' ELSE NULL END AS entity_type,
  CASE WHEN d.doc_id % 19 = 7 THEN NULL ELSE '2025-' || lpad(CAST(d.doc_id % 12 + 1 AS STRING), 2, '0') || '-' || lpad(CAST(d.doc_id % 28 + 1 AS STRING), 2, '0') END AS created,
  CASE WHEN d.doc_id % 3 = 0 THEN '2025-12-' || lpad(CAST(d.doc_id % 28 + 1 AS STRING), 2, '0') ELSE NULL END AS last_updated,
  CASE WHEN d.doc_id % 6 = 0 THEN CAST({array}() AS {strings}) ELSE {array}(d.source || '.md') END AS source_refs,
  CASE WHEN d.doc_id % 17 = 8 THEN NULL ELSE substr(sha2(coalesce(d.text, ''), 256), 1, 16) END AS content_hash,
  CASE WHEN d.doc_id % 10 = 9 THEN CAST({array}() AS {strings}) ELSE {array}('domain/' || d.lang, 'topic/' || d.source) END AS tags,
  CASE WHEN d.doc_id % 7 = 3 THEN {array}('Alias ' || CAST(floor(d.doc_id / 21) AS BIGINT)) WHEN d.doc_id % 50 = 7 THEN {array}('Doc ' || (d.doc_id + 1)) ELSE CAST({array}() AS {strings}) END AS aliases,
  CASE WHEN d.doc_id % 15 = 1 THEN {array}('[[Doc ' || ((d.doc_id * 7 + 1) % n.n) || ']]:extends', '[[Doc ' || (d.doc_id + 1) || ']]:mentions', '[[Doc 1]]') ELSE CAST({array}() AS {strings}) END AS related_concepts,
  'Doc ' || ((d.doc_id * 7 + 1) % n.n) AS t1, CAST((d.doc_id * 3 + 2) % (n.n + 7) AS STRING) AS t2,
  CASE d.doc_id % 8 WHEN 0 THEN 'cites' WHEN 1 THEN 'implements' WHEN 2 THEN 'extends' WHEN 3 THEN 'contradicts'
    WHEN 4 THEN 'prerequisite_of' WHEN 5 THEN 'derived_from' WHEN 6 THEN 'trades_off' ELSE 'neutral' END AS r1
 FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id CROSS JOIN (SELECT count(*) AS n FROM {documents}) n) b
"""

#: Sidecars: most pages have one; some are corrupt (no page name), cite a changed file or one that is gone.
SIDECARS = """
SELECT doc_id, stem, CASE WHEN doc_id % 43 = 10 THEN NULL ELSE stem END AS page, content_hash,
 CASE WHEN doc_id % 24 = 7 THEN 'gone.md' ELSE source || '.md' END AS file,
 CASE WHEN doc_id % 12 = 5 THEN 'old' WHEN doc_id % 25 = 12 THEN NULL ELSE substr(sha2(source, 256), 1, 16) END AS file_hash
FROM pages WHERE doc_id % 16 <> 9
"""

#: Source files: path and current hash.
FILES = """SELECT DISTINCT 'article/' || source || '.md' AS path, substr(sha2(source, 256), 1, 16) AS content_hash FROM documents"""


def tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels")}


def pages(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """doc_id, stem, dir, path, the fields of the head, topic, source and content of each document as a page.

    once: a document of several labels is one page still. Where nothing of the labels is asked for, Spark then leaves
    their join out, which shuffles all texts.
    """
    given = tables(spark, sf_dir)
    if once:
        given["labels"] = given["labels"].dropDuplicates(["doc_id"])
    return spark.sql(PAGES.replace("{array}", "array").replace("{strings}", "array<string>"), **given)


def sidecars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, stem, page, content_hash, file and file_hash: a row for each source of each page's sidecar."""
    return spark.sql(SIDECARS.replace("FROM pages", "FROM {pages}"), pages=pages(spark, sf_dir))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content_hash of the source files."""
    return spark.sql(FILES.replace("FROM documents", "FROM {documents}"), documents=tables(spark, sf_dir)["documents"])
