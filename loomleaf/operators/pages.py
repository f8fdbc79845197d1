"""Sets of pages, and what is projected from each page alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def is_index() -> Column:
    return F.startswith("stem", F.lit("_")) | F.array_contains(F.split("path", "/"), "indexes") | F.coalesce(F.col("type") == "index", F.lit(False))


def wiki(pages: DataFrame) -> DataFrame:
    """Concepts and entities."""
    return pages.where("dir IN ('concepts', 'entities')")


def named(pages: DataFrame) -> DataFrame:
    """Concepts and entities without generated pages."""
    return wiki(pages).where(~F.startswith("stem", F.lit("_")))


def linted(pages: DataFrame) -> DataFrame:
    """All but drafts."""
    return pages.where("dir IN ('concepts', 'entities', 'indexes', 'timelines', '')")


def by_stem(pages: DataFrame) -> DataFrame:
    """Of concepts and entities with equal stems those of the later folder."""
    last = F.row_number().over(Window.partitionBy("stem").orderBy(F.desc("dir"), F.desc("path")))
    return wiki(pages).withColumn("nth", last).where("nth = 1").drop("nth")


def raw(pages: DataFrame) -> Column:
    """The whole file's text where there is one, else its links in the head before its content."""
    if "raw" in pages.columns:
        return F.col("raw")
    return F.concat(F.array_join(F.coalesce("related_concepts", F.array().cast("array<string>")), "\n"), F.lit("\n"), F.coalesce("content", F.lit("")))


def find(pages: DataFrame, tag: str, confidence: str) -> DataFrame:
    """stem, type, confidence, tags of the pages with a tag and a confidence."""
    hit = F.array_contains("tags", tag) & (F.col("confidence") == confidence) & ~F.startswith("stem", F.lit("_"))
    return pages.where(hit).select("stem", "type", "confidence", "tags")


def sections(pages: DataFrame) -> DataFrame:
    """stem, ord, heading, body of the second-level sections."""
    return pages.select("stem", F.posexplode(T.sections(F.col("content"))).alias("ord", "s")).select("stem", "ord", "s.heading", "s.body")


def headings(sources: DataFrame, column: str = "text", most: int = 4) -> DataFrame:
    """The columns but `column`, ord, level and heading of all headings up to a level."""
    pattern = F.lit(rf"(?m)^(#{{1,{most}}})[ \t]+(.+)$")
    both = F.arrays_zip(F.regexp_extract_all(column, pattern, F.lit(1)).alias("marks"), F.regexp_extract_all(column, pattern, F.lit(2)).alias("heading"))
    found = sources.select(*[c for c in sources.columns if c != column], F.posexplode(both).alias("ord", "h"))
    return found.withColumns({"level": F.length("h.marks"), "heading": F.trim("h.heading")}).where("heading <> ''").drop("h")


def citations(pages: DataFrame) -> DataFrame:
    """stem, file, section of each citation."""
    both = F.arrays_zip(F.regexp_extract_all("content", F.lit(T.SOURCE), F.lit(1)).alias("file"), F.regexp_extract_all("content", F.lit(T.SOURCE), F.lit(2)).alias("section"))
    return pages.select("stem", F.inline(both))


def claim_array(content: Column, confidence: Column, shortest: int = 12) -> Column:
    """Array of claims of a text: lines with a citation outside of Sources, without markup, numbered in order."""
    blank = F.array().cast("array<struct<text:string,section:string,refs:array<struct<source:string,section:string>>>>")

    def refs(line: Column) -> Column:
        names, parts = (F.transform(F.regexp_extract_all(line, F.lit(T.SOURCE), F.lit(g)), lambda x: F.trim(x)) for g in (1, 2))
        return F.transform(names, lambda n, i: F.struct(n.alias("source"), F.get(parts, i).alias("section")))

    def step(state: Column, raw_line: Column) -> Column:
        line = T.strip(raw_line)
        head = T.strip(F.regexp_extract(line, r"^##\s+(.+)$", 1))
        text = T.strip(F.regexp_replace(line, r"^[-*]\s+", ""))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\*\*([^*]+)\*\*", "$1"), T.SOURCE, ""), r"\s+", " ")
        bare = F.regexp_replace(bare, r"^[ .]+|[ .]+$", "")
        is_claim = line.rlike(T.SOURCE) & (state["section"] != "Sources") & ~F.startswith(text, F.lit("[source:")) & (F.char_length(bare) >= shortest)
        claim = F.struct(bare.alias("text"), state["section"].alias("section"), refs(line).alias("refs"))
        return F.when(head != "", F.struct(head.alias("section"), state["out"].alias("out"))).when(is_claim, F.struct(state["section"].alias("section"), F.concat(state["out"], F.array(claim)).alias("out"))).otherwise(state)

    # Only headings and lines with citations matter.
    lines = F.filter(F.split(content, "\n", -1), lambda l: F.contains(l, F.lit("[source:")) | l.rlike(r"^\s*##\s+\S"))
    zero = F.struct(F.lit("").alias("section"), blank.alias("out"))
    found = F.aggregate(lines, zero, step, lambda s: s["out"])

    def record(c: Column, i: Column) -> Column:
        sources = F.array_sort(F.array_distinct(F.transform(c["refs"], lambda r: r["source"])))
        return F.struct(
            F.concat(F.lit("claim-"), (i + 1).cast("string")).alias("id"), c["text"].alias("text"), F.lit("fact").alias("type"), F.coalesce(confidence, F.lit("MEDIUM")).alias("confidence"),
            c["section"].alias("section"), sources.alias("sources"), c["refs"].alias("source_refs"), (F.size(sources) > 1).alias("corroborated"),
        )

    return F.transform(found, record)


def claims(pages: DataFrame) -> DataFrame:
    """stem, claim_no, id, text, type, confidence, section, sources, source_refs, corroborated of each page's claims."""
    each = pages.select("stem", F.posexplode(claim_array(F.col("content"), F.col("confidence"))).alias("claim_no", "c"))
    return each.select("stem", (F.col("claim_no") + 1).cast("long").alias("claim_no"), "c.*")


def thin(pages: DataFrame, least: int = 2) -> DataFrame:
    """stem, type, n_sections of pages with few sections."""
    n = F.regexp_count("content", F.lit(r"(?m)^##\s+")).cast("long")
    return pages.select("stem", "type", n.alias("n_sections")).where(F.col("n_sections") < least)


def without_counter_arguments(pages: DataFrame) -> DataFrame:
    """stem, confidence of trusted pages without a section of counter-arguments."""
    trusted = pages.where("confidence IN ('HIGH', 'MEDIUM')")
    return trusted.where(~F.col("content").rlike(r"(?m)^## Counter[- ]Arguments")).select("stem", "confidence")


def contradicting(pages: DataFrame) -> DataFrame:
    """stem of pages with a contradiction, resolved or not."""
    return pages.where(F.col("content").rlike(r"(?i)>\s*\[!warning\]\s*CONTRADICTION")).select("stem")


def contradiction_blocks(pages: DataFrame) -> DataFrame:
    """stem, n: callout blocks of contradictions that aren't resolved. A block goes on with the lines quoted after its opening one, up to the next opening."""
    opening = r"[ \t]*> \[!warning\] CONTRADICTION[ \t]*"
    blocks = F.regexp_extract_all("content", F.lit(rf"(?m)^{opening}$(?:\r?\n(?!{opening}$)[ \t]*> .*)*"), F.lit(0))
    n = F.size(F.filter(blocks, lambda b: F.contains(b, F.lit("UNRESOLVED")))).cast("long")
    return pages.select("stem", n.alias("n")).where("n > 0")


def migrated(pages: DataFrame, created: str) -> DataFrame:
    """pages with what older ones lack: hash, sources, confidence and date of creation."""
    listed = F.regexp_extract_all("content", F.lit(r"(?m)^\s*-\s+\[?source:\s*([^,\]\n]+)"), F.lit(1))
    named_ = F.array_distinct(F.transform(listed, lambda x: F.trim(x)))
    refs = F.when(F.size(named_) > 0, named_).otherwise(F.array(F.lit("migrated-content")))
    doubtful = F.contains("content", F.lit("[!warning]")) | F.contains(F.lower("content"), F.lit("contradiction"))
    return pages.withColumns({
        "content_hash": F.coalesce("content_hash", T.content_hash(F.col("content"))),
        "source_refs": F.when(F.size(F.coalesce("source_refs", F.array().cast("array<string>"))) > 0, F.col("source_refs")).otherwise(refs),
        "confidence": F.coalesce("confidence", F.when(doubtful, "LOW").otherwise("MEDIUM")),
        "created": F.coalesce("created", F.lit(created)),
    })
