"""From a question to pages: variants, seeds, source search, context within a budget, ranked packs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans import ranks
from ..plans.stages import cut
from . import graph
from . import pages as P

# Words that don't count in a question.
STOPWORDS = frozenset("what which where when why how is are the a an of to for".split())


def variants(question: str) -> list[str]:
    """A question, its first words that count, and these in reverse: up to three, each different in lower case."""
    words = [w for w in re.sub(r"[^a-zA-Z0-9 ]+", " ", question).lower().split() if len(w) > 2 and w not in STOPWORDS][:5]
    found = [question]
    if words:
        found.append(" ".join(words))
    if len(words) > 1:
        found.append(" ".join(reversed(words)))
    if len(found) == 1:
        found.append(question.lower())
    return list({v.lower(): v for v in reversed(found)}.values())[::-1] if question.strip() else [question]


def expanded(questions: DataFrame, column: str = "question", most: int = 5) -> DataFrame:
    """The other columns, ord (from 1) and variant: `variants` of each question of a table. A null question has none."""
    q = F.col(f"`{column}`")
    words = F.filter(F.split(F.lower(F.regexp_replace(q, "[^a-zA-Z0-9 ]+", " ")), " "), lambda w: (F.length(w) > 2) & ~w.isin(*sorted(STOPWORDS)))

    def found(w: Column) -> Column:
        first, back = F.array_join(w, " "), F.array_join(F.reverse(w), " ")
        more = F.array(F.when((F.size(w) > 0) & (first != F.lower(q)), first), F.when((F.size(w) > 1) & (back != F.lower(q)) & (back != first), back))
        return F.concat(F.array(q), F.filter(more, lambda v: v.isNotNull()))

    rest = [F.col(f"`{c}`") for c in questions.columns if c != column]
    each = questions.where(q.isNotNull()).select(*rest, F.posexplode(T.held(F.slice(words, 1, most), found)).alias("ord", "variant"))
    return each.withColumn("ord", (F.col("ord") + 1).cast("long"))


def index_boost(lines: DataFrame, question: str) -> DataFrame:
    """stem, boost: 5 for each longer word of the question within an index line (ord, line) of a page; of several lines the last."""
    words = F.array(*[F.lit(w) for w in sorted(set(question.lower().split())) if len(w) > 2] or [F.lit(None).cast("string")])
    pattern = r"^-\s*\[\[([^\]]+)\]\](?:\s*[—–-]\s*(.*))?"
    stem = F.regexp_extract(T.strip(F.col("line")), pattern, 1)
    told = F.lower(F.concat(stem, F.lit(" "), F.regexp_extract(T.strip(F.col("line")), pattern, 2)))
    hits = F.size(F.filter(words, lambda w: F.contains(told, w)))
    found = lines.select("ord", stem.alias("stem"), (hits * 5).cast("long").alias("boost")).where("stem <> '' AND boost > 0")
    return found.groupBy("stem").agg(F.max_by("boost", "ord").alias("boost"))


def seeds(pages: DataFrame, questions: list[str], top: int = 5, boosts: DataFrame | None = None) -> DataFrame:
    """stem, ord, score of the best pages for a question's variants.

    A page's score for a variant: 10 for each word in its title, 8 for each alias within the variant, 3 for each word in
    its tags, 1 for each longer word within the text's start, and its boost; the best variant counts. Ties go by the
    first variant that scored, then by folder and name.
    """
    own = P.named(pages)
    own = own.join(boosts, "stem", "left") if boosts is not None else own.withColumn("boost", F.lit(0))
    none = F.array().cast("array<string>")
    start, scores = F.lower(F.substring("content", 1, 500)), []
    for q in questions:
        low = q.lower()
        words = sorted(set(low.split()))
        array = F.array(*map(F.lit, words)) if words else none
        title = F.size(F.array_intersect(F.split(F.lower(F.coalesce("title", "stem")), r"\s+"), array)) * 10
        alias = F.size(F.filter(F.coalesce("aliases", none), lambda a: F.contains(F.lit(low), F.lower(a)))) * 8
        tags = F.aggregate(F.coalesce("tags", none), F.lit(0), lambda s, t: s + F.size(F.array_intersect(F.split(F.translate(t, "/-", "  "), r"\s+"), array)) * 3)
        inside = sum((F.contains(start, F.lit(w)).cast("int") for w in words if len(w) > 3), F.lit(0))
        scores.append(title + alias + tags + inside + F.coalesce("boost", F.lit(0)))
    best = F.array_max(F.array(*scores))
    first = F.array_position(F.transform(F.array(*scores), lambda s: s > 0), F.lit(True))
    ranked = own.select("stem", "dir", best.cast("long").alias("score"), first.alias("q")).where("score > 0")
    order = (F.desc("score"), "q", "dir", "stem")
    chosen = ranked.orderBy(*order).limit(top)
    return chosen.select("stem", F.row_number().over(Window.orderBy(*order)).cast("long").alias("ord"), "score")


def search(sources: DataFrame, question: str, top: int = 5, most: int = 25) -> DataFrame:
    """The columns of sources but text, and score: the documents that mention the question's words most often, each word up to `most` times."""
    words = [w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) > 2]
    low = F.lower("text")
    score = sum((F.least(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("long"), F.lit(most)) for w in words), F.lit(0).cast("long"))
    rest = [c for c in sources.columns if c != "text"]
    return sources.select(*rest, score.alias("score")).where("score > 0").orderBy(F.desc("score"), rest[0]).limit(top)


def snippets(sources: DataFrame, question: str, key: str, most: int = 8) -> DataFrame:
    """key, n, snippet: the first lines of each text that hold a word of the question."""
    words = [w for w in re.findall("[a-z0-9]+", question.lower()) if len(w) > 2]
    hit = lambda line: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(line), w)) if words else F.lit(False)
    told = F.transform(F.split("text", "\n", -1), lambda l, i: F.concat(F.lit("L"), (i + 1).cast("string"), F.lit(": "), T.strip(l)))
    found = F.slice(F.filter(told, hit), 1, most)
    return sources.select(key, F.posexplode(found).alias("n", "snippet")).select(key, (F.col("n") + 1).cast("long").alias("n"), "snippet")


#: No section is shorter than its frame, so that so many sections at least fill a budget of n characters: n // FRAME + 1.
FRAME = len("## [] (type: , confidence: )\n\n\n\n---\n")


def context(ranked: DataFrame, budget: int = 50_000) -> DataFrame:
    """ranked: ord (1, 2, ...), stem, type, confidence, content. ord, stem, n_chars and section of the pages before the first that exceeds the budget."""
    section = F.concat(F.lit("## ["), "stem", F.lit("] (type: "), F.coalesce("type", F.lit("?")), F.lit(", confidence: "), F.coalesce("confidence", F.lit("?")), F.lit(")\n\n"), F.coalesce("content", F.lit("")), F.lit("\n\n---\n"))
    # One window over all rows is bounded by the budget.
    first = ranked.orderBy("ord").limit(budget // FRAME + 1).select("ord", "stem", section.alias("section"))
    total = F.sum(F.char_length("section")).over(Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return first.withColumn("total", total).where(F.col("total") <= budget).select("ord", "stem", F.char_length("section").cast("long").alias("n_chars"), "section")


def merge_candidates(pages: DataFrame, source: str, top: int = 5, most: int = 50_000) -> DataFrame:
    """stem, score: pages that share most words with a source text: 10 for each in the title, 1 for each in the content's start."""
    words = T.tokens(F.lit(source[:most]))
    title = F.size(F.array_intersect(T.tokens(F.coalesce("title", "stem")), words)) * 10
    start = F.size(F.array_intersect(T.tokens(F.substring("content", 1, 5000)), words))
    return P.wiki(pages).select("stem", (title + start).cast("long").alias("score")).where("score > 0").orderBy(F.desc("score"), "stem").limit(top)


# ---- packs


def pack_score(question: str, title: Column, content: Column, score: Column, path: Column, stem: Column, confidence: Column, stale: Column) -> Column:
    """A traversal's score, more for a title or text near the question, for a seed, for confidence; less for stale sources."""
    ask, low = question.lower(), F.lower(title)
    words = F.array_distinct(T.tokens(F.lit(question)))
    total = score + F.when(F.trim(low) == ask.strip(), 100).otherwise(0) + F.when(F.contains(F.lit(ask), low) | F.contains(low, F.lit(ask)), 35).otherwise(0)
    total = total + 14 * F.size(F.array_intersect(words, T.tokens(title))) + 2 * F.size(F.array_intersect(words, T.tokens(F.substring(content, 1, 2000))))
    total = total + F.when(F.get(path, F.lit(0)) == stem, 10).otherwise(0) + F.when(F.upper(confidence) == "HIGH", 8).when(F.upper(confidence) == "MEDIUM", 4).otherwise(0)
    return F.bround(total - F.when(stale, 30).otherwise(0), 2)


def pack_pages(pages: DataFrame, reached: DataFrame, stale: DataFrame, question: str) -> DataFrame:
    """reading, stem, title, type, confidence, stale, score, rank_score, path, headings of the pages that a traversal (rank, stem, score, path) reached, best first."""
    own = P.wiki(pages).select("stem", F.coalesce("title", "stem").alias("title"), F.coalesce("type", F.lit("unknown")).alias("type"), F.coalesce("confidence", F.lit("")).alias("confidence"), "content")
    flags = stale.select("stem", F.lit(True).alias("stale")).distinct()
    # Before their texts are made, pages that weren't reached go.
    own = own.join(reached.select("stem"), "stem", "left_semi")
    met = reached.join(own, "stem").join(flags, "stem", "left").withColumn("stale", F.coalesce("stale", F.lit(False)))
    args = [F.col(c) for c in ("title", "content", "score", "path", "stem", "confidence", "stale")]
    ranked = met.withColumn("rank_score", pack_score(question, *args))
    heads = F.transform(T.sections(F.col("content")), lambda s: s["heading"])
    placed = ranks.numbered(ranked.withColumn("headings", heads).drop("content"), "reading", [F.desc("rank_score"), "rank"])
    return placed.select("reading", "stem", "title", "type", "confidence", "stale", "score", "rank_score", "path", "headings")


def pack_claims(claims: DataFrame, packed: DataFrame, each: int = 5, most: int = 20) -> DataFrame:
    """ord, stem and the claims of a pack's pages in reading order: the first of each page, and of these the first in all."""
    own = claims.where(F.col("claim_no") <= each).join(packed.select("stem", "reading"), "stem")
    first = own.orderBy("reading", "claim_no").limit(most)
    return first.select(F.row_number().over(Window.orderBy("reading", "claim_no")).cast("long").alias("ord"), *claims.columns)


def pack_relationships(all_edges: DataFrame, packed: DataFrame, pages: DataFrame) -> DataFrame:
    """source, target, type, weight, target_exists: edges that begin or end in a pack's pages."""
    names = packed.select(F.explode(F.array("stem", "title")).alias("name")).distinct()
    mine = all_edges.join(names, F.col("source") == F.col("name"), "left_semi").unionByName(all_edges.join(names, F.col("target") == F.col("name"), "left_semi")).distinct()
    there = P.wiki(pages).select(F.col("stem").alias("target"), F.lit(True).alias("target_exists")).distinct()
    return mine.join(there, "target", "left").select("source", "target", "type", "weight", F.coalesce("target_exists", F.lit(False)).alias("target_exists"))


def claim_line(c: str = "") -> Column:
    """A claim as a list item with up to two citations."""
    cited = F.array_join(F.transform(F.slice("source_refs", 1, 2), lambda r: F.concat(F.lit("[source: "), r["source"], F.lit(", §"), r["section"], F.lit("]"))), " ")
    return F.rtrim(F.concat(F.lit("- "), T.shortened(F.col("text")), F.lit(" "), cited))


class Pack(dict):
    """Tables by name, each made when it is first asked for."""

    def __init__(self, **makers: Callable[[], DataFrame]):
        super().__init__()
        self.makers = makers

    def __missing__(self, name: str) -> DataFrame:
        self[name] = found = self.makers[name]()
        return found


def pack(pages: DataFrame, sidecars_stale: DataFrame, issues: DataFrame | Callable[[], DataFrame], question: str, depth: int = 2, top: int = 5) -> Pack:
    """The tables of a context pack: pages, claims, relationships, missing, summary. issues: a table with all broken links, or what makes it."""

    def packed() -> DataFrame:
        # Only pages that the traversal passes are parsed for links.
        found = graph.reached(seeds(pages, [question], top), graph.edges_from(pages), P.wiki(pages), depth)
        return cut(pack_pages(pages, found, sidecars_stale, question))

    def claims() -> DataFrame:
        # Only the pack's pages are looked at for claims.
        own = P.wiki(pages).join(parts["pages"].select("stem"), "stem", "left_semi")
        return cut(pack_claims(P.claims(own), parts["pages"]))

    def related() -> DataFrame:
        return cut(pack_relationships(cut(graph.edges(pages)), parts["pages"], pages))

    def missing() -> DataFrame:
        all_issues = issues() if callable(issues) else issues
        broken = all_issues.where("code IN ('BROKEN_LINK', 'BROKEN_LINKS')").select(F.regexp_extract("message", r"\[\[([^\]]+)\]\]", 1).alias("target"))
        return cut(broken.unionByName(parts["relationships"].where("NOT target_exists").select("target")).where("target <> ''").distinct())

    parts = Pack(pages=packed, claims=claims, relationships=related, missing=missing, summary=lambda: parts["claims"].where("ord <= 3").select("ord", claim_line().alias("line")))
    return parts
