"""Scalar functions on Markdown text, all of them built-in column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The grammar of links and citations, relation types and their weights.
LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
SOURCE = r"\[source:\s*([^,\]]+),\s*§([^\]]+)\]"
ANY_SOURCE = r"\[source:\s*[^\]]+\]"
TYPED_ENTRY = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]:(\w+)"
WEIGHTS = {"cites": 4, "contradicts": 3, "implements": 3, "extends": 2, "prerequisite_of": 2, "derived_from": 2, "trades_off": 1, "neutral": 1}
RELATIONS = tuple(k for k in WEIGHTS if k != "neutral")


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")), 256), 1, 16)


def tokens(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda t: F.length(t) > 2)


def link_targets(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(LINK), F.lit(1))


def normal_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")


def folded(name: Column) -> Column:
    """The key by which links meet pages."""
    return F.lower(F.replace(name, F.lit(" "), F.lit("_")))


def slug(title: Column) -> Column:
    """A title as a file name."""
    return F.trim(F.regexp_replace(title, r'[\\/:*?"<>|]', ""))


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def held(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once, however often f names it within lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


#: Links to a step of the outer fold; characters of a text's end in which its last words are looked for first.
STEP, ENDING = 128, 2000
#: No word of a relation is longer: of longer ones only the beginning is carried along.
WORD_MOST = 40


def _ending(part: Column) -> Column:
    """The end of a text, with its last five words at least."""
    end = F.substring(part, -ENDING, ENDING)
    return F.when((F.char_length(part) <= ENDING) | (F.size(F.split(end, r"\s+", -1)) > 6), end).otherwise(part)


def relations(content: Column) -> Column:
    """Array of (target, rel) of a text's links: a suffix right behind the link, else the nearest of the three words before it, else neutral.

    The words before a link go back over other links and line ends. The text is taken apart once; a fold then carries
    the last words along. What it finds is joined in steps, so that time grows with the number of links.
    """
    names = "|".join(RELATIONS)
    parts, targets = F.split(content, LINK, -1), link_targets(content)
    after = F.transform(F.slice(parts, 2, 1 << 30), lambda p: F.regexp_extract(p, rf"^:({names})\b", 1))
    before = F.transform(F.slice(parts, F.lit(1), F.size(targets)), _ending)
    places = F.arrays_zip(before.alias("before"), F.regexp_extract_all(content, F.lit(LINK), F.lit(0)).alias("link"), targets.alias("target"), after.alias("suffix"))
    none = F.array().cast("array<struct<target:string,rel:string>>")

    def step(state: Column, x: Column) -> Column:
        def found(fields: Column) -> Column:
            last = F.element_at(fields, -1)
            # The character right before a link doesn't count.
            words = F.concat(F.slice(fields, F.lit(1), F.size(fields) - 1), F.array(F.substring(last, F.lit(1), F.greatest(F.char_length(last) - 1, F.lit(0)))))
            near = held(F.filter(words, lambda w: w != ""), lambda w: F.filter(F.reverse(F.slice(w, F.greatest(F.size(w) - 2, F.lit(1)), F.lit(3))), lambda v: F.lower(v).isin(*RELATIONS)))
            rel = F.when(x["suffix"] != "", x["suffix"]).otherwise(F.coalesce(F.lower(F.get(near, F.lit(0))), F.lit("neutral")))
            tail = F.transform(F.slice(fields, F.greatest(F.size(fields) - 4, F.lit(1)), F.lit(5)), lambda w: F.substring(w, 1, WORD_MOST))
            return F.struct(F.concat(F.array_join(tail, " "), x["link"]).alias("tail"), F.concat(state["out"], F.array(F.struct(x["target"].alias("target"), rel.alias("rel")))).alias("out"))

        return held(F.split(F.concat(state["tail"], x["before"]), r"\s+", -1), found)

    def all_of(each: Column) -> Column:
        def block(state: Column, k: Column) -> Column:
            some = F.aggregate(F.slice(each, k * STEP + 1, F.lit(STEP)), F.struct(state["tail"].alias("tail"), none.alias("out")), step)
            return held(some, lambda r: F.struct(r["tail"].alias("tail"), F.concat(state["out"], r["out"]).alias("out")))

        steps = F.sequence(F.lit(0), F.floor((F.size(each) - 1) / STEP).cast("int"))
        return F.when(F.size(each) == 0, none).otherwise(F.aggregate(steps, F.struct(F.lit("").alias("tail"), none.alias("out")), block, lambda s: s["out"]))

    return held(places, all_of)


def weight(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, v in WEIGHTS.items() for x in (k, v)]), kind), F.lit(1)).cast("double")


def sections(content: Column) -> Column:
    """Array of (heading, body) of the second-level sections; of equal headings the first place and the last body."""
    parts = F.slice(F.split(content, r"(?m)^##[ \t]+", -1), 2, 1 << 30)
    each = F.transform(parts, lambda p: F.struct(F.trim(F.split_part(p, F.lit("\n"), F.lit(1))).alias("heading"), strip(F.regexp_replace(p, r"^[^\n]*\n?", "")).alias("body")))

    def last(found: Column) -> Column:
        names = F.transform(found, lambda s: s["heading"])
        return held(F.reverse(names), lambda back: F.transform(F.array_distinct(names), lambda h: F.element_at(found, (F.size(back) - F.array_position(back, h) + 1).cast("int"))))

    return held(each, last)


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def shortened(text: Column, most: int = 260) -> Column:
    """A text cut at a word's end, with a mark where something is missing."""
    flat = strip(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.char_length(flat) <= most, flat).otherwise(F.concat(F.regexp_replace(F.substring(flat, 1, most), r"\s+\S*$", ""), F.lit("…")))


def source_type(name: Column) -> Column:
    """The kind of a source file by its name."""
    low = F.lower(name)
    # Endings of code files.
    code = r"\.(py|js|ts|go|rs|java)$"
    return F.when(F.contains(low, F.lit("transcript")), "transcript").when(low.endswith(".pdf"), "paper").when(low.rlike(code), "code-doc").otherwise("article")
