"""Merge candidates of many sources at once: of each source the pages that share most words with it.

A page's score for a source is 10 for each word of its title and 1 for each of its content that the source has, both
read whole.
A page's words are two arrays, written once. Words that sources ask for are looked up in an inverted index of the pages.
Words of more than `rare` pages (hot ones) are kept out of it: they would pair a source with nearly all pages. Pages
that share a rarer word are candidates; what hot words add to them is counted in the candidates' own arrays. That leaves
pages with nothing but hot words in common: where these could still be among a source's best (a source of few rare
words), the sources, in blocks of `block`, are held against all pages' arrays within each partition, which gives on the
best `top` of them. The result is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..plans.stages import cut
from . import pages as P

# What a word counts in a title and in the content.
TITLE, CONTENT = 10, 1
RARE, BLOCK = 1_000, 512
#: Hot words of a block's sources together, on average; words of pages whose rows are held at once.
BLOCK_WORDS, ROWS = 1 << 17, 1 << 14


def page_words(pages: DataFrame) -> DataFrame:
    """stem, title, content: the distinct words of each page's title and whole content, a written table. Pages of one name count as one, each word at most once."""
    own = P.wiki(pages)
    words = lambda text: F.array_distinct(T.tokens(F.coalesce(text, F.lit(""))))
    each = cut(own.select("stem", words(F.coalesce("title", "stem")).alias("title"), words(F.col("content")).alias("content")))
    # Names of several pages are few: only their arrays are shuffled.
    several = cut(each.groupBy("stem").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("stem"))
    if several.isEmpty():
        return each
    joint = each.join(several, "stem", "left_semi").groupBy("stem").agg(*(F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("title", "content")))
    return cut(each.join(several, "stem", "left_anti").unionByName(joint))


def _best(scored: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("score"), "stem"))
    return scored.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)


def candidates(sources: DataFrame, pages: DataFrame, top: int = 5, rare: int = RARE, block: int = BLOCK) -> DataFrame:
    """source, rank, stem, score: of each source (source, text) the best pages with a word in common; ties by name. Repeated sources count once."""
    texts = sources.where("source IS NOT NULL").groupBy("source").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    told = cut(texts.select("source", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("word")))
    words = page_words(pages)
    # Counted within each task first, so that little is shuffled.
    df = cut(words.select(F.explode(F.array_union("title", "content")).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df")))
    asked = cut(told.join(df, "word"))
    is_rare = F.col("df") <= rare
    rare_words = asked.where(is_rare).select("word").distinct()
    # Of pages' words only the rare ones that are asked for make rows.
    index = words.select("stem", F.explode(F.array_union("title", "content")).alias("word")).join(rare_words, "word", "left_semi")
    # Written before the pages' arrays come in. These are shuffled once for it.
    shared = cut(asked.where(is_rare).join(index, "word").groupBy("source", "stem").agg(F.collect_list("word").alias("few")))
    # A candidate's score: what it shares of rare words, and of the source's hot ones, in its own arrays.
    of_source = cut(asked.where(~is_rare).groupBy("source").agg(F.collect_list("word").alias("asked")))
    none = F.array().cast("array<string>")
    full = shared.join(of_source, "source", "left").join(words, "stem").withColumn("all", F.concat("few", F.coalesce("asked", none)))
    score = F.size(F.array_intersect("all", "title")) * TITLE + F.size(F.array_intersect("all", "content")) * CONTENT
    found = cut(_best(full.select("source", "stem", score.cast("long").alias("score")), top).drop("rank"))
    # A page with hot words alone has no more than this; sources whose last place is above it are done.
    hot_titles = words.select("stem", F.explode("title").alias("word")).join(df.where(~is_rare), "word", "left_semi").groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
    most_title = hot_titles.agg(F.max("n")).first()[0] or 0
    held = found.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"))
    bound = F.size("asked") * CONTENT + F.least(F.size("asked"), F.lit(most_title)) * TITLE
    open_ = cut(of_source.join(held, "source", "left").where(F.coalesce("n", F.lit(0)).__lt__(top) | (F.col("least") <= bound)).select("source", "asked"))
    n, n_words = open_.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("asked")), F.lit(0))).first()
    blocks = open_.withColumn("block", F.pmod(F.xxhash64("source"), F.lit(max(1, -(-n // block), -(-n_words // BLOCK_WORDS)))))
    more = [_scanned(words, [(r.source, r.asked) for r in blocks.where(F.col("block") == b.block).select("source", "asked").collect()], top) for b in blocks.select("block").distinct().collect()]
    for each in more:
        found = found.unionByName(each)
    return _best(found.groupBy("source", "stem").agg(F.max("score").alias("score")), top).select("source", "rank", "stem", "score")


def _scanned(words: DataFrame, asked: list[tuple[str, list[str]]], top: int) -> DataFrame:
    """source, stem, score by hot words alone: a block's sources against all pages, the best of each partition."""
    names = [s for s, _ in asked]
    place = sorted({w for _, ws in asked for w in ws})
    at_place = {w: i for i, w in enumerate(place)}
    table = np.zeros((len(place), len(names)), np.int32)
    for j, (_, ws) in enumerate(asked):
        table[[at_place[w] for w in ws], j] = 1
    shared = words.sparkSession.sparkContext.broadcast((names, place, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, place, table = shared.value
        place = pa.array(place, pa.string())
        scores, stems = np.zeros((0, len(names)), np.int64), np.zeros(0, object)

        def rows(lists: pa.ListArray) -> np.ndarray:
            """Of each list how many of its words each source has; long lists are added up in parts."""
            found = pc.fill_null(pc.index_in(lists.flatten(), place), -1).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
            row, found = row[found >= 0], found[found >= 0]
            out = np.zeros((len(lists), len(names)), np.int32)
            for at in range(0, len(found), ROWS):
                here, first = np.unique(row[at : at + ROWS], return_index=True)
                out[here] += np.add.reduceat(table[found[at : at + ROWS]], first, 0)
            return out

        for batch in batches:
            # Slices of few pages, so that what they add to the best so far stays small.
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                new = rows(part.column("title")) * TITLE + rows(part.column("content")) * CONTENT
                # A page that is below the last of the best of every source so far can't come in.
                if len(scores) >= top:
                    least = -np.partition(-scores, top - 1, 0)[top - 1]
                    some = ((new >= least) & (new > 0)).any(1)
                    part, new = part.filter(pa.array(some)), new[some]
                scores, stems = np.concatenate([scores, new.astype(np.int64)]), np.concatenate([stems, np.array(part.column("stem").to_pylist(), object)])
                # Of all so far only those that are among the best of a source stay.
                by_name = np.argsort(stems, kind="stable")
                scores, stems = scores[by_name], stems[by_name]
                keep = np.unique(np.argsort(-scores, 0, kind="stable")[:top])
                scores, stems = scores[keep], stems[keep]
        order = np.argsort(-scores, 0, kind="stable")[:top]
        i, j = order.ravel(), np.tile(np.arange(len(names)), len(order))
        some = scores[i, j] > 0
        yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in j[some]], pa.string()), pa.array(stems[i[some]].tolist(), pa.string()), pa.array(scores[i, j][some])], ["source", "stem", "score"])

    return words.select("stem", "title", "content").mapInArrow(run, "source string, stem string, score long")
