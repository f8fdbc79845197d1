"""SimHash near-dedup by the exact similarity of word shingles.

Two texts are linked if the sets of their runs of five words have a Jaccard similarity of 0.8 or more. Candidates come
from two sides. Golay-code keys of the texts' SimHash fingerprints (llm/simhash.py) bring together those that differ in
two bits at most. At a similarity of 0.8, though, fingerprints of 64 bits differ in about ten bits, more than keys of
their segments can reach without loss; so further candidates come from prefixes: with shingles in one order for all
texts, two linked sets of n and m shingles share one among the first n // 5 + 1 and m // 5 + 1. No link is missed,
whatever the order; shingles that are frequent in a sample go last, which only makes prefixes rarer. All candidates are
verified with their whole sets (64-bit hashes).

Of the sets that share a shingle one is the hub, by a hash, so that those who share many shingles have the same hub; all
others are compared with it first. Then only pairs whose members aren't joined yet are looked at, if their sizes and the
places of what they share allow the similarity, so that a large group of near copies isn't compared pair by pair.

Defined results: a null text counts as empty; texts without words are copies of each other; a text of fewer than five
words is one shingle; repeated rows stay in near_duplicates, each in its component; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import discard, fresh, map_arrow, stored, tidy, whole_text
from .graph import components

WORDS = 5
#: One text of so many is in the sample, of which so many shingles are known as frequent.
SAMPLE, FREQUENT = 16, 50_000


def runs(text: str) -> np.ndarray:
    """The hashes of all runs of WORDS words, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    words = np.array([xxh64_intdigest(w) for w in found], np.uint64)
    n = max(1, len(words) - WORDS + 1)
    hashes = np.full(n, min(len(words), WORDS), np.uint64)
    for k in range(min(len(words), WORDS)):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
        hashes ^= hashes >> np.uint64(29)
    return hashes


def shingles(text: str) -> np.ndarray:
    """Sorted distinct hashes of all runs of WORDS words."""
    return np.unique(runs(text))


def _class(hashes: np.ndarray) -> int:
    """The same for texts with the same shingles."""
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else 0


def _frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles of a sample, sorted, and how often they occur there. They steer the order, not the results."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shingles(t) for t in batch.column(0).to_pylist()]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64))], ["token"])

    sampled = map_arrow(rows.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select("text"), run, "token long")
    top = sampled.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "token").limit(FREQUENT).collect()
    tokens = np.array([r.token for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return tokens[order], np.array([r.n for r in top], np.int64)[order]


def prefix(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in the common order: by frequency, then by hash. Any set of similarity 0.8 has one of its own first among them."""
    tokens, counts = frequent
    n = np.zeros(len(hashes), np.int64)
    if len(tokens):
        at = np.minimum(np.searchsorted(tokens, hashes), len(tokens) - 1)
        n = np.where(tokens[at] == hashes, counts[at], 0)
    return hashes[np.lexsort((hashes, n))][: len(hashes) // 5 + 1]


def _by_hubs(index: DataFrame) -> DataFrame:
    """a, b (a < b): each set against the hub of each of its shingles."""
    hubs = index.groupBy("token").agg(F.min_by(F.struct("c", "n"), F.xxhash64(F.lit(5), "c")).alias("hub"))
    met = index.join(hubs, "token").where("c <> hub.c AND n * 4 <= hub.n * 5 AND hub.n * 4 <= n * 5")
    return met.select(F.least("c", "hub.c").alias("a"), F.greatest("c", "hub.c").alias("b"))


def _open_pairs(index: DataFrame, joined: DataFrame) -> DataFrame:
    """a, b (a < b): pairs that share a shingle of their prefixes, aren't in one component, and may be similar."""
    named = index.join(joined, index["c"] == joined["node"], "left").select("token", "c", "n", "pos", F.coalesce("component", "c").alias("comp"))
    several = named.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("token")
    named = stored(named.join(several, "token"), "open")
    one, two = (named.select("token", *(F.col(k).alias(f"{k}_{s}") for k in ("c", "n", "pos", "comp"))) for s in "ab")
    met = one.join(two, "token").where("c_a < c_b AND comp_a <> comp_b AND n_a * 4 <= n_b * 5 AND n_b * 4 <= n_a * 5")
    # What stands before the shared shingle, itself, and what stands after it.
    most = F.least("pos_a", "pos_b") + 1 + F.least(F.expr("n_a - 1 - pos_a"), F.expr("n_b - 1 - pos_b"))
    counted = met.where(9 * most >= 4 * (F.col("n_a") + F.col("n_b"))).groupBy("c_a", "c_b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("shared"))
    # Beyond what their prefixes share, two sets have at most the rest of the longer rest in common.
    rest = F.greatest(F.expr("n_a - (n_a div 5 + 1)"), F.expr("n_b - (n_b div 5 + 1)"))
    return counted.where(9 * (F.col("shared") + rest) >= 4 * (F.col("n_a") + F.col("n_b"))).select(F.col("c_a").alias("a"), F.col("c_b").alias("b"))


def _by_fingerprints(sets: DataFrame) -> DataFrame:
    """a, b (a < b): for each fingerprint the least class against the others, and against the least of each fingerprint within two bits."""
    prints = sets.select("c", "fp").distinct()
    least = stored(prints.groupBy("fp").agg(F.min("c").alias("least")), "prints")
    same = prints.join(least, "fp").where("c <> least").select(F.col("least").alias("a"), F.col("c").alias("b"))
    near = simhash.links(least.select("fp"))
    one, two = (least.select(F.col("fp").alias(k), F.col("least").alias(f"of_{k}")) for k in "ab")
    found = near.join(one, "a").join(two, "b").select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return same.unionByName(found)


def _verified(pairs: DataFrame, rows: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs with a similarity of 0.8 or more, by their whole sets."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        c, found = batch.column(0).to_pylist(), [shingles(t) for t in batch.column(1).to_pylist()]
        right = [i for i, h in enumerate(found) if _class(h) == c[i]]
        return pa.RecordBatch.from_arrays([pa.array([c[i] for i in right], pa.int64()), pa.array([found[i].view(np.int64) for i in right], pa.list_(pa.int64()))], ["c", "tokens"])

    pairs = stored(pairs, "pairs")
    tidy(rows.sparkSession)
    asked = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    # Different texts can share an id: the set must be that of the class. Repeats go by keys that hold the join's, so that sets, which
    # are larger than their texts, aren't shuffled for it.
    named = classes.join(asked, "c").select("c", F.col("least").alias("doc_id"), "print")
    texts = rows.join(named, "doc_id").where(F.xxhash64("text") == F.col("print")).dropDuplicates(["doc_id", "c", "print"]).select("c", "text")
    sets = stored(map_arrow(texts, run, "c long, tokens array<long>"), "sets")
    tidy(rows.sparkSession)
    one, two = (sets.select(F.col("c").alias(k), F.col("tokens").alias(f"of_{k}")) for k in "ab")
    both = pairs.join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("of_a", "of_b")))
    found = stored(both.where("9 * common >= 4 * (size(of_a) + size(of_b))").select("a", "b"), "links")
    discard(pairs, sets)
    tidy(rows.sparkSession)
    return found


def near_duplicates(df: DataFrame) -> DataFrame:
    """doc_id, c (texts with the same shingles share it), component_id: the least id among the documents reachable by links."""
    rows = df.select("doc_id", whole_text().alias("text"))
    frequent = _frequent(rows)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        every = [runs(t) for t in batch.column(1).to_pylist()]
        prints = np.array([simhash.majority(h) for h in every], np.uint64).view(np.int64)
        found = [np.unique(h) for h in every]
        first = pa.array([prefix(h, frequent).view(np.int64) for h in found], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([_class(h) for h in found], pa.int64()), pa.array([len(h) for h in found], pa.int64()), pa.array(prints), first], ["doc_id", "c", "n", "fp", "prefix"]).append_column("print", batch.column(2))

    kind = df.schema["doc_id"].dataType.simpleString()
    sets = stored(map_arrow(rows.withColumn("print", F.xxhash64("text")), run, f"doc_id {kind}, c long, n long, fp long, prefix array<long>, print long"), "shingles")
    index = sets.dropDuplicates(["c"]).select("c", "n", F.posexplode("prefix").alias("pos", "token"))
    index = stored(index, "index")
    # Prefixes are most of what is stored, and aren't needed any more.
    full, sets = sets, stored(sets.drop("prefix"), "classes")
    discard(full)
    # print: of which text, as several can share the least id.
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "print")))
    classes = sets.groupBy("c").agg(first.alias("first")).select("c", F.col("first.doc_id").alias("least"), "first.print")
    again = index.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("token")
    every, index = index, stored(index.join(again, "token"), "shared")
    discard(every)
    tidy(df.sparkSession)
    links = _verified(_by_hubs(index).unionByName(_by_fingerprints(sets)).distinct(), rows, classes)
    joined = stored(components(links), "joined")
    links = links.unionByName(_verified(_open_pairs(index, joined), rows, classes))
    linked = components(links)
    named = classes.join(linked, classes["c"] == linked["node"], "left").select("c", "least", F.coalesce("component", "c").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return sets.select("doc_id", "c").join(named.join(lowest, "component").select("c", "component_id"), "c").select("doc_id", "c", "component_id")


def kept(df: DataFrame) -> DataFrame:
    """The rows of df without near copies: of each component the row with its least doc_id (one of several equal ids). Rows without an id stay."""
    found = near_duplicates(df.where("doc_id IS NOT NULL").select("doc_id", "text"))
    key = fresh(df.columns, "_id")[0]
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    rows = df.join(first, df["doc_id"] == first[key], "left_semi").dropDuplicates(["doc_id"])
    return rows.unionByName(df.where("doc_id IS NULL"))
