"""What five filters remove from whole texts, in each of their 120 orders, from 32 signed sums.

A document's failed conditions are a mask of five bits. Per part and label (quality 1, toxic 1) one aggregation makes
the 32 Walsh-Hadamard sums: for each set of bits the number of documents that fail an even number of its conditions
less those that fail an odd number. The transform is its own inverse but for a factor of 32, so the sums give back the
exact number of documents of each mask; all orders and steps, and each filter's Shapley value (120 divided by the
number of failed conditions, for each document that fails it), follow from these without another pass.

Condition E, a text that a smaller doc_id has too, is found by two shuffles of narrow rows: the least doc_id of each
text's SHA-256, then a join by doc_id and digest, in which the copies of one text are spread by their ids.

Defined results: a null text counts as empty (it fails A, and E if a smaller id has an empty or null text); an empty
text has no words and no characters, so that it passes B and C; a null part is the empty string; rows of a text that share its
smallest id all pass E; a null id is never smaller or larger, so that it passes E, and has no label; a row without a label, or with a
null one, has none; of several label rows of an id one that says 1 is enough. Repeated rows count each for itself; an
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, whole_text

# The filters and their thresholds.
FILTERS = "ABCDE"
FEWEST_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 3
SYMBOLS = r"[#$%&*|]"
#: A power of two, so that the inverse divides by a shift.
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
LABELS = ("all", "good", "toxic")


def _bit(letter: str) -> int:
    return 1 << FILTERS.index(letter)


def own_mask(text: Column) -> Column:
    """Bits of the conditions that a text fails by itself: A to D."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    n = F.size(words)
    capitals = F.char_length(F.regexp_replace(text, "[^A-Z]+", ""))
    fails = {
        "A": n < FEWEST_WORDS, "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * DISTINCT_SHARE,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * CAPITAL_SHARE, "D": text.rlike(SYMBOLS),
    }
    return sum((F.when(bad, _bit(k)).otherwise(0) for k, bad in fails.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """part, mask, good, toxic: a row for each document."""
    text = whole_text()
    rows = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), own_mask(text).alias("own"))
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "digest", F.lit(True).alias("first"))
    told = labels.where("quality = 1 OR toxic = 1").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    copy = F.col("first").isNull() & F.col("doc_id").isNotNull()
    met = rows.join(first, ["doc_id", "digest"], "left").join(told, "doc_id", "left")
    flags = [F.coalesce(c, F.lit(0)).cast("int").alias(c) for c in ("good", "toxic")]
    return met.select("part", (F.col("own") + F.when(copy, _bit("E")).otherwise(0)).alias("mask"), *flags)


def parity_sums(found: DataFrame) -> DataFrame:
    """part, good, toxic and w0 to w31: sums of 1 or -1 by the parity of the failed conditions among each set of them."""
    signs = [F.sum(F.when(F.bit_count(F.col("mask").bitwiseAND(F.lit(s))) % 2 == 0, 1).otherwise(-1)).alias(f"w{s}") for s in range(MASKS)]
    return found.groupBy("part", "good", "toxic").agg(*signs)


def cells(sums: DataFrame) -> DataFrame:
    """part, and for all documents, the good and the toxic ones an array of the number of documents of each mask."""

    def counts(of: Column) -> list[Column]:
        total = [F.sum(F.when(of, F.col(f"w{s}")).otherwise(0)) for s in range(MASKS)]
        return F.array(*total)

    held = sums.groupBy("part").agg(counts(F.lit(True)).alias("all"), counts(F.col("good") == 1).alias("good"), counts(F.col("toxic") == 1).alias("toxic"))

    def inverted(name: str) -> Column:
        def cell(m: Column) -> Column:
            signed = F.zip_with(name, F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda w, s: F.when(F.bit_count(s.bitwiseAND(m)) % 2 == 0, w).otherwise(-w))
            return F.aggregate(signed, F.lit(0).cast("long"), lambda a, x: a + x).cast("long")

        return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), lambda m: F.shiftright(cell(m), len(FILTERS))).alias(name)

    return held.select("part", *[inverted(name) for name in LABELS])


def evaluated(counted: DataFrame) -> DataFrame:
    """The 600 rows of each part: for each order and step what the step's filter keeps and removes."""
    shapley = [sum((F.get("all", F.lit(m)) * (120 // m.bit_count()) for m in range(MASKS) if m & (1 << i)), F.lit(0)) for i in range(len(FILTERS))]
    base = counted.withColumn("shares", F.array(*shapley)).withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS))))
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    place = F.instr(F.lit(FILTERS), letter)
    powers = F.array(*[F.lit(_bit(k)) for k in FILTERS])
    bits = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda k: F.element_at(powers, F.instr(F.lit(FILTERS), F.substring("filter_order", k, F.lit(1)))))
    steps = base.withColumn("bits", bits).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    before = F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b)
    steps = steps.withColumns({"place": place, "own": F.element_at("bits", F.col("step")), "before": before})

    def total(name: str, fits) -> Column:
        met = F.filter(F.transform(name, lambda n, m: F.struct(n.alias("n"), m.alias("m"))), lambda x: fits(x["m"]))
        return F.aggregate(met, F.lit(0).cast("long"), lambda a, x: a + x["n"])

    own, gone = F.col("own"), F.col("before")
    now = lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(gone) == 0)
    return steps.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"),
        total("all", lambda m: m.bitwiseAND(gone + own) == 0).alias("kept"), total("all", now).alias("removed"),
        total("all", lambda m: (m.bitwiseAND(own) != 0) & (m.bitwiseAND(gone) != 0)).alias("redundant"),
        F.element_at("all", own + 1).alias("unique_fails"), total("good", now).alias("good_lost"), total("toxic", now).alias("toxic_lost"),
        F.element_at("shares", F.col("place")).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    return evaluated(cells(parity_sums(masks(docs, labels, part))))
