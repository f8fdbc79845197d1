"""Collocations of two to five words, counted by pivot partitioning.

Three passes over the texts, each by Arrow batches:

1. Words of each language are counted; those below `least` can be in no candidate and end fragments from here on.
2. Pairs of neighbours are counted by slots of a hash; pairs whose slot is below `least` end fragments as well.
3. Around each word, its fragment holds the neighbours (four on each side at most) that aren't rarer than it is, up to
   the first that is, or up to an end. The fragment goes to the partition of that word, the pivot; equal fragments of a
   batch go once, with their number. There all phrases of the fragment that hold the pivot are counted: an occurrence
   of a phrase is counted at its rarest word alone (at the leftmost, if that word comes again), so that no other
   partition has to know of it.

What tells rare words from others is a table of SLOTS classes of frequency, one for each slot of the words' CRC-32, and
of frequent pairs a table of PAIR_SLOTS flags: their size is fixed, however many words there are, so that they are
broadcast. Words that share a slot with a more frequent word count as that frequent while fragments are made, which
makes some of them longer and changes no count (pairs likewise): all counts are by whole words. The fragments of a hot pivot are dealt
to as many shares as its frequency asks for, and the shares' counts are added.

Defined results: a null text counts as empty, a null language is `und`, as is one so named; only A-Z are lower-cased;
repeated rows count each for itself; an empty table gives an empty result; other columns don't matter. A task needs
memory for about twenty times its longest text.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, slices, stored, whole_text

LONGEST, LEAST, BEST, SHARE = 5, 100, 2000, 100
#: Slots of the classes of words, of the flags of pairs; ratio between neighbouring classes.
SLOTS, PAIR_SLOTS, RATIO = 1 << 20, 1 << 22, 1.05
#: Occurrences of a pivot to a share of its fragments, about.
SHARE_ROWS = 5_000
#: Rows that a task holds before equal ones are added up.
BUFFERED = 1 << 20
#: Buckets of pivots and their shares: so many at least, and one for so many words of the input.
BUCKETS, BUCKET_WORDS = 1 << 12, 2_000_000
#: Pairs are counted by the slots of a range that the number of flags divides.
SPREAD, PAIR_RANGE = 1_000_003, 1 << 31
# Blanks between words, and what ends a piece.
BLANKS, ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(ENDS)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Words:
    """The words of a batch's texts in order. units: words as of a language, each once; at: the unit of each word; joined: whether a word has a right neighbour in its piece."""

    def __init__(self, langs: pa.Array, texts: pa.Array):
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        raw = _LOWER[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        begins = np.unique(offsets[:-1] - offsets[0])
        begins = begins[begins < len(raw)]
        kind = _KIND[raw]
        inside = kind == 0
        starts, ends = inside.copy(), inside.copy()
        starts[1:] &= ~inside[:-1]
        starts[begins] = inside[begins]
        ends[:-1] &= ~inside[1:]
        inner = begins[begins > 0]
        ends[inner - 1] = inside[inner - 1]
        starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
        self.n = len(starts)
        row = np.searchsorted(offsets - offsets[0], starts, "right") - 1
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        self.joined = np.zeros(self.n, bool)
        self.joined[:-1] = (row[1:] == row[:-1]) & (piece[1:] == piece[:-1])
        places = np.zeros(self.n + 1, np.int32)
        np.cumsum(ends - starts, out=places[1:])
        words = pa.Array.from_buffers(pa.string(), self.n, [None, pa.py_buffer(places), pa.py_buffer(raw[inside])]).dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        langs = langs.dictionary_encode()
        lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row]
        units, self.at = np.unique(lang * max(1, len(words.dictionary)) + codes, return_inverse=True)
        self.lang = langs.dictionary.take(pa.array(units // max(1, len(words.dictionary))))
        self.word = words.dictionary.take(pa.array(units % max(1, len(words.dictionary))))

    def sums(self) -> np.ndarray:
        """CRC-32 of each unit."""
        return np.array([zlib.crc32(f"{a}\0{b}".encode()) for a, b in zip(self.lang.to_pylist(), self.word.to_pylist())], np.int64)

    def ranked(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit the class of its frequency (0: below the least), its rank (larger: rarer; ties by the word, alike in all batches), and its CRC-32."""
        sums = self.sums()
        found = classes[sums % len(classes)].astype(np.int64)
        rank = np.empty(len(found), np.int64)
        by_word = pc.rank(self.word, tiebreaker="dense").to_numpy().astype(np.int64) if len(found) else found
        rank[np.lexsort((by_word, -found))] = np.arange(len(found))
        # Units of one word in two languages may differ in rank; they never meet in a fragment.
        return found, rank, sums


def _shares(of: np.ndarray, least: int, rows: int) -> np.ndarray:
    """Into how many shares the fragments of a pivot of this class are dealt."""
    return np.maximum(1, least * np.exp(np.minimum(of, 700) * np.log(RATIO)) // rows).astype(np.int64)


def _added(held: list[pa.RecordBatch]) -> pa.Table:
    """The rows of batches with n added up over those that are equal in all else."""
    names = held[0].schema.names
    return pa.Table.from_batches(held).group_by([c for c in names if c != "n"], use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(names)


def _mapped(df: DataFrame, f: Callable[[Words], pa.RecordBatch | None], schema: str, after: Callable[[pa.Table], pa.Table] = lambda t: t) -> DataFrame:
    """What f makes of each batch, with n added up over equal rows of a task (as far as BUFFERED rows go), so that each goes through the shuffle once; then what `after` makes of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                words = Words(*piece.columns)
                out = f(words) if words.n else None
                if out is not None and out.num_rows:
                    held.append(out)
                if sum(x.num_rows for x in held) > BUFFERED:
                    yield from after(_added(held)).to_batches(max_chunksize=1 << 14)
                    held = []
        if held:
            yield from after(_added(held)).to_batches(max_chunksize=1 << 14)

    return df.mapInArrow(run, schema)


def _by_bucket(found: pa.Table, buckets: int) -> pa.Table:
    """Fragments in lists, one for each bucket of pivots and their shares; equal fragments come to the same share."""
    shares = found["shares"].to_numpy()
    share = np.zeros(len(shares), np.int64)
    split = np.flatnonzero(shares > 1)
    texts = found["fragment"].take(pa.array(split)).to_pylist()
    share[split] = np.array([zlib.crc32(t.encode()) for t in texts], np.int64) % shares[split]
    bucket = (found["pivot"].to_numpy().astype(np.int64) * SPREAD + share * 7_919) % buckets
    found = found.append_column("bucket", pa.array(bucket.astype(np.int32))).append_column("split", pa.array(shares > 1))
    found = found.sort_by([(c, "ascending") for c in ("bucket", "lang", "pivot", "fragment")]).combine_chunks()
    bucket = found["bucket"].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
    inner = ["lang", "split", "fragment", "at", "n"]
    rows = pa.StructArray.from_arrays([found[c].combine_chunks() for c in inner], inner)
    return pa.table({"bucket": pa.array(bucket[starts]), "fragments": pa.ListArray.from_arrays(pa.array(np.append(starts, len(bucket)).astype(np.int32)), rows)})


def count_words(texts: DataFrame) -> DataFrame:
    """lang, word, n."""

    def count(words: Words) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([words.lang, words.word, pa.array(np.bincount(words.at).astype(np.int64))], ["lang", "word", "n"])

    return _mapped(texts, count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _slot(word: Column) -> Column:
    return F.crc32(F.encode(F.concat("lang", F.lit("\0"), word), "UTF-8"))


def word_classes(frequent: DataFrame, least: int, slots: int = SLOTS) -> np.ndarray:
    """A class of frequency for each slot: 0 where no frequent word (lang, word, n) is. At most `slots` numbers come to the driver."""
    of = F.floor(F.log(F.col("n") / F.lit(float(least))) / F.lit(float(np.log(RATIO)))) + 1
    found = frequent.groupBy((_slot(F.col("word")) % slots).cast("int").alias("slot")).agg(F.max(of).cast("short").alias("c")).toArrow()
    classes = np.zeros(slots, np.uint16)
    classes[found["slot"].to_numpy()] = found["c"].to_numpy()
    return classes


def _pairs(words: Words, of: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of words with a right neighbour, both frequent, and the pairs' slots."""
    at = words.at
    i = np.flatnonzero(words.joined)
    i = i[(of[at[i]] > 0) & (of[at[i + 1]] > 0)]
    return i, (sums[at[i]] * SPREAD + sums[at[i + 1]]) % PAIR_RANGE


def pair_flags(texts: DataFrame, classes, least: int, slots: int = PAIR_SLOTS) -> np.ndarray:
    """A flag for each slot that a pair with `least` occurrences may be in. At most `slots` numbers come to the driver."""

    def count(words: Words) -> pa.RecordBatch:
        of, _, sums = words.ranked(classes.value)
        found, n = np.unique(_pairs(words, of, sums)[1], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], ["slot", "n"])

    often = _mapped(texts, count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    flags = np.zeros(slots, bool)
    flags[often.select((F.col("slot") % slots).alias("slot")).distinct().toArrow()["slot"].to_numpy()] = True
    return flags


def fragments(texts: DataFrame, classes, flags, least: int, longest: int = LONGEST, share_rows: int = SHARE_ROWS, buckets: int = BUCKETS) -> DataFrame:
    """bucket (of the pivot, by its CRC-32, and its share), fragments (lang, split: whether the pivot has more shares, fragment, at: the pivot's place, n): of two words or more whose neighbours may be frequent pairs."""
    reach = longest - 1

    def cut(words: Words) -> pa.RecordBatch | None:
        of, rank, sums = words.ranked(classes.value)
        near = flags.value
        at = words.at
        ranks, frequent = rank[at], of[at] > 0
        link = np.zeros(words.n, bool)
        i, slot = _pairs(words, of, sums)
        link[i] = near[slot % len(near)]
        left, right = np.zeros(words.n, np.int8), np.zeros(words.n, np.int8)
        alive, beyond = frequent.copy(), frequent.copy()
        for d in range(1, min(longest, words.n)):
            # Left of the pivot only words more frequent than it, so that of several places of the pivot the first counts.
            alive[:d] = False
            alive[d:] &= link[:-d] & (ranks[:-d] < ranks[d:])
            left += alive
            beyond[-d:] = False
            beyond[:-d] &= link[d - 1 : -1] & (ranks[d:] <= ranks[:-d])
            right += beyond
        anchors = np.flatnonzero(left + right)
        if not len(anchors):
            return None
        around = anchors[:, None] + np.arange(-reach, reach + 1)
        held = (np.arange(-reach, reach + 1) >= -left[anchors][:, None]) & (np.arange(-reach, reach + 1) <= right[anchors][:, None])
        codes = np.where(held, at[np.clip(around, 0, words.n - 1)], -1).astype(np.int32)
        rows, n = np.unique(np.ascontiguousarray(codes).view(np.dtype((np.void, codes.dtype.itemsize * codes.shape[1]))).ravel(), return_counts=True)
        codes = rows.view(np.int32).reshape(-1, 2 * reach + 1)
        held = codes >= 0
        places = np.zeros(len(codes) + 1, np.int32)
        np.cumsum(held.sum(1), out=places[1:])
        text = pc.binary_join(pa.ListArray.from_arrays(pa.array(places), words.word.take(pa.array(codes[held]))), " ")
        pivot = codes[:, reach]
        unit = pa.array(pivot)
        return pa.RecordBatch.from_arrays([words.lang.take(unit), pa.array(sums[pivot].astype(np.int32, casting="unsafe")), pa.array(_shares(of[pivot], least, share_rows).astype(np.int32)), text, pa.array(held[:, :reach].sum(1).astype(np.int32)), pa.array(n.astype(np.int64))], ["lang", "pivot", "shares", "fragment", "at", "n"])

    return _mapped(texts, cut, "bucket int, fragments array<struct<lang:string,split:boolean,fragment:string,at:int,n:bigint>>", lambda t: _by_bucket(t, buckets))


def mined(found: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """lang, phrase, n of the phrases of two words and more that pivots own, from their fragments."""
    routed = found.repartition("bucket").select("bucket", F.inline("fragments"))
    words, at = F.split("fragment", " "), F.col("at")

    def ends(start: Column) -> Column:
        lo, hi = F.greatest(at, start + 1), F.least(F.size("words") - 1, start + longest - 1)
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda end: F.array_join(F.slice("words", start + 1, end - start + 1), " "))).otherwise(F.array().cast("array<string>"))

    phrases = F.flatten(F.transform(F.sequence(F.lit(0), at), ends))
    own = routed.withColumn("words", words).select("bucket", "lang", "split", F.explode(phrases).alias("phrase"), "n")
    counted = own.groupBy("bucket", "lang", "split", "phrase").agg(F.sum("n").alias("n"))
    # Where pivots have one share, all that there is of their phrases is here.
    return counted.where(F.col("split") | (F.col("n") >= least)).groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _part(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("words", first, n), " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of each phrase (lang, phrase, n; words too) of two words or more: that of its lowest cut. Exact: products are decimals of 38 digits."""
    many = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 1)
    cuts = many.select("lang", "phrase", F.col("n").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(F.lit(1), F.col("k")).alias("first"), _part(F.col("k") + 1, F.size("words") - F.col("k")).alias("rest"))
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    met = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).join(totals, "lang")
    score = F.expr("(cast(1000 as decimal(4, 0)) * cast(a as decimal(14, 0)) * cast(n as decimal(18, 0))) div (cast(l as decimal(19, 0)) * cast(r as decimal(19, 0)))")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"), F.first("n").alias("n"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


def covered(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """lang, phrase of those inside a longer one with `share` percent of their count at least.

    A phrase between the two has at least the longer one's count, so that those longer by one word tell.
    """
    longer = phrases.withColumn("words", F.split("phrase", " ")).where(F.size("words") > 2)
    inner = longer.select("lang", F.explode(F.array(_part(F.lit(1), F.size("words") - 1), _part(F.lit(2), F.size("words") - 1))).alias("phrase"), F.col("n").alias("most"))
    met = inner.groupBy("lang", "phrase").agg(F.max("most").alias("most")).join(phrases, ["lang", "phrase"])
    return met.where(F.col("most") * 100 >= F.col("n") * share).select("lang", "phrase")


def collocations(df: DataFrame, least: int = LEAST, longest: int = LONGEST, best: int = BEST, share: int = SHARE, slots: int = SLOTS, pair_slots: int = PAIR_SLOTS, share_rows: int = SHARE_ROWS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's `best` phrases."""
    context = df.sparkSession.sparkContext
    texts = df.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), whole_text().alias("text"))
    counts = stored(count_words(texts), "words")
    totals = stored(counts.groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    frequent = counts.where(F.col("n") >= least)
    classes = context.broadcast(word_classes(frequent, least, slots))
    flags = context.broadcast(pair_flags(texts, classes, least, pair_slots))
    buckets = max(BUCKETS, (totals.agg(F.sum("n")).first()[0] or 0) // BUCKET_WORDS)
    longer = mined(fragments(texts, classes, flags, least, longest, share_rows, buckets), least, longest)
    phrases = stored(frequent.select("lang", F.col("word").alias("phrase"), "n").unionByName(longer), "phrases")
    discard(counts)
    kept = scored(phrases, totals).join(covered(phrases, share), ["lang", "phrase"], "left_anti")
    # First within shares of a language, so that a large one isn't sorted by one task.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for by in (["lang", F.pmod(F.xxhash64("phrase"), F.lit(64))], ["lang"]):
        kept = kept.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col("rank") <= best)
    return kept.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
