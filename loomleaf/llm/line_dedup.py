"""Line dedup by content-defined chunks of lines.

A text's lines are its units; a line of WIDE words or more is cut into pieces where the hash of a word pair is least
among its neighbours (about every fifth word), so that passages within long lines are found too. A rolling hash over the
hashes of two adjacent units marks those unit ends as ends of a chunk where it is less than at the next: chunks are runs
of two units on average, and text before or after a passage doesn't shift those within it. Chunks whose digest occurs in more
than one document are compared byte for byte with that of the document first by doc_id, which stays; from the first and last of a
run of equal chunks the comparison goes on word by word, up to REACH words to each side. Runs of PASSAGE words or more
are removed, except in the first document.

Defined results: a null text stays null; a document that loses all lines has an empty text; runs of fewer than PASSAGE
words stay; a passage that repeats only within one document stays; rows equal in id and text share one decision; ties
of doc_id go by a hash of the text, null ids come first; empty tables give empty results; other columns stay, whatever
their names. Documents are told apart by 64-bit hashes of id and text: two that share one would count as one document,
but nothing is removed that isn't equal to a chunk that stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, fresh, map_arrow, stored, tidy, whole_text

#: Words of a line that is cut, word pairs looked at to each side of a cut; words of a run that goes, words looked at beyond its ends.
WIDE, AROUND, PASSAGE, REACH = 6, 2, 25, 40
#: Bytes of text that are cut into chunks together, and documents with one digest in one group.
BLOCK, GROUP = 1 << 20, 512
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(29)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _R)) * _P
    return x ^ (x >> np.uint64(32))


def _joint(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of each run of values, by their order; runs begin at starts and aren't empty."""
    n = len(values)
    lengths = np.diff(np.r_[starts, n])
    at = np.arange(n) - np.repeat(starts, lengths)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(int(lengths.max(initial=1)), _Q, np.uint64)], dtype=np.uint64)
    return _mixed(np.add.reduceat(values * powers[at], starts) + lengths.astype(np.uint64))


class Cut:
    """The chunks of several texts (bytes): words by their first and last bytes, chunks by their first words, texts by their first chunks."""

    def __init__(self, texts: list[bytes]):
        data = b"\n".join([*texts, b""])
        raw = np.frombuffer(data, np.uint8)
        blank = np.r_[True, SPACE[raw]]
        edge = np.diff(blank.view(np.int8))
        self.data, self.first = data, np.nonzero(edge == -1)[0]
        self.last = np.nonzero(edge == 1)[0]
        self.begin = np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]
        #: The first word of each text, and one more.
        self.words = np.searchsorted(self.first, np.r_[self.begin, len(data) + 1])
        n = len(self.first)
        if not n:
            self.chunk, self.digest, self.chunks = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
            return
        # Bytes between words belong to the word before; they count nothing.
        word = _joint(np.where(blank[1:], 0, raw.astype(np.uint64) + np.uint64(1))[self.first[0] :], self.first - self.first[0])
        text = np.zeros(n + 1, bool)
        text[self.words] = True
        line = np.searchsorted(np.nonzero(raw == 10)[0], self.first)
        fresh_line = np.r_[True, line[1:] != line[:-1]]
        starts = np.nonzero(fresh_line)[0]
        wide = np.repeat(np.diff(np.r_[starts, n]), np.diff(np.r_[starts, n])) >= WIDE
        opens = text[:-1]
        pair = _mixed(np.where(opens, np.uint64(0), np.r_[np.uint64(0), word[:-1]]) * _Q + word)
        # A piece ends after such a pair. Pairs of other texts count nothing.
        ends, own = wide, np.cumsum(opens)
        for k in range(1, AROUND + 1):
            below = (pair[:-k] < pair[k:]) | (own[:-k] != own[k:])
            above = (pair[k:] < pair[:-k]) | (own[:-k] != own[k:])
            ends = ends & np.r_[below, np.ones(min(k, n), bool)][:n] & np.r_[np.ones(min(k, n), bool), above][:n]
        unit = np.nonzero(fresh_line | np.r_[False, ends[:-1]] | text[:-1])[0]
        value = _joint(word, unit)
        # The end of a unit, by itself and the next one.
        roll = _mixed(value * _P + np.r_[value[1:], np.uint64(0)] * _Q)
        opens = text[unit]
        closes = np.r_[opens[1:], True]
        less = (roll < np.r_[roll[1:], np.uint64(0)]) & ~closes & ~np.r_[closes[1:], True]
        self.chunk = unit[opens | np.r_[False, less[:-1]]]
        self.digest = _joint(word, self.chunk)
        self.chunks = np.searchsorted(self.chunk, self.words)

    def span(self, word: int, to: int) -> bytes:
        """The bytes from the first of a word to the last of that before `to`."""
        return self.data[self.first[word] : self.last[to - 1]]

    def end(self, chunk: int) -> int:
        """The word after a chunk."""
        return int(self.chunk[chunk + 1]) if chunk + 1 < len(self.chunk) else len(self.first)


def chunks(text: str) -> list[str]:
    """The chunks of one text, without the white space between them."""
    cut = Cut([text.encode()])
    return [cut.span(int(w), cut.end(i)).decode() for i, w in enumerate(cut.chunk)]


def _blocks(texts: list[str]) -> Iterator[tuple[int, list[bytes]]]:
    start, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append((t or "").encode())
        size += len(held[-1])
        if size >= BLOCK:
            yield start, held
            start, held, size = i + 1, [], 0
    if held:
        yield start, held


def _row() -> Column:
    return F.xxhash64(F.col("doc_id").cast("string"), whole_text())


def _digests(batch: pa.RecordBatch) -> pa.RecordBatch:
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start, texts in _blocks(batch.column("text").to_pylist()):
        cut = Cut(texts)
        at.append(np.repeat(np.arange(start, start + len(texts)), np.diff(cut.chunks)))
        found.append(cut.digest)
    at, found = np.concatenate(at), np.concatenate(found)
    # Each chunk once in a text.
    order = np.lexsort((found, at))
    at, found = at[order], found[order]
    once = np.r_[True, (at[1:] != at[:-1]) | (found[1:] != found[:-1])][: len(at)]
    at = pa.array(at[once])
    return pa.RecordBatch.from_arrays([batch.column("_row").take(at), batch.column("_id").take(at), pa.array(found[once].view(np.int64))], ["_row", "_id", "digest"])


def _runs(flags: np.ndarray, base: int = 0) -> list[tuple[int, int]]:
    """The runs of flagged chunks, of which the first has the number `base`."""
    edges = np.diff(np.r_[False, flags, False].astype(np.int8))
    return [(int(a + base), int(b + base)) for a, b in zip(np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0])]


def _holders(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Each chunk that stays in a text for others, with the words before and after where it is at the end of a run of such chunks."""
    digests, texts, lefts, rights = [], [], [], []
    holds = batch.column("holds").to_pylist()
    for start, block in _blocks(batch.column("text").to_pylist()):
        cut = Cut(block)
        signed = cut.digest.view(np.int64)
        for k in range(len(block)):
            own = slice(cut.chunks[k], cut.chunks[k + 1])
            flags, told = np.isin(signed[own], holds[start + k]), set()
            for a, b in _runs(flags, cut.chunks[k]):
                for c in range(a, b):
                    if signed[c] in told:
                        continue
                    told.add(signed[c])
                    word, to = int(cut.chunk[c]), cut.end(c)
                    digests.append(signed[c])
                    texts.append(cut.span(word, to))
                    low, high = max(int(cut.words[k]), word - REACH), min(int(cut.words[k + 1]), to + REACH)
                    lefts.append((cut.span(low, word) if low < word else b"") if c == a else None)
                    rights.append((cut.span(to, high) if to < high else b"") if c == b - 1 else None)
    return pa.RecordBatch.from_arrays([pa.array(digests, pa.int64()), *(pa.array(x, pa.binary()) for x in (texts, lefts, rights))], ["digest", "chunk", "before", "after"])


def removals(df: DataFrame) -> DataFrame:
    """_row, gone: digests of the chunks that a document may lose, with the bytes of the one that stays and what stands before and after that."""
    kind = df.schema["doc_id"].dataType.simpleString()
    rows = df.select(_row().alias("_row"), F.col("doc_id").alias("_id"), whole_text().alias("text"))
    held = stored(map_arrow(rows, _digests, f"_row long, _id {kind}, digest long", BLOCK), "chunks")
    repeated = held.groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest")
    matches = stored(held.join(repeated, "digest"), "matches")
    discard(held)
    tidy(df.sparkSession)
    first = matches.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("_id", "_row")).alias("first"))
    first = stored(first.select("digest", F.ceil(F.col("n") / GROUP).cast("int").alias("shares"), F.col("first._row").alias("holder")), "first")
    holds = first.groupBy(F.col("holder").alias("_row")).agg(F.collect_list("digest").alias("holds"))
    texts = map_arrow(rows.select("_row", "text").join(holds, "_row").select("text", "holds"), _holders, "digest long, chunk binary, before binary, after binary", BLOCK)
    # Rows equal in id and text may tell a chunk twice.
    held_texts = stored(texts.dropDuplicates(["digest"]), "texts")
    tidy(df.sparkSession)
    # A chunk of many documents meets them in several groups.
    share = F.pmod(F.xxhash64("_row"), F.col("shares")).cast("int")
    lost = matches.select("_row", "digest").join(first, "digest").where("_row <> holder").select("_row", "digest", share.alias("share"))
    each = held_texts.join(first, "digest").select("digest", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "chunk", "before", "after")
    met = lost.join(each, ["digest", "share"])
    gone = stored(met.groupBy("_row").agg(F.collect_list(F.struct("digest", "chunk", "before", "after")).alias("gone")), "gone")
    discard(matches, first, held_texts)
    tidy(df.sparkSession)
    return gone


def _shared(a: list[bytes], b: list[bytes]) -> int:
    """How many words two lists have in common from their start."""
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def _without(cut: Cut, k: int, text: bytes, lost: dict[int, tuple]) -> bytes:
    """The k-th text without those runs of lost chunks (digest: bytes, what stands before and after) that have PASSAGE words or more."""
    first, last, base = cut.first, cut.last, int(cut.begin[k])
    start, stop = int(cut.words[k]), int(cut.words[k + 1])
    spans = []
    c, end = int(cut.chunks[k]), int(cut.chunks[k + 1])
    digests = cut.digest[c:end].view(np.int64).tolist()
    edges = [*cut.chunk[c:end].tolist(), stop]
    data, before = cut.data, None
    firsts, lasts = first[edges[:-1]].tolist(), last[np.array(edges[1:]) - 1].tolist()
    for i, d in enumerate(digests):
        there = lost.get(d)
        if there is None or data[firsts[i] : lasts[i]] != there[0]:
            before = None
            continue
        if before is None:
            word, low = edges[i], max(start, edges[i] - REACH)
            if there[1] and low < word:
                word -= _shared(there[1].split()[::-1], cut.span(low, word).split()[::-1])
            spans.append([word, edges[i + 1], there[2]])
        else:
            spans[-1][1:] = edges[i + 1], there[2]
        before = there
    runs: list[list[int]] = []
    for word, to, after in spans:
        high = min(stop, to + REACH)
        if after and to < high:
            to += _shared(after.split(), cut.span(to, high).split())
        if runs and word <= runs[-1][1]:
            runs[-1][1] = max(to, runs[-1][1])
        else:
            runs.append([word, to])
    out, done = [], 0
    for word, to in runs:
        if to - word < PASSAGE:
            continue
        a, b = int(first[word]) - base, int(first[to]) - base if to < stop else len(text)
        kept = text[done:a]
        if b == len(text):
            kept = kept.rstrip()
        elif b"\n" in text[int(last[to - 1]) - base : b] and (kept.rstrip(b" \t\r") or b"\n")[-1:] != b"\n":
            # From within a line to its end: the line end stays.
            kept, b = kept.rstrip(), int(last[to - 1]) - base
        out.append(kept)
        done = b
    return b"".join([*out, text[done:]])


def _shorten(texts: list[str | None], gone: pa.ListArray) -> list[str | None]:
    flat = gone.flatten()
    digests = flat.field("digest").to_pylist()
    told = list(zip(*(flat.field(f).to_pylist() for f in ("chunk", "before", "after"))))
    ends = np.cumsum([n or 0 for n in gone.value_lengths().to_pylist()]).tolist()
    out = list(texts)
    asked = [i for i, (a, b) in enumerate(zip([0, *ends], ends)) if b > a]
    for start, block in _blocks([texts[i] for i in asked]):
        cut = Cut(block)
        for k, text in enumerate(block):
            i = asked[start + k]
            own = slice(ends[i - 1] if i else 0, ends[i])
            out[i] = _without(cut, k, text, dict(zip(digests[own], told[own]))).decode()
    return out


def dedup(df: DataFrame) -> DataFrame:
    """df (doc_id, text and any others) with shortened texts in `text`, columns in their order."""
    row, gone, lost_row = fresh(df.columns, "_row", "_gone", "_lost")
    lost = removals(df).toDF(lost_row, gone)
    keyed = df.withColumn(row, _row())
    joined = keyed.join(lost, keyed[row] == lost[lost_row], "left").select(*[keyed[f"`{c}`"] for c in df.columns], gone)
    names = df.columns
    place = names.index("text")

    def shorten(batch: pa.RecordBatch) -> pa.RecordBatch:
        columns = list(batch.columns)
        taken = columns.pop()
        columns[place] = pa.array(_shorten(columns[place].to_pylist(), taken), pa.string())
        return pa.RecordBatch.from_arrays(columns, names)

    return map_arrow(joined, shorten, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), BLOCK)
