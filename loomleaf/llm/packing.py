"""Packing documents into sequences by column generation on the histogram of their lengths.

A document longer than a sequence first fills whole sequences of its own; what is left (fewer tokens than a sequence
has) is to be packed. The histogram of these remainders, in classes of UNIT tokens, is all that the driver sees: at
most 2048 numbers, however many documents there are. On it a linear program chooses how often to use which pattern (a
multiset of classes that fits a sequence): columns are priced by a knapsack over the classes' dual values, and enter
the basis until none is worth more than the sequence it takes. A column for each class stands for cutting it, at a cost
a little above its length, so that patterns with much padding are never used. Rounded down, the patterns take whole
documents; the rest follow one another in a stream that is cut at the sequences' ends. The stream's last tokens lie in
sequences of powers of two, which need no padding.

Which pattern, sequence and offset a document has follows from its rank among those of its length alone: all positions
are closed forms of the plan, and no sequence has to be gathered. Ranks are counted as documents are encoded, within
each task, and made global by the tasks' sums.

Defined results: a null text counts as empty and is the closing id alone; repeated rows are packed each for itself;
null ids stay null; an empty table gives an empty result; other columns don't matter. Texts are encoded whole, at any
length, word by word (see Encoder); a task needs memory in proportion to its longest text.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, stored, whole_text

LENGTH, UNIT, CLOSING = 2048, 4, 1
#: What a token costs in the stream, where documents are cut, against one in a full pattern.
CUT_COST = 1.02
#: A pattern enters if it is worth so much more than its sequence. Done when costs are so near the least that any plan can have, or
#: after so many pivots for each class: what is cut then could have been whole.
TOLERANCE, GAP, PIVOTS = 1e-4, 2e-4, 6
#: How much prices are raised, turns until that is tried again, turns until the inverse is made anew.
LIFT, RETRY, FRESH = 0.05, 4, 50
#: Words that a worker remembers at least; beyond that, those go that it met in one batch alone. New words go to the library by so many.
REMEMBERED, JOINED = 500_000, 256
#: More documents of a class than there ever are.
RANKS = 1 << 44

PIECES = "doc_id {id}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


#: A digit, as digits are taken apart from all that is beside them.
BETWEEN = "0"


@lru_cache(2)
def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    return library


#: Blanks, ASCII letters, digits, signs; what may belong to a neighbour of another kind: apostrophes, all beyond ASCII.
_BLANK, _LETTER, _DIGIT, _SIGN, _ANY = range(5)
_KIND = np.full(256, _ANY, np.uint8)
_KIND[:128] = _SIGN
_KIND[[ord(c) for c in string.ascii_letters]] = _LETTER
_KIND[[ord(c) for c in string.digits]] = _DIGIT
_KIND[[ord(c) for c in " \n"]] = _BLANK
_KIND[ord("'")] = _ANY


def words(texts: pa.Array, whole: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs without spaces and line feeds of all texts, in order, and the row of each. Where none of `whole` is within, runs also end where ASCII letters, digits and signs meet, and after each digit."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    kind = _KIND[raw]
    inside = kind != _BLANK
    begins = np.unique(offsets[:-1] - offsets[0])
    begins = begins[begins < len(raw)]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[begins] = inside[begins]
    ends[:-1] &= ~inside[1:]
    ends[begins[begins > 0] - 1] = inside[begins[begins > 0] - 1]
    held = raw.tobytes()
    if not any(w in held for w in whole):
        left, right = kind[:-1], kind[1:]
        known = (left > _BLANK) & (left < _ANY) & (right > _BLANK) & (right < _ANY)
        meet = known & ((left != right) | (right == _DIGIT))
        starts[1:] |= meet
        ends[:-1] |= meet
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    places = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(ends - starts, out=places[1:])
    found = pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(raw[inside])])
    return found.dictionary_encode(), np.searchsorted(offsets - offsets[0], starts, "right") - 1


class Encoder:
    """A worker's encoder: each word is encoded once and remembered, up to REMEMBERED words.

    For tokenizers that drop white space and take letters, single digits and other signs apart, contractions aside, so
    that words don't touch each other. Texts with strings of special tokens are taken apart at white space alone.
    """

    def __init__(self, path: str, closing: int):
        self.library, self.closing = _library(path), closing
        self.kind = np.dtype("<u2" if max(self.library.get_vocab_size(), closing + 1) <= 1 << 16 else "<u4")
        self.special = [t.content.encode() for t in self.library.get_added_tokens_decoder().values()]
        #: The word between words that are encoded together, and its id.
        self.between = self.library.encode(BETWEEN, add_special_tokens=False).ids
        self._remember([], np.zeros(0, np.int64), np.zeros(0, self.kind), np.zeros(0, np.int64))

    def _remember(self, found: list[str], sizes: np.ndarray, pool: np.ndarray, met: np.ndarray) -> None:
        self.known = dict(zip(found, range(len(found))))
        self.starts, self.pool, self.met = np.concatenate([[0], np.cumsum(sizes)]), pool, met

    def _forget(self) -> None:
        """Words that one batch alone had go, and all if that is less than half."""
        keep = np.flatnonzero(self.met > 1)
        if 2 * len(keep) > len(self.met):
            keep = keep[:0]
        sizes, each = np.diff(self.starts), list(self.known)
        held = np.zeros(len(sizes), bool)
        held[keep] = True
        self._remember([each[i] for i in keep.tolist()], sizes[keep], self.pool[np.repeat(held, sizes)], np.ones(len(keep), np.int64))

    def _apart(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each word, and all ids: each word for itself."""
        ids = [e.ids for e in self.library.encode_batch_fast(new, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return sizes, np.fromiter((i for x in ids for i in x), self.kind, int(sizes.sum()))

    def encoded(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _apart, of many words at once, told apart by the id of the word between them. Where that word is found elsewhere too, each goes for itself."""
        if len(self.between) != 1:
            return self._apart(new)
        parts = [new[i : i + JOINED] for i in range(0, len(new), JOINED)]
        sizes, pools = [], []
        for part, e in zip(parts, self.library.encode_batch_fast([f" {BETWEEN} ".join(p) for p in parts], add_special_tokens=False)):
            ids = np.array(e.ids, self.kind)
            at = np.flatnonzero(ids == self.between[0])
            if len(at) == len(part) - 1:
                sizes.append(np.diff(np.concatenate([[-1], at, [len(ids)]])) - 1)
                pools.append(np.delete(ids, at))
            else:
                size, pool = self._apart(part)
                sizes.append(size)
                pools.append(pool)
        return np.concatenate(sizes), np.concatenate(pools)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, each text's followed by the closing one, and where each text's begin."""
        found, row = words(texts, self.special)
        each = found.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.known.get, each, repeat(-1)), np.int64, len(each))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new = [each[i] for i in missing.tolist()]
            sizes, pool = self.encoded(new)
            at[missing] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip(new, at[missing].tolist()))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.pool, self.met = np.concatenate([self.pool, pool]), np.concatenate([self.met, np.zeros(len(new), np.int64)])
        self.met[at] += 1
        at = at[found.indices.to_numpy()]
        begin, size = self.starts[at], self.starts[at + 1] - self.starts[at]
        before = np.cumsum(size) - size
        n = np.bincount(row, size, len(texts)).astype(np.int64) + 1
        bounds = np.concatenate([[0], np.cumsum(n)])
        out = np.full(bounds[-1], self.closing, self.kind)
        place = np.arange(int(size.sum()))
        out[place + np.repeat(row, size)] = self.pool[place + np.repeat(begin - before, size)]
        return out, bounds


@lru_cache(1)
def _encoder(path: str, closing: int) -> Encoder:
    """A worker's own, for all its tasks."""
    return Encoder(path, closing)


def encoded(df: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING) -> DataFrame:
    """doc_id, n (tokens, the closing one included), rest (n modulo length), part, nth (place among the rows of part and rest), ids (of `width` bytes each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, part, seen = _encoder(path, closing), TaskContext.get().partitionId(), np.zeros(length, np.int64)
        for batch in batches:
            for piece in slices(batch, 4 << 20):
                ids, bounds = encode(piece.column(1))
                n = np.diff(bounds)
                rest = n % length
                order = np.argsort(rest, kind="stable")
                first = np.searchsorted(rest[order], rest[order])
                nth = np.empty_like(n)
                nth[order] = seen[rest[order]] + np.arange(len(n)) - first
                seen += np.bincount(rest, minlength=length)
                width = ids.dtype.itemsize
                held = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(n), pa.array(rest), pa.array(np.full(len(n), part, np.int64)), pa.array(nth), held, pa.array(np.full(len(n), width, np.int32))], ["doc_id", "n", "rest", "part", "nth", "ids", "width"])

    rows = df.select("doc_id", whole_text().alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n long, rest long, part long, nth long, ids binary, width int")


# ---- the linear program


def priced(values: np.ndarray, units: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of classes (units: their sizes, descending) that fits, by dynamic programming over the room."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c], last[c] = best[c - 1], -1
        at = int(np.searchsorted(-units, -c))  # the first class that fits
        if at < len(units):
            worth = values[at:] + best[c - units[at:]]
            i = int(worth.argmax())
            if worth[i] > best[c] + 1e-12:
                best[c], last[c] = worth[i], at + i
    counts, c = np.zeros(len(units)), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= units[last[c]]
    return float(best[room]), counts


def generated(units: np.ndarray, demand: np.ndarray, room: int) -> list[tuple[np.ndarray, float]]:
    """Patterns (counts by class) and how often the linear program uses each; classes that are cut are in none. units: sizes, descending.

    A revised simplex that begins with all classes cut. Prices are first raised a little for classes of which much is
    cut still, so that columns enter that take much; where none of these is worth its sequence, the exact ones decide.
    """
    m = len(units)
    if not m:
        return []
    cut = units / room * CUT_COST
    demand = demand.astype(float)
    basis, cost, inverse, level, prices = np.eye(m), cut.copy(), np.eye(m), demand.copy(), cut.copy()
    of = np.arange(m)  # the class that a basic column cuts; -1: a pattern
    failed = -RETRY
    for turn in range(PIVOTS * m):
        if cost @ level * room / (units @ demand) - 1 <= GAP:
            break
        over = prices - cut
        cheap = int(over.argmax())
        if over[cheap] > 1e-9:
            column, price, kind = np.eye(1, m, cheap)[0], cut[cheap], cheap
        else:
            price, kind, waiting = 1.0, -1, np.zeros(m)
            waiting[of[of >= 0]] = (level * (of >= 0))[of >= 0]
            waiting *= units
            if waiting.max() > 0 and turn - failed >= RETRY:
                _, column = priced(prices * (1 + LIFT * np.sqrt(waiting / waiting.max())), units, room)
                failed = turn if column @ prices - 1 <= TOLERANCE else failed
            if failed == turn or waiting.max() <= 0 or turn - failed < RETRY:
                value, column = priced(prices, units, room)
                if value - 1 <= TOLERANCE:
                    break
        change = inverse @ column
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = np.where(change > 1e-7, level / change, np.inf)
        if not np.isfinite(least := steps.min()):
            break
        close = np.flatnonzero(steps <= least + 1e-7 * (1 + least))
        out = int(close[change[close].argmax()])
        level, step = level - steps[out] * change, steps[out]
        level[out] = step
        basis[:, out], cost[out], of[out] = column, price, kind
        if turn % FRESH == FRESH - 1:
            inverse = np.linalg.inv(basis)
            level, prices = inverse @ demand, cost @ inverse
        else:
            row = inverse[out] / change[out]
            prices = prices + (price - column @ prices) * row
            inverse -= np.outer(change, row)
            inverse[out] = row
        np.maximum(level, 0, out=level)
    return [(basis[:, i].copy(), level[i]) for i in np.flatnonzero((of < 0) & (level > 1e-9))]


def filled(units: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Patterns for what rounding leaves, and how often: the largest classes that still fit, one after another; without those that leave more room than cutting costs. Each turn uses up or passes over a class."""
    left, out = left.copy(), []
    while left.any():
        pattern, free = np.zeros(len(units), np.int64), room
        for i in np.flatnonzero(left):
            pattern[i] = min(left[i], free // units[i])
            free -= pattern[i] * units[i]
        held = pattern > 0
        if free <= room * (CUT_COST - 1):
            times = int((left[held] // pattern[held]).min())
            out.append((pattern, times))
            left -= pattern * times
        else:
            left[np.flatnonzero(left)[0]] = 0
    return out


class Plan:
    """Where each remainder goes. lengths: the number of remainders of each length.

    A class holds UNIT lengths, the shortest first, so that the length of a class's document follows from its rank.
    """

    def __init__(self, lengths: np.ndarray, length: int = LENGTH, unit: int = UNIT):
        self.length, self.unit = length, unit
        top = -(-length // unit)
        by_class = np.zeros((top + 1, unit), np.int64)  # rest r is in class (r - 1) // unit + 1, at (r - 1) % unit
        rests = np.arange(1, length)
        by_class[(rests - 1) // unit + 1, (rests - 1) % unit] = lengths[1:length]
        self.sizes = by_class
        self.before = np.cumsum(by_class, 1) - by_class
        demand = by_class.sum(1)
        units = np.flatnonzero(demand)[::-1]
        # A class counts as its longest document; a sequence's last unit may be a part of one.
        found = generated(units, demand[units], length // unit)
        patterns = [(p.astype(np.int64), int(x + 1e-6)) for p, x in found]
        left = demand[units] - sum((p * t for p, t in patterns), np.zeros(len(units), np.int64))
        for p, x in sorted(found, key=lambda f: int(f[1]) - f[1]):
            if (left >= p).all():
                patterns.append((p.astype(np.int64), 1))
                left -= p.astype(np.int64)
        patterns += filled(units, left, length // unit)
        # Segments: a class's ranks from `start` on go to a pattern, `count` to a sequence; runs: the segments before it there.
        starts, used, at = [], np.zeros(top + 1, np.int64), 0
        for p, t in patterns:
            if t:
                runs = []
                for k in np.flatnonzero(p):
                    q, count = int(units[k]), int(p[k])
                    starts.append((q, int(used[q]), count, at, tuple(runs)))
                    runs.append((q, int(used[q]), count))
                    used[q] += count * t
                at += int(t)
        streamed, place = [], 0
        for q in range(top + 1):
            streamed.append(place - self._sum(np.array([q]), used[q : q + 1])[0])
            place += self._sum(np.array([q]), demand[q : q + 1])[0] - self._sum(np.array([q]), used[q : q + 1])[0]
            starts.append((q, int(used[q]), 0, -1, ()))
        starts.sort(key=lambda s: (s[0], s[1], s[2] == 0))
        self.streamed = np.array(streamed)
        self.keys = np.array([q * RANKS + start for q, start, *_ in starts])
        self.start, self.count, self.first = (np.array([s[i] for s in starts], np.int64) for i in (1, 2, 3))
        most = max((len(s[4]) for s in starts), default=0)
        self.runs = np.array([[*s[4], *[(0, 0, 0)] * (most - len(s[4]))] for s in starts], np.int64).reshape(len(starts), most, 3)
        # The stream: full sequences, then powers of two.
        full, rest = divmod(int(place), length)
        ends = [b for b in (1 << i for i in range(length.bit_length(), -1, -1)) if rest & b]
        self.stream_first, self.full, self.tail = at, full, np.cumsum([0, *ends]) + full * length
        self.total = at + full + len(ends)
        self.docs_before = np.cumsum(lengths) - lengths

    def _sum(self, q: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Tokens of the first `ranks` documents of classes q."""
        each = np.clip(ranks[:, None] - self.before[q], 0, self.sizes[q])
        return (each * ((q[:, None] - 1) * self.unit + 1 + np.arange(self.unit))).sum(1)

    def places(self, rest: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of remainders (rest > 0) by their rank among those of their length: the sequence (-1: the stream), the offset there or in the stream."""
        q = (rest - 1) // self.unit + 1
        at = rank + self.before[q, (rest - 1) % self.unit]
        i = np.searchsorted(self.keys, q * RANKS + at, "right") - 1
        count = np.maximum(self.count[i], 1)
        copy = (at - self.start[i]) // count
        mine = self.start[i] + copy * count
        whole = self.count[i] > 0
        offset = np.where(whole, self._sum(q, at) - self._sum(q, mine), self.streamed[q] + self._sum(q, at))
        for k in range(self.runs.shape[1]):
            p, start, many = self.runs[i, k].T
            begin = start + copy * many
            offset += np.where(whole & (many > 0), self._sum(p, begin + many) - self._sum(p, begin), 0)
        return np.where(whole, self.first[i] + copy, -1), offset, i

    def cut(self, place: int, n: int) -> list[tuple[int, int, int, int]]:
        """(start, length, sequence, offset) of the pieces of n tokens from a place of the stream on."""
        out, done = [], 0
        while done < n:
            x = place + done
            if x < self.full * self.length:
                k, begin, end = x // self.length, x // self.length * self.length, (x // self.length + 1) * self.length
            else:
                t = int(np.searchsorted(self.tail, x, "right")) - 1
                k, begin, end = self.full + t, int(self.tail[t]), int(self.tail[t + 1])
            size = min(n - done, end - x)
            out.append((done, size, self.stream_first + k, x - begin))
            done += size
        return out


def pack(df: DataFrame, path: str, length: int = LENGTH, closing: int = CLOSING, unit: int = UNIT) -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, sequence_id, offset, ids (unsigned 32-bit numbers, little-endian). path: a file of the tokenizers library."""
    docs = stored(encoded(df, path, length, closing), "encoded")
    sizes = docs.groupBy("rest", "part").agg(F.count(F.lit(1)).alias("size"), F.max("n").alias("most"))
    sizes = stored(sizes.withColumn("before", F.sum("size").over(Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")), "ranks")
    lengths, most = np.zeros(length, np.int64), 0
    for row in sizes.groupBy("rest").agg(F.sum("size").alias("size"), F.max("most").alias("most")).collect():  # `length` rows at most
        lengths[row.rest], most = row.size, max(most, row.most)
    shared = df.sparkSession.sparkContext.broadcast(Plan(lengths, length, unit))
    longest = most // length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in batches:
            for piece in slices(batch, 2 << 20):
                yield _pieces(plan, piece, length, longest)

    # A task's rows of one length are few, so that no key here is hot.
    ranked = docs.join(sizes.select("rest", "part", "before").hint("shuffle_hash"), ["rest", "part"]).select("doc_id", "n", "rest", (F.col("nth") + F.col("before")).alias("rank"), "width", "ids")
    return ranked.mapInArrow(run, PIECES.format(id=docs.schema["doc_id"].dataType.simpleString()))


def _pieces(plan: Plan, batch: pa.RecordBatch, length: int, longest: int) -> pa.RecordBatch:
    n, rest, rank = (batch.column(c).to_numpy().astype(np.int64) for c in ("n", "rest", "rank"))
    number = plan.docs_before[rest] + rank
    some = np.flatnonzero(rest)
    sequence, offset = np.full(len(n), -1, np.int64), np.zeros(len(n), np.int64)
    sequence[some], offset[some], _ = plan.places(rest[some], rank[some])
    out: list[tuple[int, int, int, int, int, bytes]] = []
    for i, (raw, width) in enumerate(zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())):
        ids = np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()
        full = int(n[i] // length)
        pieces = [(j * length, length, plan.total + int(number[i]) * longest + j, 0) for j in range(full)]
        if rest[i] and sequence[i] >= 0:
            pieces.append((full * length, int(rest[i]), int(sequence[i]), int(offset[i])))
        elif rest[i]:
            pieces += [(full * length + s, m, k, o) for s, m, k, o in plan.cut(int(offset[i]), int(rest[i]))]
        out += [(i, s, m, k, o, ids[4 * s : 4 * (s + m)]) for s, m, k, o in pieces]
    rows, start, size, seq, off, held = zip(*out)
    rows = pa.array(rows, pa.int64())
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id").take(rows), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(n).take(rows), pa.array(seq, pa.int64()), pa.array(off, pa.int64()), pa.array(held, pa.binary())],
        ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
    )
