"""Byte-level BPE by merge replay over the distinct words of a block of texts.

The words of a block (pattern matches, each distinct word once) stand one after the other as a chain of byte tokens
in arrays. An inverted index leads from what a token pair makes to the positions of that pair; merges are applied in
rank order, each at all its positions at once, and only the neighbours of a merged pair are looked at again. A word in
which a merge makes a pair of lower rank than the merge itself goes through the plain greedy procedure instead, so
that results are those of the greedy procedure for any vocabulary. What a task's worker has encoded it remembers, up
to MEMORY bytes of words.

Defined results: a null text counts as empty and has no ids; texts are encoded whole; null ids decode to null;
repeated rows stay; empty tables give empty results; columns of the input named like the result column are replaced.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_arrow, whole_text

#: Bytes of remembered words, and of text in a block.
MEMORY, BLOCK = 4 << 20, 2 << 20


class Vocabulary:
    """Ranks of a .tiktoken file, and the pattern that splits texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.pieces: list[bytes] = []
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as lines:
            for line in lines:
                piece, rank = line.split()
                self.ranks[base64.b64decode(piece)] = int(rank)
        self.pieces = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for piece, rank in self.ranks.items():
            self.pieces[rank] = piece
        self.split = regex.compile(pattern).findall
        self.single = np.array([self.ranks.get(bytes([b]), 0) for b in range(256)], np.int32)
        # All pairs that make a piece, sorted, and what they make.
        made = [(self.ranks[x[:i]] << 20 | self.ranks[x[i:]], r) for x, r in self.ranks.items() for i in range(1, len(x)) if x[:i] in self.ranks and x[i:] in self.ranks]
        made.sort()
        self.pairs = np.array([p for p, _ in made] + [1 << 62], np.int64)
        self.makes = np.array([r for _, r in made] + [-1], np.int32)
        self.lengths = np.array([len(x) for x in self.pieces] or [0], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known, self.held, self.sizes, self.remembered = _Numbers(), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of what pairs of tokens make, -1 if nothing."""
        pair = left.astype(np.int64) << 20 | right
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.makes[at], -1)

    def greedy(self, word: bytes) -> list[int]:
        """One word by the plain procedure: again and again the leftmost pair of the lowest rank."""
        tokens: list[int | None] = self.single[np.frombuffer(word, np.uint8)].tolist()
        n = len(tokens)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def rank(left: int, right: int) -> int:
            return self.ranks.get(self.pieces[left] + self.pieces[right], -1)

        queue = [(r, i, x, y) for i, (x, y) in enumerate(zip(tokens, tokens[1:])) if (r := rank(x, y)) >= 0]
        heapify(queue)
        while queue:
            r, i, x, y = heappop(queue)
            j = after[i]
            if tokens[i] != x or j >= n or tokens[j] != y:
                continue
            tokens[i], tokens[j], after[i] = r, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (found := rank(tokens[k], tokens[after[k]])) >= 0:
                    heappush(queue, (found, k, tokens[k], tokens[after[k]]))
        return [t for t in tokens if t is not None]

    def replay(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one word after the other, and how many each has. All words are merged together, rank by rank."""
        lengths = np.array([len(w) for w in words], np.int64)
        n = int(lengths.sum())
        if not n:
            return np.zeros(0, np.int32), lengths
        ends = np.cumsum(lengths)
        token = self.single[np.frombuffer(b"".join(words), np.uint8)]
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends[lengths > 0] - 1] = -1
        before[(ends - lengths)[lengths > 0]] = -1
        alive = np.ones(n, bool)
        makes = np.full(n, -1, np.int32)
        inner = np.nonzero(following >= 0)[0]
        makes[inner] = self.ranked(token[inner], token[inner + 1])
        where: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def list_pairs(at: np.ndarray, found: np.ndarray) -> None:
            order = np.argsort(found, kind="stable")
            at, found = at[order], found[order]
            cuts = [0, *(np.nonzero(np.diff(found))[0] + 1).tolist(), len(found)]
            for start, end in zip(cuts, cuts[1:]):
                r = int(found[start])
                if r not in where:
                    where[r] = []
                    heappush(queue, r)
                where[r].append(at[start:end])

        some = np.nonzero(makes >= 0)[0]
        if len(some):
            list_pairs(some, makes[some])
        odd: list[np.ndarray] = []
        while queue:
            r = heappop(queue)
            lists = where.pop(r)
            at = np.unique(np.concatenate(lists)) if len(lists) > 1 else np.sort(lists[0])
            at = at[makes[at] == r]
            if not len(at):
                continue
            gone = following[at]
            if (makes[gone] == r).any():
                # Pairs that overlap, as in a run of one letter: from left to right every other one.
                taken, last = [], -1
                for k, (here, there) in enumerate(zip(at.tolist(), gone.tolist())):
                    if here != last:
                        taken.append(k)
                        last = there
                at, gone = at[taken], gone[taken]
            after, left = following[gone], before[at]
            right = after >= 0
            here, there = at[right], after[right]
            found = self.ranked(np.full(len(here), r, np.int32), token[there])
            low = (found >= 0) & (found < r)
            if low.any():
                odd.append(here[low])
            token[at] = r
            makes[at] = makes[gone] = -1
            alive[gone] = False
            following[at] = after
            before[there] = here
            found = np.where(token[there] == r, self.ranked(token[here], token[there]), found)
            # What stands before a merged pair may have been merged with it just now.
            left = before[at]
            ahead = left >= 0
            back, own = left[ahead], at[ahead]
            places = np.concatenate([here, back])
            found = np.concatenate([found, self.ranked(token[back], token[own])])
            low = (found >= 0) & (found < r)
            if low.any():
                odd.append(places[low])
            makes[places] = found
            some = found >= 0
            if some.any():
                list_pairs(places[some], found[some])
        ids = token[alive]
        counts = np.diff(np.r_[0, np.cumsum(alive)[ends - 1]]) if (lengths > 0).all() else np.array([alive[e - k : e].sum() for e, k in zip(ends, lengths)], np.int64)
        again = np.unique(np.searchsorted(ends, np.concatenate(odd), "right")) if odd else ()
        if len(again):
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for k in again:
                parts[k] = np.array(self.greedy(words[k]), np.int32)
            ids, counts = np.concatenate(parts), np.array([len(x) for x in parts], np.int64)
        return ids, counts

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and how many each has."""
        if self.remembered > MEMORY:
            self.forget()
        known = self.known
        # Copies in a block are split once.
        copies: dict[str, int] = {}
        place = [copies.setdefault(t, len(copies)) for t in texts]
        split = [self.split(t) for t in copies]
        words = np.array([len(w) for w in split], np.int64)
        numbers = np.fromiter(map(known.__getitem__, chain.from_iterable(split)), np.int64, int(words.sum()))
        del split
        if known.new:
            words_ = [w.encode() for w in known.new]
            self.remembered += sum(map(len, words_))
            ids, counts = self.replay(words_)
            known.new.clear()
            self.held = [np.concatenate([*self.held, ids])]
            self.sizes = [np.concatenate([*self.sizes, counts])]
        held, sizes = self.held[0], self.sizes[0]
        flat = _gather(held, np.cumsum(sizes) - sizes, sizes, numbers)
        to = np.r_[0, np.cumsum(sizes[numbers])]
        ends = to[np.cumsum(words)]
        counts = np.diff(np.r_[0, ends])
        if len(copies) == len(texts):
            return flat, counts
        at = np.array(place, np.int64)
        return _gather(flat, ends - counts, counts, at), counts[at]

    def decode_block(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ids, and how many each of the rows of `counts` ids has."""
        sizes = np.r_[0, np.cumsum(self.lengths[ids])]
        return _gather(self.bytes, self.places, self.lengths, ids), np.diff(np.r_[0, sizes[np.cumsum(counts)]])

    def encode(self, texts: list[str]) -> list[list[int]]:
        ids, counts = self.encode_block(texts)
        return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] if texts else []

    def decode(self, ids: list[int]) -> bytes:
        return self.decode_block(np.array(ids, np.int64), np.array([len(ids)]))[0].tobytes()


class _Numbers(dict):
    """Numbers words as they are first met."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        self.new.append(word)
        return number


def _gather(values: np.ndarray, places: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """The runs of values that begin at places[i] with sizes[i] values, for each i of chosen."""
    length = sizes[chosen]
    end = np.cumsum(length)
    return values[np.repeat(places[chosen] - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)]


@lru_cache(2)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def _replaced(df: DataFrame, column: str, into: dict[str, str], value, work) -> DataFrame:
    """df with the columns of `into` (and their types), that `work` makes of a column."""
    rest = [c for c in df.columns if c not in into]
    held = df.select(*[F.col(f"`{c}`") for c in rest], value.alias(fresh(df.columns, "_in")[0]))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields[:-1]]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], *work(batch.column(batch.num_columns - 1))], [*rest, *into])

    return map_arrow(held, run, ", ".join([*kinds, *(f"`{k}` {v}" for k, v in into.items())]), BLOCK)


def _ids(texts: pa.Array, path: str, pattern: str) -> pa.Array:
    ids, counts = vocabulary(path, pattern).encode_block(texts.to_pylist())
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids, pa.int32()))


def _bytes(ids: pa.Array, path: str, pattern: str) -> pa.Array:
    flat = ids.flatten().to_numpy(zero_copy_only=False)
    counts = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    data, sizes = vocabulary(path, pattern).decode_block(flat, counts)
    made = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.py_buffer(data)])
    return pc.if_else(ids.is_valid(), made, pa.scalar(None, pa.binary())) if ids.null_count else made


def encode(df: DataFrame, path: str, pattern: str, column: str = "text", into: str = "ids") -> DataFrame:
    """df with the ids (array of int) of its texts in column `into`."""
    return _replaced(df, column, {into: "array<int>"}, whole_text(column), lambda texts: [_ids(texts, path, pattern)])


def decode(df: DataFrame, path: str, pattern: str, column: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes of its ids in column `into`."""
    return _replaced(df, column, {into: "binary"}, F.col(f"`{column}`"), lambda ids: [_bytes(ids, path, pattern)])


def round_trip(df: DataFrame, path: str, pattern: str, column: str = "text", into: tuple[str, str] = ("ids", "decoded")) -> DataFrame:
    """As encode and then decode, in one pass: one Python worker a task, and one vocabulary in it."""

    def work(texts: pa.Array) -> list[pa.Array]:
        ids = _ids(texts, path, pattern)
        return [ids, _bytes(ids, path, pattern)]

    return _replaced(df, column, dict(zip(into, ("array<int>", "binary"))), whole_text(column), work)
