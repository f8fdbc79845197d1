"""SimHash near-duplicates by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each filled with zeros to a 23-bit word of the
perfect binary Golay code. Two fingerprints that differ in at most two bits have, by the pigeonhole principle, a
segment pair (A, C), (B, A) or (C, B) whose second segment is equal and whose first differs in one bit at most. Such
first segments share a codeword: the one nearest to the first word is among those nearest to the second word or to one
of its 23 neighbours. So a fingerprint asks with three keys (codeword of X, exact Y) and is found under the few
codewords around it; the join is verified by the count of differing bits. No link is missed.

Copies (equal fingerprints) are one node each. Defined results: a null text counts as empty; a text without words has
fingerprint zero, linked like any other; repeated rows stay, each in its component; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, stored, whole_text
from .graph import components

# Fixed value: generator polynomial of the binary Golay code.
GENERATOR = 0b101011100011
#: (first bit, bits) of the segments, and which is decoded while which must be equal.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 2), (1, 0), (2, 1))
BITS = 2


def fingerprint(text: str, words: int) -> int:
    """Bit majority of the hashes of all runs of `words` words, repeats included."""
    from xxhash import xxh64_intdigest

    found = text.encode().lower().split()
    if not found:
        return 0
    last = max(1, len(found) - words + 1)
    return majority(np.array([xxh64_intdigest(b" ".join(found[i : i + words]), 42) for i in range(last)], np.uint64))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    sums = np.zeros(64, np.int64)
    for start in range(0, len(hashes), 1 << 14):
        part = hashes[start : start + (1 << 14)].astype(">u8")
        sums += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(sums * 2 > len(hashes)).tobytes(), "big")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The syndromes of words by their three lowest bytes, and the error of each syndrome."""

    def syndrome(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    parts = np.array([[syndrome(b << s) for b in range(256)] if s < 16 else [syndrome((b & 127) << s) for b in range(256)] for s in (0, 8, 16)], np.int32)
    errors = np.zeros(2048, np.int32)
    ones = [1 << i for i in range(23)]
    for a in range(23):
        errors[syndrome(ones[a])] = ones[a]
        for b in range(a):
            errors[syndrome(ones[a] | ones[b])] = ones[a] | ones[b]
            for c in range(b):
                errors[syndrome(ones[a] | ones[b] | ones[c])] = ones[a] | ones[b] | ones[c]
    return parts, errors


def codewords(words: np.ndarray) -> np.ndarray:
    """The index (upper 12 bits) of the codeword nearest to each 23-bit word."""
    parts, errors = _tables()
    s = parts[0][words & 255] ^ parts[1][words >> 8 & 255] ^ parts[2][words >> 16 & 127]
    return (words ^ errors[s]) >> 11


def keys(prints: np.ndarray, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which print, and its key. near: all codewords of the words at most one bit away, else the nearest alone."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << n) - 1)).astype(np.int64) for low, n in SEGMENTS]
    rows, found = [], []
    for family, (x, y) in enumerate(PAIRS):
        code = codewords(parts[x])[:, None]
        if near:
            code = np.concatenate([code, codewords(parts[x][:, None] ^ (1 << np.arange(SEGMENTS[x][1]))[None, :])], 1)
            code.sort(axis=1)
        fresh = np.ones(code.shape, bool)
        fresh[:, 1:] = code[:, 1:] != code[:, :-1]
        at, col = np.nonzero(fresh)
        rows.append(at)
        found.append(((family << 12 | code[at, col]) << 22) | parts[y][at])
    return np.concatenate(rows), np.concatenate(found)


def fingerprints(df: DataFrame, words: int = 3, column: str = "text", id_column: str = "doc_id") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    kind = df.schema[id_column].dataType.simpleString()
    return map_arrow(df.select(F.col(f"`{id_column}`").alias("doc_id"), whole_text(column).alias("text")), run, f"doc_id {kind}, fp long")


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """a, b: pairs of distinct fingerprints (column fp, distinct) that differ in at most `bits` (2 at most) bits."""
    if not 0 <= bits <= BITS:
        raise ValueError("the segments hold for at most two differing bits")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        found = [keys(fp.view(np.uint64), near) for near in (False, True)]
        asks = np.repeat([True, False], [len(at) for at, _ in found])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([key for _, key in found])), pa.array(fp[np.concatenate([at for at, _ in found])]), pa.array(asks)], ["key", "fp", "asks"])

    keyed = stored(map_arrow(prints, run, "key long, fp long, asks boolean", 1 << 16), "keys")
    differ = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    asking, asked = keyed.where("asks").select("key", F.col("fp").alias("a")), keyed.where("NOT asks").select("key", F.col("fp").alias("b"))
    return asking.join(asked, "key").where((F.col("a") < F.col("b")) & (differ <= bits)).select("a", "b").distinct()


def near_duplicates(df: DataFrame, words: int = 3, bits: int = BITS, id_column: str = "doc_id") -> DataFrame:
    """doc_id, fp, component_id: the least id among the documents reachable by links."""
    prints = stored(fingerprints(df, words, id_column=id_column), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    joined = components(links(classes.select("fp"), bits))
    named = classes.join(joined, classes["fp"] == joined["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(lowest, "component").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")
