"""Token counts through a digest cache.

A document's key is the SHA-256 of its normalised text together with the digest of the tokenizer's file and settings.
Counts that the cache (a Parquet folder) holds are joined; of the rest each distinct text is encoded once, and its
count is appended. A later call, also by another job, encodes only what no call has met.

Defined results: a null text counts as empty and has no tokens; repeated rows stay as they are, each with its count;
an empty table gives an empty result; columns of the input named like a result column are replaced by it, all others
stay. Texts are encoded whole, at any length. If tasks or whole jobs that append die and run again, the cache may hold
a key twice with the same count; readers take one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, slices, stored, whole_text

CACHE = "version string, digest binary, n_tokens long"
#: A set of missing digests of at most so many rows (32 bytes each) is broadcast to keep known texts out of the shuffle.
SMALL = 100_000


class Tokenizer:
    """A tokenizer file of a library for .json (tokenizers) or .model (sentencepiece). Special strings in a text are dealt with as the library does by default; no begin, end or added special tokens, no truncation or padding."""

    def __init__(self, path: str):
        self.path = str(path)
        self.version = hashlib.sha256(Path(path).read_bytes() + Path(path).suffix.encode()).hexdigest()

    def counter(self):
        return _counter(self.path, self.version)


@lru_cache(4)
def _counter(path: str, version: str):
    if path.endswith(".json"):
        from tokenizers import Tokenizer as Library

        library = Library.from_file(path)
        library.no_truncation()
        library.no_padding()
        return lambda texts: [len(e) for e in library.encode_batch_fast(texts, add_special_tokens=False)]
    from sentencepiece import SentencePieceProcessor

    pieces = SentencePieceProcessor(model_file=path)
    return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]


def _encode(tokenizer: Tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        count = tokenizer.counter()
        for batch in batches:
            for piece in slices(batch, 2 << 20):
                digests, texts = piece.columns
                yield pa.RecordBatch.from_arrays([digests, pa.array(count(texts.to_pylist()), pa.int64())], ["digest", "n_tokens"])

    return run


def _cached(spark, cache: str, version: str) -> DataFrame:
    try:
        held = spark.read.schema(CACHE).parquet(cache)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        held = spark.createDataFrame([], CACHE)
    return held.where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(df: DataFrame, tokenizer: Tokenizer, cache: str, column: str = "text", normalise=None) -> DataFrame:
    """df without `column`, with `digest`, `n_bytes` (of the UTF-8 text) and `n_tokens`.

    normalise: from a text column to one that the tokenizer surely counts alike (its own normaliser's steps, say, where
    it lower-cases); by default the text as it is. cache: a folder that all executors share.
    """
    spark = df.sparkSession
    text = whole_text(column)
    key = normalise(text) if normalise else text
    rest = [F.col(f"`{c}`") for c in df.columns if c not in (column, "digest", "n_bytes", "n_tokens")]
    keyed = df.select(F.unhex(F.sha2(key, 256)).alias("digest"), key.alias("_key"))
    missing = keyed.select("digest").distinct().join(_cached(spark, cache, tokenizer.version), "digest", "left_anti") if _present(spark, cache) else None
    if missing is not None:
        n = missing.limit(SMALL + 1).count()
        keyed = keyed.join(F.broadcast(missing) if n <= SMALL else missing, "digest", "left_semi") if n else None
    if keyed is not None:
        # Copies meet before the shuffle: each task sends a text once.
        texts = keyed.groupBy("digest").agg(F.first("_key").alias("_key"))
        made = texts.mapInArrow(_encode(tokenizer), "digest binary, n_tokens long")
        made.select(F.lit(tokenizer.version).alias("version"), "digest", "n_tokens").write.mode("append").parquet(cache)
    # Written, so that both sides of the join are plain shuffles, and Spark may split a digest that many rows share.
    counts = stored(_cached(spark, cache, tokenizer.version), "counts")
    rows = df.select(*rest, F.unhex(F.sha2(key, 256)).alias("digest"), F.octet_length(text).cast("long").alias("n_bytes"))
    return rows.join(counts, "digest")


def _present(spark, cache: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def own_cache(spark) -> str:
    """A new, empty cache in the shared folder."""
    return scratch(spark, "token-counts")
