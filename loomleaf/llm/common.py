"""Things that the operators share: reading tables, folders that all executors see, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and the bytes 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. On one machine (a local master) that names none, as in tests, a temporary one is made and set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if context._jsc.sc().getCheckpointDir().isEmpty():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="loomleaf-"))
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and goes on from there, so that later steps neither repeat nor depend on what made it."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    found = df.sparkSession.read.schema(df.schema).parquet(path)
    found.stored_at = path
    return found


def tidy(spark: SparkSession) -> None:
    """Spark removes the files of shuffles once the driver has collected its references to them: at once, not at the next periodic collection.

    The bus of events holds on to the last query until another one comes, hence the query first.
    """
    spark.sql("SELECT 1").collect()
    spark._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Removes the files of stored tables on which nothing depends any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, with as many underscores in front as tell them from all columns, however these are spelled."""
    taken = {c.lower() for c in columns}
    front = ""
    while any(f"{front}{n}".lower() in taken for n in names):
        front += "_"
    return [f"{front}{n}" for n in names]


def whole_text(column: str = "text"):
    """A null text counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, most: int = 8 << 20) -> DataFrame:
    """One output batch for each input batch; f gets the columns by position or name. Large batches are dealt with in slices of bounded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, most):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def slices(batch: pa.RecordBatch, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows of about `most` bytes, and one row at least."""
    n, size = batch.num_rows, batch.nbytes
    if size <= most or n <= 1:
        if n:
            yield batch
        return
    half = n // 2
    yield from slices(batch.slice(0, half), most)
    yield from slices(batch.slice(half), most)
