"""The recheck schedule as a stream: state by page, timers that tell when a page falls due, a batch schedule to begin with.

A page's state is what its interval follows from: how many checks and stale ones it had, the latest stale check, and
the latest clean ones after it, as many as make the interval reach its bound. These don't depend on the order in which
checks arrive, so that late checks, also those of a later batch, lead to the same schedule as the batch fold
(`recheck.fold`) over all of them; none but those few are kept. The operator takes each row apart by itself, which is
slow; so a batch's checks are first folded, with the same few kept, to a row for each page (see `folded`).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .recheck import CAP, FACTOR, LEAST, MOST

ENTRY = "confidence string, total long, stale long, start double, fresh boolean, since long, reset_at long, reset_seq long, last long, clean_at array<long>, clean_seq array<long>"
FOLDED = "page string, total long, stale long, last long, at long, seq long, confidence string, clean_at array<long>, clean_seq array<long>"
OUT = "page string, event string, confidence string, total_checks long, stale_count long, clean_count long, interval_h double, last_checked_at long, next_check_after long"
FIRST = "struct<confidence string, total_checks bigint, stale_count bigint, interval_h double, last_checked_at bigint>"
SCHEDULE = "page, confidence, total_checks, stale_count, interval_h, last_checked_at"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000  # in microseconds
BEFORE_ALL = -(1 << 62)
#: Checks that are folded at once.
HELD = 1 << 20


def bounds(confidence: str | None) -> tuple[float, float]:
    """The least and the longest interval, in hours."""
    level = (confidence or "MEDIUM").upper()
    return LEAST.get(level, LEAST["MEDIUM"]), min(MOST.get(level, CAP), CAP)


#: So many clean checks in a row reach the bound of any confidence, from any interval.
ENOUGH = 2 + max(math.ceil(math.log(min(MOST[k], CAP) / LEAST[k], FACTOR)) for k in LEAST)


def folded(checks: pa.Table) -> pa.RecordBatch:
    """checks: page, at, seq, stale, confidence. Of each page the number of checks and of stale ones, the last time, the latest stale check, the latest clean ones after it (ENOUGH at most), the first confidence told."""
    if checks["at"].null_count:
        raise ValueError("a check without a time")
    pages = pc.dictionary_encode(checks["page"].combine_chunks(), null_encoding="encode")
    page, at, seq = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (pages.indices, checks["at"], checks["seq"]))
    stale = checks["stale"].to_numpy()
    told = pc.fill_null(pc.greater(pc.binary_length(checks["confidence"]), 0), False).to_numpy()
    first = np.full(len(pages.dictionary), len(page))
    np.minimum.at(first, page[told], np.flatnonzero(told))
    level = checks["confidence"].take(pa.array(first, mask=first == len(page)))
    order = np.lexsort((seq, at, page))
    at, seq, stale = at[order], seq[order], stale[order]
    n = np.bincount(page, minlength=len(first))
    ends = np.cumsum(n)
    begins = ends - n
    reset = np.maximum.reduceat(np.where(stale, np.arange(len(page)), -1), begins)
    since = np.maximum(np.maximum(reset + 1, begins), ends - ENOUGH)
    many = ends - since
    places = np.concatenate([[0], np.cumsum(many)])
    clean = np.arange(places[-1]) + np.repeat(since - places[:-1], many)
    lists = (pa.ListArray.from_arrays(pa.array(places, pa.int32()), pa.array(a[clean], pa.int64())) for a in (at, seq))
    latest = (pa.array(a[reset], pa.int64(), mask=reset < 0) for a in (at, seq))
    counts = pa.array(n, pa.int64()), pa.array(np.add.reduceat(stale.astype(np.int64), begins)), pa.array(at[ends - 1])
    return pa.RecordBatch.from_arrays([pages.dictionary, *counts, *latest, level.combine_chunks(), *lists], ["page", "total", "stale", "last", "at", "seq", "confidence", "clean_at", "clean_seq"])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
        if n >= HELD:
            yield folded(pa.Table.from_batches(held))
            held, n = [], 0
    if held:
        yield folded(pa.Table.from_batches(held))


def _begun(confidence: str | None = None, total_checks: int | None = None, stale_count: int | None = None, interval_h: float | None = None, last_checked_at: int | None = None) -> tuple:
    """The state of a page of which so much is known at first."""
    since = BEFORE_ALL if last_checked_at is None else last_checked_at
    return confidence, total_checks or 0, stale_count or 0, interval_h, not total_checks, since, None, None, since, [], []


class Rechecks(StatefulProcessor):
    """Of each page its schedule after each batch with checks of it (event `checked`), and again when it falls due (`due`), if it sets timers."""

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", ENTRY)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:  # noqa: N802, N803
        entry = _begun(**{k: v for k, v in initialState.asDict().items() if k != "page"})
        self.entry.update(entry)
        if entry[1]:
            self._set_timer(self._told(key, "", entry).next_check_after)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        rows = list(rows)  # one for each HELD checks of the page
        confidence, total, stale, start, fresh, since, at, seq, last, *clean = self.entry.get() or _begun(**(rows[0].first or {}))
        clean = list(zip(*clean))
        heapq.heapify(clean)
        for r in rows:
            total, stale, last, confidence = total + r.total, stale + r.stale, max(last, r.last), confidence or r.confidence
            # What the entry that was there at the beginning tells of already only counts.
            if r.at is not None and (r.at > since or since == BEFORE_ALL):
                at, seq = (r.at, r.seq) if at is None else max((at, seq), (r.at, r.seq))
            for c in zip(r.clean_at, r.clean_seq):
                if c[0] <= since and since != BEFORE_ALL:
                    continue
                if len(clean) < ENOUGH:
                    heapq.heappush(clean, c)
                else:
                    heapq.heappushpop(clean, c)
        clean = sorted(c for c in clean if at is None or c > (at, seq))
        entry = confidence, total, stale, start, fresh, since, at, seq, last, [c[0] for c in clean], [c[1] for c in clean]
        self.entry.update(entry)
        told = self._told(key, "checked", entry)
        self._set_timer(told.next_check_after)
        yield told

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield self._told(key, "due", self.entry.get())

    def close(self) -> None:
        pass

    def _set_timer(self, micros: int) -> None:
        if not self.timers:
            return
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(-(-micros // 1000))

    def _told(self, key, event: str, entry: tuple) -> Row:
        confidence, total, stale, start, fresh, _, reset, _, last, clean, _ = entry
        least, most = bounds(confidence)
        grown = len(clean) - (1 if reset is None and fresh and clean else 0)
        interval = min((least if reset is not None or start is None else start) * FACTOR**grown, most)
        return Row(page=key[0], event=event, confidence=(confidence or "MEDIUM").upper(), total_checks=total, stale_count=stale, clean_count=total - stale, interval_h=float(interval), last_checked_at=last, next_check_after=last + round(interval * HOUR))


def stream(checks: DataFrame, schedule: DataFrame | None = None, timers: bool = True) -> DataFrame:
    """checks as a stream (page string, ts, seq long, stale boolean, and confidence, if it tells any): a row for each page that was checked or, with timers, fell due.

    schedule: what is known at the first start (columns as in SCHEDULE); checks no later than an entry's last one are
    counted and change no interval. Its confidence goes before that of checks. A null stale flag counts as clean.
    """
    level = F.col("confidence").cast("string") if "confidence" in checks.columns else F.lit(None).cast("string")
    rows = checks.select("page", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), F.coalesce("stale", F.lit(False)).alias("stale"), level.alias("confidence"))
    # Checks of a page come together, so that what is folded is about a row a page.
    rows = rows.repartition("page").mapInArrow(_fold, FOLDED).withColumn("first", F.lit(None).cast(FIRST))
    first = None
    if schedule is not None:
        kinds = {"total_checks": "long", "stale_count": "long", "interval_h": "double"}
        first = schedule.select(F.col("page").cast("string").alias("page"), "confidence", *(F.col(c).cast(k).alias(c) for c, k in kinds.items()), F.unix_micros(F.col("last_checked_at").cast("timestamp")).alias("last_checked_at"))
    if first is not None and not timers:
        # Only pages that are checked matter, and Spark hands over each key of a first state in a batch of its own.
        known = first.select(F.col("page").alias("of"), F.struct(*first.columns[1:]).cast(FIRST).alias("first")).dropDuplicates(["of"])
        rows, first = rows.drop("first").join(known, rows["page"].eqNullSafe(known["of"]), "left").drop("of"), None
    told = rows.groupBy("page").transformWithState(Rechecks(timers), OUT, "Update", "ProcessingTime" if timers else "None", None if first is None else first.groupBy("page"))
    return told.withColumns({c: F.timestamp_micros(c).cast("timestamp_ntz") for c in ("last_checked_at", "next_check_after")})


def _kept(spark: SparkSession, schedule: DataFrame | None, checkpoint: str) -> DataFrame | None:
    """The schedule of the first start, which is kept beside the checkpoint, as pages are first checked at any start."""
    path, files = f"{checkpoint}-first", spark._jvm.org.apache.hadoop.fs.Path

    def there(name: str) -> bool:
        return files(name).getFileSystem(spark._jsc.hadoopConfiguration()).exists(files(name))

    if not there(f"{path}/_SUCCESS"):
        if schedule is None or there(f"{checkpoint}/commits/0"):
            return None
        schedule.select(*SCHEDULE.split(", ")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def run_stream(checks: DataFrame, path: str, checkpoint: str, schedule: DataFrame | None = None, every: str | None = None):
    """Keeps what `stream` tells at `path`, a folder a batch, so that a batch that runs again replaces itself.

    Without `every` it takes in all that is there and ends, without timers, as a run with timers always has a batch to
    come; `recheck.due` tells what is due then. With it (a duration) it goes on, also telling of pages that fall due
    while no checks come, until the query that it returns is stopped. A checkpoint is for one of the two.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    if every is None:
        schedule = _kept(checks.sparkSession, schedule, checkpoint)
    conf = checks.sparkSession.conf
    before = conf.get(PROVIDER, None)
    conf.set(PROVIDER, ROCKS)
    try:
        writer = stream(checks, schedule, every is not None).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint)
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
    finally:
        conf.unset(PROVIDER) if before is None else conf.set(PROVIDER, before)
    if every is None:
        query.awaitTermination()
    return query


def read_updates(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{OUT.replace('last_checked_at long, next_check_after long', 'last_checked_at timestamp_ntz, next_check_after timestamp_ntz')}, batch long").parquet(path)


def latest(updates: DataFrame) -> DataFrame:
    """Of a stream's updates the last of each page."""
    names = [c for c in updates.columns if c not in ("page", "batch")]
    return updates.groupBy("page").agg(F.max_by(F.struct(*names), F.struct("batch", F.col("event") == "due")).alias("r")).select("page", "r.*")


def due_pages(updates: DataFrame) -> DataFrame:
    """page, next_check_after of the pages that fell due and weren't checked since."""
    return latest(updates).where("event = 'due'").select("page", "next_check_after")
