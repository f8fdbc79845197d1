"""The stateful recheck schedule against the batch fold: restarts, late checks, a schedule to begin with, pages that fall due."""

import datetime
import random
import time

from loomleaf.streaming import recheck, schedule

CHECKS = "page string, ts timestamp, seq long, stale boolean"
LEVELS = {"A": "HIGH", "B": "LOW", "C": "medium"}
FIELDS = ("page", "confidence", "total_checks", "stale_count", "clean_count", "interval_h", "next_check_after")


def taken(spark, base, parts, known=None):
    for part in parts:
        spark.createDataFrame(part, CHECKS).coalesce(1).write.mode("append").parquet(f"{base}/in")
        schedule.run_stream(spark.readStream.schema(CHECKS).parquet(f"{base}/in"), f"{base}/out", f"{base}/state", known)
    return schedule.read_updates(spark, f"{base}/out")


def rows(df):
    return {tuple(r[c] for c in FIELDS) for r in df.collect()}


def made(seed, n, start=datetime.datetime(2025, 1, 1)):
    rng = random.Random(seed)
    return [(rng.choice("ABCD"), start + datetime.timedelta(hours=rng.randrange(200)), i, rng.random() < 0.2) for i in range(n)]


def entries(spark, fields=()):
    return spark.createDataFrame([(p, c, None, None, None, None) for p, c in LEVELS.items()] + list(fields), "page string, confidence string, total_checks long, stale_count long, interval_h double, last_checked_at timestamp_ntz")


def test_mixed_confidences_late_checks_and_restarts(spark, tmp_path):
    """Checks come in no order, over three starts."""
    every = made(1, 90)
    updates = taken(spark, str(tmp_path), [every[60:], every[:30], every[30:60]], entries(spark))
    levels = spark.createDataFrame(list(LEVELS.items()), "page string, confidence string")
    assert rows(schedule.latest(updates)) == rows(recheck.fold(spark.createDataFrame(every, CHECKS), levels))


def test_goes_on_from_a_batch_schedule(spark, tmp_path):
    """As one more record after another in batch; a check before the schedule's last one is counted only."""
    old, late = datetime.datetime(2024, 12, 31), datetime.datetime(2024, 12, 30)
    known = spark.createDataFrame([("A", "HIGH", 3, 1, 9.0, old)], "page string, confidence string, total_checks long, stale_count long, interval_h double, last_checked_at timestamp_ntz")
    checks = [("A", datetime.datetime(2025, 1, 1), 1, False), ("A", datetime.datetime(2025, 1, 2), 2, False), ("A", late, 0, True)]
    got = schedule.latest(taken(spark, str(tmp_path), [checks], known)).first()
    assert (got.total_checks, got.stale_count, got.interval_h) == (6, 2, 9.0 * 1.5**2)
    assert got.next_check_after == datetime.datetime(2025, 1, 2) + datetime.timedelta(hours=9 * 1.5**2)


def test_falls_due_without_another_check(spark, tmp_path):
    """A page of the first schedule was never checked since, one was now: the first is told of, the other isn't."""
    now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    known = entries(spark, [("Old", "LOW", 2, 0, 72.0, datetime.datetime(2025, 1, 1)), ("Future", "LOW", 2, 0, 72.0, now)])
    spark.createDataFrame([("A", now, 1, False)], CHECKS).write.parquet(f"{tmp_path}/in")
    query = schedule.run_stream(spark.readStream.schema(CHECKS).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/state", known, every="1 second")
    try:
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            if (tmp_path / "out").exists() and [p for p in (tmp_path / "out").glob("batch=*/_SUCCESS")]:
                updates = schedule.read_updates(spark, f"{tmp_path}/out")
                if {r.page for r in updates.where("event = 'due'").collect()}:
                    break
    finally:
        query.stop()
    updates = schedule.read_updates(spark, f"{tmp_path}/out")
    assert {r.page for r in schedule.due_pages(updates).collect()} == {"Old"} and {r.page for r in updates.where("event = 'checked'").collect()} == {"A"}


def test_fold_keeps_what_matters():
    """Of each page the counts, the latest stale check and the latest clean ones after it, as plain loops find them."""
    import pyarrow as pa

    rng = random.Random(3)
    checks = [(rng.choice(["A", "B", None, "é"]), rng.randrange(40), rng.randrange(4), rng.random() < 0.08, rng.choice([None, "", "LOW"])) for _ in range(200)] + [("Z", 1, 1, True, None)]
    fields = ("page", "at", "seq", "stale", "confidence")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    got = {r["page"]: r for r in schedule.folded(pa.table({f: pa.array(v, k) for f, v, k in zip(fields, zip(*checks), kinds)})).to_pylist()}
    assert set(got) == {c[0] for c in checks}
    for page, r in got.items():
        own = [c for c in checks if c[0] == page]
        reset = max((c[1:3] for c in own if c[3]), default=None)
        clean = sorted(c[1:3] for c in own if not c[3] and (reset is None or c[1:3] > reset))[-schedule.ENOUGH :]
        found = [c for c in zip(r["clean_at"], r["clean_seq"]) if reset is None or c > reset]
        assert (r["total"], r["stale"], r["last"], (r["at"], r["seq"])) == (len(own), sum(c[3] for c in own), max(c[1] for c in own), reset or (None, None))
        assert found == clean and r["confidence"] == next((c[4] for c in own if c[4]), None)


def test_a_page_costs_a_row_and_the_first_schedule_stays(spark, tmp_path):
    """The operator gets a row for each page, not for each check; a later start's schedule doesn't replace the first one's."""
    every = made(5, 300)
    held = spark.createDataFrame(every, "page string, at timestamp, seq long, stale boolean").selectExpr("page", "unix_micros(at) AS at", "seq", "stale", "CAST(NULL AS string) AS confidence")
    assert held.repartition("page").mapInArrow(schedule._fold, schedule.FOLDED).count() == len({c[0] for c in every})
    first, other = (spark.createDataFrame([(p, c, None, None, None, None) for p, c in levels.items()], entries(spark).schema) for levels in (LEVELS, {"A": "LOW", "B": "HIGH", "C": "HIGH", "D": "HIGH"}))
    parts = [[c for c in every if c[0] == "A"], [c for c in every if c[0] != "A"]]
    taken(spark, str(tmp_path), parts[:1], first)
    updates = taken(spark, str(tmp_path), parts[1:], other)
    assert rows(schedule.latest(updates)) == rows(recheck.fold(spark.createDataFrame(every, CHECKS), spark.createDataFrame(list(LEVELS.items()), "page string, confidence string")))
