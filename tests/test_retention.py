"""Retention and the queue sweep on a stream, against the same rules over a table of the newest events."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from vellumetry.operators import jobs as J
from vellumetry.streaming.retention import STATES, retained

START = dt.datetime(2024, 1, 1)
TTL, QUEUE = 3600.0, 1800.0


@pytest.fixture
def rocksdb(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def streamed(spark, tmp_path, batches, delay="10 minutes"):
    """The newest row of every job after the batches, and all rows."""
    folder, names = tmp_path / "in", "job_id string, status string, ts timestamp"
    folder.mkdir()
    seen = []
    query = None
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, names).coalesce(1).write.mode("append").parquet(str(folder / f"b{i:03d}"))
        stream = spark.readStream.schema(names).option("recursiveFileLookup", "true").parquet(str(folder))
        # Each start goes on from the checkpoint, so a query that was stopped and started again is tested too.
        query = retained(stream, TTL, QUEUE, delay).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True)
        query = query.foreachBatch(lambda df, k: seen.extend(map(tuple, df.collect()))).start()
        query.awaitTermination(120)
        assert query.exception() is None
    last = {}
    for job, status, _ in seen:
        last[job] = status
    return last, seen


def newest(rows, now):
    """status_at over the newest event of each job."""
    jobs = {}
    for job, status, ts in rows:
        jobs.setdefault(job, []).append((ts, STATES.index(status)))
    return {job: (STATES[max(e)[1]], min(e)[0], max(e)[0]) for job, e in jobs.items()}


def by_table(spark, rows, now):
    # Seconds before the epoch of a table: created_at is a job's first event, finished_at the newest one of a finished job.
    known = [(j, s, (c - START).total_seconds(), (t - START).total_seconds()) for j, (s, c, t) in newest(rows, now).items()]
    jobs = spark.createDataFrame(known, "job_id string, status string, created_at double, finished_at double")
    return {r.job_id: r.status for r in jobs.select("job_id", J.status_at(now, TTL, QUEUE).alias("status")).collect()}


def test_timers_bring_what_the_table_says(spark, tmp_path, rocksdb):
    rng = random.Random(5)
    rows, batches = [], []
    for batch in range(4):
        now = []
        for k in range(40):
            job, begin = f"j{rng.randrange(30)}", batch * 1500 + rng.randrange(1500)
            now.append((job, rng.choice(STATES), at(begin)))
        now += rng.sample(now, 5)  # repeated in the same batch
        if batches:
            now += rng.sample(batches[-1], 5)  # and in a later one, where they are late but not too late
        batches.append(now)
        rows += now
    # A marker moves the watermark; a last, empty-handed run lets the timers before it fire.
    end = 12_000
    batches += [[("marker", "running", at(end + 600))], [("marker", "running", at(end + 600))]]
    got, seen = streamed(spark, tmp_path, batches, "2 hours")
    # The watermark is at end + 600 - 7200.
    want = by_table(spark, rows, end + 600 - 7200)
    got.pop("marker")
    assert got == want and {"expired", "failed", "queued"} <= set(got.values())
    for job in got:
        told = [s for j, s, _ in seen if j == job]
        assert all(a != b for a, b in zip(told, told[1:]))


def test_late_and_repeated_events(spark, tmp_path, rocksdb):
    first = [("a", "queued", at(0)), ("b", "queued", at(0)), ("b", "running", at(10)), ("c", "done", at(20)), ("d", "queued", at(0)), (None, "done", at(0)), ("e", "odd", at(0))]
    again = [("b", "running", at(10)), ("b", "queued", at(0)), ("c", "running", at(15)), ("d", "running", at(30)), ("m", "running", at(8000))]
    too_late = [("a", "done", at(100)), ("m", "running", at(8000))]
    got, seen = streamed(spark, tmp_path, [first, again, too_late], "10 minutes")
    # a waited too long; b and d were queued but are running; c is done and expires an hour after it.
    assert got == {"a": "failed", "b": "running", "c": "expired", "d": "running", "m": "running"}
    assert [(s, t) for j, s, t in seen if j == "c"] == [("done", at(20)), ("expired", at(20 + 3600))]
    assert sum(j == "b" for j, _, _ in seen) == 1
