"""Retention and the queue sweep as timers on a stream of job events.

Each job keeps its newest event; timers in event time say when a queued job has waited too long and when a
finished one is kept no longer. An event that is older than what is known, or the same again, changes nothing but
for the time of creation, which is that of the job's earliest event.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

FINISHED = ("done", "failed")
#: States in the order in which a job can have them; of events of one moment the later state is newer.
STATES = ("queued", "running", "done", "failed")
_STATE = "status string, at long, created long, told string"
OUT = "job_id string, status string, at timestamp"


class _Retention(StatefulProcessor):
    """Times are milliseconds; ttl and queue_age of 0 are off."""

    def __init__(self, ttl_ms: int, queue_ms: int):
        self.ttl, self.queue = ttl_ms, queue_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def _row(self, key: Any, status: str, at: int) -> pd.DataFrame:
        return pd.DataFrame({"job_id": [key[0]], "status": [status], "at": [pd.Timestamp(at, unit="ms")]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        status, at, created, told = self.job.get() if self.job.exists() else (None, None, None, None)
        before = (status, at, created)
        for pdf in rows:
            for s, t in zip(pdf["status"], pdf["ms"]):
                t = int(t)
                created = t if created is None else min(created, t)
                if at is None or (t, STATES.index(s)) > (at, STATES.index(status)):
                    status, at = s, t
        if (status, at, created) == before:
            return
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        # A timer fires once the watermark has passed it; both rules say later than, so one millisecond more.
        due = created + self.queue if status == "queued" and self.queue else at + self.ttl if status in FINISHED and self.ttl else None
        if due is not None:
            self.handle.registerTimer(max(due + 1, timerValues.getCurrentWatermarkInMs() + 1))
        self.job.update((status, at, created, status))
        if status != told:
            yield self._row(key, status, at)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        status, at, created, told = self.job.get()
        now = "failed" if status == "queued" else "expired"
        if told == now:
            return
        self.job.update((status, at, created, now))
        yield self._row(key, now, expiredTimerInfo.getExpiryTimeInMs() - 1)

    def close(self) -> None:
        pass


def retained(events: DataFrame, ttl: float, queue_age: float, delay: str = "1 hour") -> DataFrame:
    """(job_id, status, at): every change of a job's state, those that time brings among them.

    events is a stream of job_id, status (of STATES) and ts; ttl and queue_age are seconds. The newest row of a job
    is its state at the watermark: as ``status_at`` of the jobs' newest events gives it. Needs the RocksDB state store.
    """
    marked = events.where(F.col("job_id").isNotNull() & F.col("status").isin(list(STATES)) & F.col("ts").isNotNull()).withWatermark("ts", delay)
    marked = marked.withColumn("ms", F.unix_millis("ts"))
    processor = _Retention(round(ttl * 1000), round(queue_age * 1000))
    return marked.groupBy("job_id").transformWithStateInPandas(processor, OUT, "Update", "eventTime")
