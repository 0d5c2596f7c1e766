"""Job states and counts over a stream of events. An addition: batch documents have no stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_state(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(job_id, status, at): the newest status of each job; works on streams (update mode) and tables."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    return marked.groupBy("job_id").agg(F.max_by("status", F.struct("ts", "status")).alias("status"), F.max("ts").alias("at"))


def counts_by_window(events: DataFrame, width: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """(start, status, n) of tumbling windows; late events count until the watermark passes."""
    marked = events.withWatermark("ts", delay) if events.isStreaming else events
    got = marked.groupBy(F.window("ts", width).alias("w"), "status").agg(F.count("*").alias("n"))
    return got.select(F.col("w.start").alias("start"), "status", "n")
