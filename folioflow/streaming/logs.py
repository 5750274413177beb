"""Event streams: counts by time window, and jobs folded to their states, on Structured Streaming.

The same functions take a batch table or a stream; a watermark lets a stream's windows close and its state end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "10 minutes"


def event_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 8) -> DataFrame:
    """Parquet files of events as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def window_counts(events: DataFrame, width: str = "5 minutes", by: str = "event_type", ts: str = "ts", late: str = LATE) -> DataFrame:
    """Rows (window_start, by, n, rate): events and events a second of each window."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark(ts, late)
    counted = rows.groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"))
    seconds = F.unix_seconds("w.end") - F.unix_seconds("w.start")
    return counted.select(F.col("w.start").alias("window_start"), by, "n", (F.col("n") / seconds).alias("rate"))


def log_filter(events: DataFrame, equal: dict[str, str] | None = None, matches: dict[str, str] | None = None, contains: str | None = None, fields: dict[str, str] | None = None, line: str = "props") -> DataFrame:
    """Events by label values, label patterns, a part of the line, and fields of its JSON."""
    test: Column = F.lit(True)
    for c, v in (equal or {}).items():
        test = test & (F.col(c) == v)
    for c, p in (matches or {}).items():
        test = test & F.col(c).rlike(p)
    if contains:
        test = test & F.col(line).contains(contains)
    for path, v in (fields or {}).items():
        test = test & (F.get_json_object(line, f"$.{path}") == v)
    return events.where(test)


JOB_STATE = "status string, retries int, since timestamp"
JOB_OUT = "job_id long, status string, retries int, since timestamp"
#: Event types of the log as states of a job.
NEXT = {"signup": "QUEUED", "view": "PROCESSING", "click": "PROCESSING", "purchase": "COMPLETED", "error": "FAILED"}


def fold(state: tuple[str, int, pd.Timestamp], events: pd.DataFrame, most_retries: int = 3) -> tuple[str, int, pd.Timestamp]:
    """A job's state after events (ts, event_id, event_type): a failure queues it again until its tries are used up."""
    status, retries, since = state
    for e in events.sort_values(["ts", "event_id"]).itertuples():
        status = NEXT.get(e.event_type, status)
        if status == "FAILED" and retries < most_retries:
            status, retries = "QUEUED", retries + 1
        elif status == "COMPLETED":
            retries = 0
        since = e.ts
    return status, retries, since


def job_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """A stream of (job_id, status, retries, since): each job's state after each batch that it has events in."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else ("QUEUED", 0, pd.Timestamp(0))
        now = fold(now, pd.concat(list(batches)))
        state.update(now)
        yield pd.DataFrame([(key[0], *now)], columns=["job_id", "status", "retries", "since"])

    rows = events.select(key, "event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return rows.groupBy(key).applyInPandasWithState(update, JOB_OUT, JOB_STATE, "update", "NoTimeout")


def drained(stream: DataFrame, name: str, mode: str, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there, then stop; rows go to a memory table of that name, or batch by batch to a function."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("memory").queryName(name).start()
    query.awaitTermination()
