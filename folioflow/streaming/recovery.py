"""Jobs kept by timers: a job without a heartbeat is queued again, and one that waits for its next try becomes due, without any event.

State of a job: its value (status, tries, heartbeat, time of the next try), a list of its failures, and the events seen, which are forgotten
after a while. The state store must be RocksDB's (STORE). The rules are those of operators.jobs.recovered().
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from folioflow.operators.jobs import MOST_RETRIES, RETRY_SECONDS, STALE_SECONDS

STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
#: How long an event is known, so that one that is sent twice counts once.
SEEN_MS = 3_600_000
POLL = "5 seconds"
OUT = "job_id long, status string, retry_count int, cause string, next_retry_after_s long"
STALE, FAILED, DUE = "Recovered stale PROCESSING job", "failed", "due"


class JobKeeper(StatefulProcessor):
    """Events (job_id, event_id, ts, event): queued, claimed, heartbeat, completed, failed. Each change of status is a row of OUT."""

    def __init__(self, stale_s: float = STALE_SECONDS, delay_s: float = RETRY_SECONDS, most: int = MOST_RETRIES):
        self.stale_ms, self.delay_ms, self.most = int(stale_s * 1000), int(delay_s * 1000), most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, retry_count int, heartbeat long, next_retry long")
        self.failures = handle.getListState("failures", "at long, message string")
        self.seen = handle.getMapState("seen", "event_id long", "at long", ttlDurationMs=SEEN_MS)

    def _timer(self, at: int | None) -> None:
        """At most one timer a job."""
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        if at is not None:
            self.handle.registerTimer(at)

    def _put(self, key: tuple, status: str, tries: int, heartbeat: int, next_retry: int, cause: str) -> Row:
        self.job.update((status, tries, heartbeat, next_retry))
        wait = (tries * self.delay_ms) // 1000 if next_retry else None
        return Row(job_id=key[0], status=status, retry_count=tries, cause=cause, next_retry_after_s=wait)

    def _again(self, key: tuple, tries: int, now: int, message: str) -> Row:
        """Queued after a delay for each try, or failed for good."""
        self.failures.appendValue((now, message))
        tries += 1
        if tries > self.most:
            self._timer(None)
            return self._put(key, "FAILED", tries, 0, 0, message)
        due = now + tries * self.delay_ms
        self._timer(due)
        return self._put(key, "QUEUED", tries, 0, due, message)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        for e in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
            if self.seen.containsKey((e["event_id"],)):
                continue
            self.seen.updateValue((e["event_id"],), (now,))
            status, tries, heartbeat, _ = self.job.get() if self.job.exists() else ("", 0, 0, 0)
            if e["event"] == "queued":
                self._timer(None)
                yield self._put(key, "QUEUED", tries, 0, 0, "queued")
            elif e["event"] in ("claimed", "heartbeat") and status in ("QUEUED", "PROCESSING"):
                self._timer(now + self.stale_ms)
                row = self._put(key, "PROCESSING", tries, now, 0, e["event"])
                if status != "PROCESSING":
                    yield row
            elif e["event"] == "completed":
                self._timer(None)
                yield self._put(key, "COMPLETED", tries, heartbeat, 0, "completed")
            elif e["event"] == "failed" and status == "PROCESSING":
                yield self._again(key, tries, now, FAILED)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentProcessingTimeInMs()
        status, tries, heartbeat, due = self.job.get()
        if status == "PROCESSING" and heartbeat + self.stale_ms <= now:
            yield self._again(key, tries, now, STALE)
        elif status == "QUEUED" and due and due <= now:
            yield self._put(key, "QUEUED", tries, 0, 0, DUE)

    def close(self) -> None:
        pass


def kept_jobs(events: DataFrame, stale_s: float = STALE_SECONDS, delay_s: float = RETRY_SECONDS, most: int = MOST_RETRIES, clock: bool = True) -> DataFrame:
    """The stream of changes of all jobs of a stream of events.

    clock: a tick a second beside the events. A stream that is started again runs no batch before something comes, so without ticks a timer in
    its state would wait for the next event.
    """
    rows = events.select("job_id", "event_id", F.col("ts").cast("timestamp").alias("ts"), "event")
    if clock:
        ticks = events.sparkSession.readStream.format("rate").option("rowsPerSecond", 1).load()
        kind = events.schema["job_id"].dataType
        rows = rows.unionByName(ticks.where("value < 0").select(F.col("value").cast(kind).alias("job_id"), F.col("value").alias("event_id"), F.col("timestamp").alias("ts"), F.lit("tick").alias("event")))
    return rows.groupBy("job_id").transformWithState(JobKeeper(stale_s, delay_s, most), OUT, "Update", "ProcessingTime")
