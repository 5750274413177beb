"""Timers, exclusive claims and server-sent events, each with a stream that is stopped and started again."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from folioflow.operators import jobs as J
from folioflow.sources import sse, web
from folioflow.streaming import claims, recovery

EVENTS = "job_id long, event_id long, ts timestamp, event string"
T0 = dt.datetime(2024, 1, 1)


def put(spark, folder, n, rows):
    spark.createDataFrame([(j, i, T0 + dt.timedelta(seconds=i), e) for j, i, e in rows], EVENTS).coalesce(1).write.parquet(f"{folder}/{n}")


def wait(test, seconds=90, said=None):
    end = time.time() + seconds
    while not test():
        assert time.time() < end, said() if said else "nothing came"
        time.sleep(0.3)


def test_a_timer_queues_a_job_again_without_an_event(spark, tmp_path):
    settings = recovery.STORE | {"spark.sql.shuffle.partitions": "1"}
    old = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    folder, batches = str(tmp_path / "in"), {}
    put(spark, folder, "a", [(1, 1, "queued"), (1, 2, "claimed"), (2, 3, "queued"), (2, 4, "claimed"), (2, 5, "completed"), (1, 2, "claimed")])
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").parquet(folder)

    def start(stale):
        kept = recovery.kept_jobs(stream, stale, 2, 1)
        return kept.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").foreachBatch(lambda df, n: batches.update({n: [tuple(r) for r in df.collect()]})).start()

    def out():
        # A batch that is cut short by the stop is run again: its rows count once.
        return [r for n in sorted(batches) for r in batches[n]]

    try:
        query = start(6)
        wait(lambda: (1, "PROCESSING", 0, "claimed", None) in out() and (2, "COMPLETED", 0, "completed", None) in out(), said=out)
        assert not any(r[3] == recovery.STALE for r in out())
        query.stop()
        query = start(6)  # the timer is in the state: it goes off in the new run
        wait(lambda: (1, "QUEUED", 1, recovery.STALE, 2) in out(), said=out)
        wait(lambda: (1, "QUEUED", 1, recovery.DUE, None) in out(), said=out)
        put(spark, folder, "b", [(1, 9, "claimed")])
        wait(lambda: any(r[0] == 1 and r[1] == "FAILED" for r in out()), said=out)
        query.stop()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # The batch operator's rule on the same job.
    job = spark.createDataFrame([(1, "PROCESSING", 0, 1, None, None, "w", T0)], "job_id long, status string, retry_count int, max_retries int, error_message string, next_retry_at timestamp, worker_id string, heartbeat_at timestamp")
    now = F.lit(T0 + dt.timedelta(seconds=5)).cast("timestamp")
    row = J.recovered(job, now, 4, 2).first()
    assert (row.status, row.retry_count, row.error_message, row.next_retry_at) == ("QUEUED", 1, recovery.STALE, T0 + dt.timedelta(seconds=7))
    assert [r[1:4] for r in out() if r[0] == 1] == [("QUEUED", 0, "queued"), ("PROCESSING", 0, "claimed"), ("QUEUED", 1, recovery.STALE), ("QUEUED", 1, recovery.DUE), ("PROCESSING", 1, "claimed"), ("FAILED", 2, recovery.STALE)]


def test_a_replayed_batch_claims_nothing_twice(spark, tmp_path):
    jobs = spark.createDataFrame([(i, "QUEUED" if i % 3 else "FAILED", None, T0 + dt.timedelta(seconds=-i)) for i in range(30)], "job_id long, status string, next_retry_at timestamp, created_at timestamp")
    log = claims.ClaimLog(spark, str(tmp_path / "log"))
    put(spark, str(tmp_path / "in"), "a", [(1, 1, "queued")])
    stream = spark.readStream.schema(EVENTS).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    broken = []

    def failing():
        broken.append(1)
        raise RuntimeError("lost")

    run = lambda of, c="c": claims.claiming(stream, of, log, 5, "w1", str(tmp_path / c), None).awaitTermination()
    with pytest.raises(Exception, match="lost"):
        run(failing)
    assert log.claims().count() == 0 and broken
    run(lambda: jobs)
    put(spark, str(tmp_path / "in"), "b", [(1, 2, "queued")])
    run(lambda: jobs)
    first = sorted(r["job_id"] for r in log.claims().collect())
    assert first == sorted(sorted((i for i in range(30) if i % 3), reverse=True)[:10])
    # The same batches again, as after a lost checkpoint: they find their own claims.
    run(lambda: jobs, "other")
    assert sorted(r["job_id"] for r in log.claims().collect()) == first
    assert log.claim(jobs, 7, 50, "w2") and log.claims().groupBy("job_id").count().where("count > 1").isEmpty()
    assert log.claims().count() == 20


def test_events_are_written_read_and_streamed(spark, tmp_path):
    sse.register(spark)
    rows = spark.createDataFrame([("start", "{}"), ("result", "one\ntwo"), (None, ""), ("done", "é漢")], "event string, data string")
    folder = tmp_path / "s"
    rows.repartition(2).write.format("sse").mode("append").save(str(folder))
    back = spark.read.format("sse").load(str(folder))
    assert sorted(map(tuple, back.select("event", "data").collect())) == sorted([("start", "{}"), ("result", "one\ntwo"), ("message", ""), ("done", "é漢")])
    assert not [p for p in folder.iterdir() if p.name.startswith("_")]
    grown = tmp_path / "g"
    grown.mkdir()
    (grown / "a.sse").write_bytes(b"event: a\ndata: 1\n\nevent: b\r\ndata: 2\r\ndata: 3\r\n\r\nevent: c\ndata: ha")

    def run():
        found = []
        query = spark.readStream.format("sse").load(str(grown)).writeStream.option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="300 milliseconds").foreachBatch(lambda df, _: found.extend(tuple(r) for r in df.collect())).start()
        return query, found

    query, found = run()
    wait(lambda: len(found) >= 2)
    query.stop()
    with (grown / "a.sse").open("ab") as f:
        f.write(b"lf\n\nevent: d\ndata: 5\n\n")
    (grown / "b.sse").write_bytes(b"data: 6\n\n")
    query, more = run()
    wait(lambda: len(more) >= 3)
    query.stop()
    text = (grown / "a.sse").read_bytes().decode()
    want = [(r["seq"], r["event"], r["data"]) for r in web.events_of(spark.createDataFrame([(text,)], "text string")).collect()]
    assert sorted((r[1:] for r in found + more if r[0] == "a.sse")) == want and ("b.sse", 0, "message", "6") in more
    assert sorted(tuple(r)[1:] for r in spark.read.format("sse").load(str(grown)).where("stream = 'a.sse'").collect()) == want
