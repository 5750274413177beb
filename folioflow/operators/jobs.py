"""Ingestion jobs and tables that change: an event log folded to states, claims, retries, upserts, cascades, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_RETRIES, RETRY_SECONDS, STALE_SECONDS, MESSAGE_CHARS, TRACE_CHARS = 3, 60, 900, 4000, 12_000
STATES = ("QUEUED", "PROCESSING", "COMPLETED", "FAILED")


def seconds(n: Column | int) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(n))


def current(log: DataFrame, key: str = "job_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The last row of each job in its event log."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(key, "s.*")


def claimable(jobs: DataFrame, now: Column, n: int) -> DataFrame:
    """The n oldest queued jobs whose time of retry has come."""
    due = (F.col("status") == "QUEUED") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    return jobs.where(due).orderBy("created_at", "job_id").limit(n)


def claimed(jobs: DataFrame, now: Column, n: int, worker: str) -> DataFrame:
    """jobs with the claimable ones in work; one query is the claim's only writer."""
    mine = claimable(jobs, now, n).select("job_id", F.lit(True).alias("__mine"))
    out = jobs.join(F.broadcast(mine), "job_id", "left")  # n rows
    took = F.coalesce("__mine", F.lit(False))
    return out.withColumns({"status": F.when(took, "PROCESSING").otherwise(F.col("status")), "worker_id": F.when(took, worker).otherwise(F.col("worker_id")), "heartbeat_at": F.when(took, now).otherwise(F.col("heartbeat_at"))}).drop("__mine")


def retried(jobs: DataFrame, failed: Column, message: str, now: Column, delay: int = RETRY_SECONDS) -> DataFrame:
    """jobs with those for which `failed` holds queued again, after a delay for each try, or failed for good."""
    tries = F.col("retry_count") + 1
    over = tries > F.col("max_retries")
    put = lambda c, value: F.when(failed, value).otherwise(F.col(c))
    return jobs.withColumns(
        {
            "retry_count": put("retry_count", tries),
            "status": put("status", F.when(over, "FAILED").otherwise("QUEUED")),
            "error_message": put("error_message", F.left(F.lit(message), F.lit(MESSAGE_CHARS))),
            "next_retry_at": put("next_retry_at", F.when(~over, now + seconds(tries * delay))),
            "worker_id": put("worker_id", F.lit(None).cast("string")),
            "heartbeat_at": put("heartbeat_at", F.lit(None).cast(jobs.schema["heartbeat_at"].dataType)),
        }
    )


def stale(now: Column, after: int = STALE_SECONDS) -> Column:
    """In work without a heartbeat for that long."""
    return (F.col("status") == "PROCESSING") & (F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < now - seconds(after)))


def recovered(jobs: DataFrame, now: Column, after: int = STALE_SECONDS, delay: int = RETRY_SECONDS) -> DataFrame:
    return retried(jobs, stale(now, after), "Recovered stale PROCESSING job", now, delay)


def _latest(jobs: DataFrame, asked: DataFrame, resources: DataFrame) -> DataFrame:
    """Each resource that is asked for, whether it is known, and its latest job."""
    wanted = asked.select("resource_id").distinct().join(resources.select("resource_id", F.lit(True).alias("known")).distinct(), "resource_id", "left")
    last = current(jobs.join(wanted.select("resource_id"), "resource_id", "left_semi"), "resource_id", ("created_at", "job_id"))
    return wanted.join(last, "resource_id", "left")


def _busy() -> Column:
    return F.when(F.col("known").isNull(), "Resource not found").when(F.col("status").isin("PROCESSING", "QUEUED"), F.concat(F.lit("Latest ingestion job is already "), "status"))


def admin_retry(jobs: DataFrame, asked: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """The latest job of each resource that is asked for, queued anew if it has failed; else the reason why it isn't."""
    last = _latest(jobs, asked, asked if resources is None else resources)
    reason = F.coalesce(_busy(), F.when(F.col("status").isNull(), "No ingestion job found for resource").when(F.col("status") != "FAILED", F.concat(F.lit("Latest ingestion job is "), "status", F.lit("; only FAILED jobs can be retried"))))
    again = F.col("reason").isNull()
    return last.withColumn("reason", reason).withColumns({"status": F.when(again, "QUEUED").otherwise(F.col("status")), "retry_count": F.when(again, 0).otherwise(F.col("retry_count"))}).drop("known")


def reindexed(jobs: DataFrame, asked: DataFrame, resources: DataFrame, mode: str, defaults: dict[str, object]) -> DataFrame:
    """A new job (resource_id, status, indexing_mode, settings, reason) for each resource that is asked for, with the settings of its latest job; none if that one is under way.

    mode: STANDARD, GRAPH or BOTH; defaults: setting -> value of resources without a job.
    """
    if mode not in ("STANDARD", "GRAPH", "BOTH"):
        raise ValueError("indexing_mode must be STANDARD, GRAPH, or BOTH")
    last = _latest(jobs, asked, resources).withColumn("reason", _busy())
    settings = [F.coalesce(F.col(c), F.lit(v)).alias(c) if c in jobs.columns else F.lit(v).alias(c) for c, v in defaults.items()]
    return last.select("resource_id", F.when(F.col("reason").isNull(), "QUEUED").alias("status"), F.lit(mode).alias("indexing_mode"), *settings, "reason")


def upserted(table: DataFrame, changes: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """table with the changes' rows in place of those of equal keys, or added. Of several changes of a key the last by `order` counts, without one the greatest."""
    rest = [c for c in changes.columns if c not in keys]
    if rest:
        last = F.max_by(F.struct(*rest), F.struct(*(order or rest)))
        changes = changes.groupBy(*keys).agg(last.alias("__last")).select(*keys, "__last.*").select(*changes.columns)
    else:
        changes = changes.distinct()
    return table.join(changes.select(keys), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def added(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with those rows whose keys it doesn't have, the first of equal ones."""
    order = Window.partitionBy(*keys).orderBy(*rows.columns)
    once = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return table.unionByName(once.join(table.select(keys), keys, "left_anti"), allowMissingColumns=True)


def cascade(tables: dict[str, tuple[DataFrame, str]], gone: DataFrame, jobs: DataFrame | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of each table (rows, column of the resource) without the resources in gone (resource_id), and rows (table_name, deleted).

    Resources with a job in work stay; all tables are named, those of the graph as well.
    """
    if jobs is not None:
        gone = gone.join(jobs.where("status = 'PROCESSING'").select("resource_id"), "resource_id", "left_anti")
    gone = gone.select("resource_id").distinct()
    left, counts = {}, None
    for name, (rows, column) in tables.items():
        ids = gone.withColumnRenamed("resource_id", column)
        left[name] = rows.join(ids, column, "left_anti")
        n = rows.join(ids, column, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table_name"), "deleted")
        counts = n if counts is None else counts.unionByName(n)
    return left, counts


def repeated_keys(table: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a unique key."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def orphans(table: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Violations of a foreign key; null ends are none."""
    return table.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def bad_rows(rows: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows that fail a test, with the names of those tests: an error table instead of a failed job."""
    names = F.filter(F.array(*(F.when(~F.coalesce(t, F.lit(False)), n) for n, t in tests.items())), lambda x: x.isNotNull())
    return rows.withColumn("errors", names).where(F.size("errors") > 0)


def error_record(message: str, trace: str) -> Column:
    return F.struct(F.left(F.col(message), F.lit(MESSAGE_CHARS)).alias("message"), F.right(F.col(trace), F.lit(TRACE_CHARS)).alias("stacktrace"))


def profiling_rows(events: DataFrame) -> DataFrame:
    """Rows (job_id, event_index, name, ms, details) from arrays of events; null details are left out."""
    flat = events.select("job_id", F.posexplode("events").alias("event_index", "e"))
    return flat.select("job_id", "event_index", "e.name", "e.ms", F.map_filter("e.details", lambda k, v: v.isNotNull()).alias("details"))


def ingested(files: DataFrame, known: DataFrame, policy: str = "version") -> DataFrame:
    """files (file_hash, ...) with version: one more than the known ones of the hash; policy reject leaves known ones out."""
    if policy not in ("version", "reject"):
        raise ValueError("policy must be version or reject")
    held = known.where(F.col("status").isin("QUEUED", "PROCESSING", "READY")).groupBy("file_hash").agg(F.count("*").alias("__n"))
    if policy == "reject":
        return files.join(held, "file_hash", "left_anti").withColumn("version", F.lit(1))
    return files.join(held, "file_hash", "left").withColumn("version", (F.coalesce("__n", F.lit(0)) + 1).cast("int")).drop("__n")


def without_embedding(chunks: DataFrame, embeddings: DataFrame, provider: str, model: str, version: str) -> DataFrame:
    """Chunks that have no vector in one embedding space."""
    space = embeddings.where((F.col("provider") == provider) & (F.col("model") == model) & (F.col("version") == version))
    return chunks.join(space.select("chunk_id"), "chunk_id", "left_anti")
