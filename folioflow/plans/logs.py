"""Queries of jobs, logs and tables that change."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.operators import jobs as J
from folioflow.sources import files as files_source
from folioflow.sources import web
from folioflow.streaming import logs as L

from .roles import role, table, with_roles

NOW = "1999-06-01"


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events")


def window_counts(spark, sf_dir):
    return L.window_counts(_events(spark, sf_dir)).select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "n", F.round("rate", 9).alias("rate"))


def log_filters(spark, sf_dir):
    return L.log_filter(_events(spark, sf_dir), matches={"event_type": "^(error|click)$"}, contains='"k": 6', fields={"k": "69"}).select("event_id", "event_type")


def job_states(spark, sf_dir):
    """The last event of each user as a job's state."""
    return J.current(_events(spark, sf_dir).withColumnRenamed("user_id", "job_id")).select("job_id", "event_id", "event_type")


def _jobs(spark, sf_dir):
    jobs = role(spark, sf_dir, "jobs")
    return jobs.withColumns(
        {
            "status": F.when(F.col("job_id") % 3 == 0, "PROCESSING").otherwise(F.col("status")),
            "heartbeat_at": F.when(F.col("job_id") % 4 > 0, F.col("created_at")),
            "next_retry_at": F.when(F.col("job_id") % 2 == 0, F.col("created_at") + J.seconds(86400)),
            "max_retries": F.lit(3),
            "worker_id": F.lit("w").cast("string"),
            "error_message": F.lit(None).cast("string"),
        }
    )


def claimed_jobs(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    return J.claimed(_jobs(spark, sf_dir), now, 25, "worker-1").where("worker_id = 'worker-1'").select("job_id", "status", "created_at")


def recovered_jobs(spark, sf_dir):
    now = F.lit(NOW).cast("timestamp_ntz")
    jobs = _jobs(spark, sf_dir)
    return J.recovered(jobs, now).where("error_message is not null").select("job_id", "status", F.col("retry_count").cast("int").alias("retry_count"), "next_retry_at", "error_message")


def admin_retries(spark, sf_dir):
    """Every second resource asked for, and some that nobody knows: queued again, or why not."""
    asked = role(spark, sf_dir, "resources").select(F.expr("case when resource_id % 10 = 0 then -resource_id else resource_id * 2 end as resource_id"))
    return J.admin_retry(role(spark, sf_dir, "jobs"), asked, role(spark, sf_dir, "resources")).select("resource_id", "job_id", "status", F.col("retry_count").cast("int").alias("retry_count"), "reason")


def reindexed_resources(spark, sf_dir):
    """A new job for each resource without one under way, with the settings of its latest job."""
    jobs = role(spark, sf_dir, "jobs").withColumn("chunk_size_tokens", F.when(F.col("job_id") % 3 > 0, F.lit(100) + F.col("job_id") % 7))
    resources = role(spark, sf_dir, "resources")
    found = J.reindexed(jobs, resources, resources, "GRAPH", {"chunk_size_tokens": 1200, "chunk_overlap_tokens": 80})
    return found.select("resource_id", "status", "indexing_mode", F.col("chunk_size_tokens").cast("int").alias("chunk_size_tokens"), "chunk_overlap_tokens", "reason")


def upserted_settings(spark, sf_dir):
    """Customers with newer balances for some, and new ones."""
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    changes = customers.where("c_custkey % 10 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), (F.col("c_acctbal") + 1).alias("c_acctbal"))
    again = changes.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") - 7)
    turns = changes.withColumn("turn", F.lit(1)).unionByName(again.withColumn("turn", F.lit(2)))
    return J.upserted(customers.withColumn("turn", F.lit(0)), turns, ["c_custkey"], ["turn"]).drop("turn")


def added_rows(spark, sf_dir):
    names = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("kind"))
    more = table(spark, sf_dir, "region").select(F.col("r_name").alias("name"), F.col("r_regionkey").alias("kind"))
    more = more.unionByName(more).unionByName(names.select("name", F.lit(99).alias("kind")))
    return J.added(names, more, ["name"])


def cascade_counts(spark, sf_dir):
    gone = role(spark, sf_dir, "resources").where("resource_id % 17 = 0").select("resource_id")
    tables = {"chunks": (role(spark, sf_dir, "chunks"), "resource_id"), "jobs": (role(spark, sf_dir, "jobs"), "resource_id"), "resources": (role(spark, sf_dir, "resources"), "resource_id")}
    return J.cascade(tables, gone, _jobs(spark, sf_dir))[1]


def constraint_violations(spark, sf_dir):
    """Repeated keys and orphans, counted."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    repeated = J.repeated_keys(lines, ["l_orderkey", "l_linenumber"]).agg(F.count("*").alias("n")).select(F.lit("lineitem key").alias("rule"), "n")
    lost = J.orphans(table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents").where("doc_id % 3 > 0"), "doc_id").agg(F.count("*").alias("n")).select(F.lit("label document").alias("rule"), "n")
    return repeated.unionByName(lost).unionByName(J.orphans(orders, "o_custkey", table(spark, sf_dir, "customer"), "c_custkey").agg(F.count("*").alias("n")).select(F.lit("order customer").alias("rule"), "n"))


def bad_rows(spark, sf_dir):
    return J.bad_rows(table(spark, sf_dir, "customer"), {"balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment") != "BUILDING"}).select("c_custkey", F.array_join("errors", ",").alias("errors"))


def ingested_versions(spark, sf_dir):
    """All documents, by the hash of their text, as files sent again: versions over the stored ones, some of which had failed."""
    hashed = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    known = hashed.select("file_hash", F.when(F.col("doc_id") % 4 == 0, "READY").otherwise("FAILED").alias("status"))
    return J.ingested(hashed, known).select("doc_id", "version")


def missing_embeddings(spark, sf_dir):
    chunks = role(spark, sf_dir, "chunks").select("chunk_id").distinct()
    vectors = table(spark, sf_dir, "embeddings").select((F.col("vec_id") * 8 + 1).alias("chunk_id"), F.lit("p").alias("provider"), F.concat(F.lit("m"), F.col("label") % 2).alias("model"), F.lit("1").alias("version"))
    return J.without_embedding(chunks, vectors, "p", "m1", "1").agg(F.count("*").alias("n"))


def validation_counts(spark, sf_dir):
    """Chunks, distinct jobs and tokens of each resource: each side summed up before it is joined."""
    chunks = role(spark, sf_dir, "chunks").groupBy("resource_id").agg(F.count("*").alias("chunks"), F.min("token_count").alias("min_tokens"), F.max("token_count").alias("max_tokens"), F.round(F.avg("token_count"), 4).alias("avg_tokens"))
    jobs = role(spark, sf_dir, "jobs").groupBy("resource_id").agg(F.count_distinct("job_id").alias("jobs"))
    return role(spark, sf_dir, "resources").select("resource_id").join(chunks, "resource_id", "left").join(jobs, "resource_id", "left")


def uploads_checked(spark, sf_dir):
    """Names and types of uploads, made up from parts."""
    name = F.concat("p_name", F.element_at(F.array(*map(F.lit, (".txt", ".PDF", ".docx", ".exe", ""))), (F.col("p_partkey") % 5 + 1).cast("int")))
    mime = F.element_at(F.array(*map(F.lit, ("text/plain", "application/pdf", "application/octet-stream"))), (F.col("p_size") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", files_source.upload_error(name, mime).alias("error"))


def weather_pages(spark, sf_dir):
    """Weather read from pages' state, made up from events."""
    page = F.concat(F.lit('{"temperature": '), F.round("value", 0).cast("int").cast("string"), F.lit(', "wxPhraseLong": "'), F.col("event_type"), F.lit('", "relativeHumidity": 40}'))
    w = web.weather_of_page(page)
    return _events(spark, sf_dir).select("event_id", w["temperature_f"].alias("temperature_f"), w["condition"].alias("condition"), w["humidity"].alias("humidity"))


JOBS = with_roles("", "jobs").rstrip() + """, all_jobs as (select job_id, resource_id, case when job_id % 3 = 0 then 'PROCESSING' else status end as status, created_at, retry_count,
  case when job_id % 4 > 0 then created_at end as heartbeat_at, case when job_id % 2 = 0 then created_at + interval 1 day end as next_retry_at from jobs)"""
ORACLES = {
    "window_counts": "select strftime(time_bucket(interval '5 minutes', ts), '%Y-%m-%d %H:%M:%S') as window_start, event_type, count(*) as n, round(count(*) / 300.0, 9) as rate from events group by all",
    "log_filters": """select event_id, event_type from events where event_type in ('error', 'click') and contains(props, '"k": 6') and props->>'$.k' = '69'""",
    "job_states": "select user_id as job_id, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event_type, (ts, event_id)) as event_type from events group by user_id",
    "claimed_jobs": f"{JOBS} select job_id, 'PROCESSING' as status, created_at from all_jobs where status = 'QUEUED' and (next_retry_at is null or next_retry_at <= timestamp '{NOW}') order by created_at, job_id limit 25",
    "recovered_jobs": f"""{JOBS} select job_id, case when retry_count + 1 > 3 then 'FAILED' else 'QUEUED' end as status, retry_count + 1 as retry_count,
      case when retry_count + 1 <= 3 then timestamp '{NOW}' + to_seconds(60 * (retry_count + 1)) end as next_retry_at, 'Recovered stale PROCESSING job' as error_message
      from all_jobs where status = 'PROCESSING' and (heartbeat_at is null or heartbeat_at < timestamp '{NOW}' - interval 900 second)""",
    "reindexed_resources": with_roles(
        """, last as (select resource_id, arg_max(job_id, (created_at, job_id)) as job_id, arg_max(status, (created_at, job_id)) as status from jobs group by resource_id)
        select r.resource_id, case when coalesce(l.status, '') not in ('PROCESSING', 'QUEUED') then 'QUEUED' end as status, 'GRAPH' as indexing_mode, cast(coalesce(case when job_id % 3 > 0 then 100 + job_id % 7 end, 1200) as int) as chunk_size_tokens, 80 as chunk_overlap_tokens,
          case when l.status in ('PROCESSING', 'QUEUED') then 'Latest ingestion job is already ' || l.status end as reason from resources r left join last l using (resource_id)""",
        "jobs",
        "resources",
    ),
    "admin_retries": with_roles(
        """, asked as (select distinct case when resource_id % 10 = 0 then -resource_id else resource_id * 2 end as resource_id from resources),
        last as (select resource_id, arg_max(job_id, (created_at, job_id)) as job_id, arg_max(status, (created_at, job_id)) as status, arg_max(retry_count, (created_at, job_id)) as retry_count from jobs group by resource_id),
        told as (select a.resource_id, job_id, status, retry_count, case when a.resource_id not in (select resource_id from resources) then 'Resource not found' when status in ('PROCESSING', 'QUEUED') then 'Latest ingestion job is already ' || status
          when status is null then 'No ingestion job found for resource' when status <> 'FAILED' then 'Latest ingestion job is ' || status || '; only FAILED jobs can be retried' end as reason from asked a left join last using (resource_id))
        select resource_id, job_id, case when reason is null then 'QUEUED' else status end as status, case when reason is null then 0 else retry_count end as retry_count, reason from told""",
        "jobs",
        "resources",
    ),
    "upserted_settings": """with changes as (select c_custkey * 2 as c_custkey, c_acctbal + 1 - case when c_custkey * 2 % 3 = 0 then 7 else 0 end as c_acctbal from customer where c_custkey % 10 = 0)
      select c_custkey, c_acctbal from customer where c_custkey not in (select c_custkey from changes) union all select * from changes""",
    "added_rows": "select n_name as name, n_regionkey as kind from nation union all select r_name, r_regionkey from region where r_name not in (select n_name from nation)",
    "cascade_counts": f"""{JOBS}, gone as (select p_partkey as resource_id from part where p_partkey % 17 = 0 and p_partkey not in (select resource_id from all_jobs where status = 'PROCESSING'))
      select 'chunks' as table_name, (select count(*) from lineitem where l_partkey in (select resource_id from gone)) as deleted
      union all select 'jobs', (select count(*) from jobs where resource_id in (select resource_id from gone)) union all select 'resources', (select count(*) from gone)""",
    "constraint_violations": """select 'lineitem key' as rule, (select count(*) from (select l_orderkey, l_linenumber from lineitem group by all having count(*) > 1)) as n
      union all select 'label document', (select count(*) from labels where doc_id not in (select doc_id from documents where doc_id % 3 > 0))
      union all select 'order customer', (select count(*) from orders where o_custkey not in (select c_custkey from customer))""",
    "bad_rows": "select c_custkey, array_to_string(list_filter([case when c_acctbal < 0 then 'balance' end, case when c_mktsegment = 'BUILDING' then 'segment' end], lambda x: x is not null), ',') as errors from customer where c_acctbal < 0 or c_mktsegment = 'BUILDING'",
    "ingested_versions": """with hashed as (select doc_id, sha256(text) as h from documents) select doc_id, cast(1 + (select count(*) from hashed k where k.h = f.h and k.doc_id % 4 = 0) as int) as version from hashed f""",
    "missing_embeddings": with_roles("select count(*) as n from (select distinct chunk_id from chunks where chunk_id not in (select vec_id * 8 + 1 from embeddings where label % 2 = 1))", "chunks"),
    "validation_counts": with_roles(
        """select resource_id, c.n as chunks, min_tokens, max_tokens, avg_tokens, j.n as jobs from resources left join (select resource_id, count(*) as n, min(token_count) as min_tokens, max(token_count) as max_tokens, round(avg(token_count), 4) as avg_tokens from chunks group by resource_id) c using (resource_id)
        left join (select resource_id, count(distinct job_id) as n from jobs group by resource_id) j using (resource_id)""",
        "resources",
        "chunks",
        "jobs",
    ),
    "uploads_checked": """select p_partkey, case when p_partkey % 5 >= 3 then 'unsupported extension' when (p_partkey % 5 = 0 and p_size % 3 = 1) or (p_partkey % 5 = 1 and p_size % 3 <> 1) or (p_partkey % 5 = 2 and p_size % 3 <> 2) then 'unsupported type' end as error from part""",
    "weather_pages": "select event_id, cast(cast(round(value, 0) as int) as double) as temperature_f, event_type as condition, 40 as humidity from events",
}
QUERIES = {name: globals()[name] for name in ORACLES}
