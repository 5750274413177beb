"""Catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.operators import catalog as C

from .roles import resource_authors, resource_tags, role, table, with_roles


def _authors_of(spark, sf_dir) -> DataFrame:
    return resource_authors(spark, sf_dir).join(role(spark, sf_dir, "authors"), "author_id").select("resource_id", "author_name")


def _found(spark, sf_dir, **filters) -> DataFrame:
    return C.search(role(spark, sf_dir, "resources"), role(spark, sf_dir, "categories"), _authors_of(spark, sf_dir), resource_tags(spark, sf_dir), **filters)


def catalog_page(spark, sf_dir):
    """Filters, sort, offset and limit, then arrays for the page's rows only."""
    found = C.page(C.ordered(_found(spark, sf_dir, q=" 7 ", tier="free", published_from="1995-01-01"), "published_desc"), 25, 10)
    return C.with_arrays(found, _authors_of(spark, sf_dir), resource_tags(spark, sf_dir)).select("resource_id", "title", "category", "published_date", F.array_join("authors", "|").alias("authors"), F.array_join("tags", "|").alias("tags"))


def catalog_total(spark, sf_dir):
    return _found(spark, sf_dir, author="Supplier#00000000", category="nation_1", tag="e").agg(F.count("*").alias("total"))


def catalog_sorted(spark, sf_dir):
    return C.page(C.ordered(_found(spark, sf_dir, publisher="brand#1", language="german", status="", published_to="2015-12-31"), "created_desc"), 40, 5).select("resource_id", "title", "created_at", "status")


def catalog_by_tag(spark, sf_dir):
    return _found(spark, sf_dir, tag="economy").select("resource_id", "title", "category")


def catalog_facets(spark, sf_dir):
    return C.facets(*(role(spark, sf_dir, r) for r in ("categories", "authors")), resource_tags(spark, sf_dir), role(spark, sf_dir, "resources"), role(spark, sf_dir, "tiers"))


def catalog_detail(spark, sf_dir):
    """One resource by id, with optional columns filled in."""
    one = C.with_optional(C.named(role(spark, sf_dir, "resources").where("resource_id = 42").drop("rag_enabled"), role(spark, sf_dir, "categories")))
    return C.with_arrays(one, _authors_of(spark, sf_dir), resource_tags(spark, sf_dir)).select("resource_id", "title", "category", "rag_enabled", "metadata_json", F.size("authors").cast("long").alias("n_authors"), F.array_join("tags", "|").alias("tags"))


def admin_resources(spark, sf_dir):
    chunks = role(spark, sf_dir, "chunks")
    embedded = chunks.where("token_count >= 25").select("chunk_id")
    jobs = role(spark, sf_dir, "jobs")
    errors = jobs.where("status = 'FAILED'").selectExpr("resource_id", "created_at", "concat('job ', cast(job_id as string), ' failed') as message", "case when job_id % 2 = 0 then 'chunking' else 'embedding' end as stage", "'ValueError' as type")
    found = C.admin_list(role(spark, sf_dir, "resources"), role(spark, sf_dir, "categories"), _authors_of(spark, sf_dir), chunks, embedded, jobs, errors, resource_tags(spark, sf_dir))
    return found.select(
        "resource_id", "category", "author", F.array_join("tags", "|").alias("tags"), "chunk_count", "embedding_count", "job_count", "latest_job_id", "latest_job_status", "latest_error_message", "latest_error_stage", "latest_error_type"
    )


def search_users(spark, sf_dir):
    return C.lookup(role(spark, sf_dir, "users"), ("username", "email"), q="00001", status="active").select("user_id", "username", "status")


def search_authors(spark, sf_dir):
    return C.page(C.lookup(role(spark, sf_dir, "authors"), ("author_name",), q="#0000000", status="ACTIVE").orderBy("author_name", "author_id"), 20, 3)


def search_subscriptions(spark, sf_dir):
    """Subscriptions with their users and tiers."""
    joined = role(spark, sf_dir, "subscriptions").withColumnRenamed("status", "subscription_status").join(role(spark, sf_dir, "users").select("user_id", "username", "email"), "user_id").join(role(spark, sf_dir, "tiers").select("tier_code", "tier_name"), "tier_code")
    return C.lookup(joined, ("username", "email"), q="000012", tier_code="asia", subscription_status="active").select("subscription_id", "username", "tier_name", "created_at")


def search_approvals(spark, sf_dir):
    """Requests for approval with their users: orders as requests."""
    requests = table(spark, sf_dir, "orders").selectExpr("o_orderkey as request_id", "o_custkey as user_id", "o_orderdate as requested_at", "case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'PENDING' else 'REJECTED' end as approval_status")
    joined = requests.join(role(spark, sf_dir, "users").select("user_id", "username", "email"), "user_id")
    return C.lookup(joined, ("username", "email"), q="00012", approval_status="pending").select("request_id", "username", "email", "approval_status", "requested_at")


def users_by_role(spark, sf_dir):
    """Users whose roles meet those asked for."""
    users = role(spark, sf_dir, "users").withColumn("roles", F.array_sort(F.array_union(F.array("segment"), F.when(F.col("status") == "ACTIVE", F.array(F.lit("READER"))).otherwise(F.array().cast("array<string>")))))
    return users.where(F.arrays_overlap("roles", F.array(F.lit("BUILDING"), F.lit("READER")))).groupBy("segment").agg(F.count("*").alias("n"), F.max(F.array_join("roles", ",")).alias("roles"))


def table_page(spark, sf_dir):
    """A plain table by key, page by page."""
    return C.page(table(spark, sf_dir, "customer").orderBy("c_custkey"), 50, 100)


TABLES = ("region", "nation", "supplier", "customer", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table_list(spark, sf_dir):
    """The catalog's tables with their rows."""
    names = TABLES
    parts = [table(spark, sf_dir, n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def metadata_containment(spark, sf_dir):
    return table(spark, sf_dir, "events").where(C.containment("props", {"k": 69})).select("event_id", "event_type")


def languages(spark, sf_dir):
    """Distinct languages with resources by status: the status counters."""
    return role(spark, sf_dir, "resources").groupBy("language").agg(F.count("*").alias("n"), F.count_if(F.col("status") == "ACTIVE").alias("active"), F.count_if(F.col("ingestion_status") == "READY").alias("ready"))


_AUTHORS_OF = "authors_of as (select resource_id, author_name from resource_authors join authors using (author_id))"
_NAMED = "(select r.*, c.category_name as category from resources r left join categories c using (category_id))"


def _sql(sql: str, *names: str) -> str:
    head = with_roles("", *names).rstrip()
    return f"{head}, {_AUTHORS_OF} {sql}" if "authors_of" in sql else f"{head} {sql}"


_ALL = ("resources", "categories", "authors", "resource_authors", "resource_tags")
ORACLES = {
    "catalog_page": _sql(
        f"""select resource_id, title, category, published_date,
          coalesce((select string_agg(author_name, '|' order by author_name) from authors_of a where a.resource_id = p.resource_id), '') as authors,
          coalesce((select string_agg(tag_name, '|' order by tag_name) from resource_tags t where t.resource_id = p.resource_id), '') as tags
        from (select * from {_NAMED} r where status = 'ACTIVE' and minimum_tier_code = 'FREE' and published_date >= date '1995-01-01'
          and (title ilike '%7%' or coalesce(description, '') ilike '%7%' or coalesce(publisher, '') ilike '%7%' or coalesce(isbn, '') ilike '%7%' or coalesce(category, '') ilike '%7%'
            or exists (select 1 from authors_of a where a.resource_id = r.resource_id and author_name ilike '%7%')
            or exists (select 1 from resource_tags t where t.resource_id = r.resource_id and tag_name ilike '%7%'))
          order by published_date desc nulls last, title, resource_id limit 25 offset 10) p""",
        *_ALL,
    ),
    "catalog_total": _sql(
        f"""select count(*) as total from {_NAMED} r where status = 'ACTIVE' and category ilike '%nation_1%'
          and exists (select 1 from authors_of a where a.resource_id = r.resource_id and author_name ilike '%Supplier#00000000%')
          and exists (select 1 from resource_tags t where t.resource_id = r.resource_id and tag_name ilike '%e%')""",
        *_ALL,
    ),
    "catalog_sorted": _sql(
        """select resource_id, title, created_at, status from resources where publisher ilike '%brand#1%' and language ilike '%german%' and published_date <= date '2015-12-31'
        order by created_at desc nulls last, title, resource_id limit 40 offset 5""",
        "resources",
    ),
    "catalog_by_tag": _sql(f"select resource_id, title, category from {_NAMED} r where status = 'ACTIVE' and resource_id in (select resource_id from resource_tags where tag_name ilike '%economy%')", *_ALL),
    "catalog_facets": _sql(
        """select facet, value, row_number() over (partition by facet order by place, value) as position from (
          select 'category' as facet, category_name as value, 0 as place from categories where status = 'ACTIVE'
          union all select 'author', author_name, 0 from authors where status = 'ACTIVE'
          union all select distinct 'tag', tag_name, 0 from resource_tags
          union all select distinct 'language', language, 0 from resources where language <> ''
          union all select 'tier', tier_code, display_order from tiers where status = 'ACTIVE')""",
        *_ALL,
        "tiers",
    ),
    "catalog_detail": _sql(
        f"""select resource_id, title, category, cast(null as boolean) as rag_enabled, '{{}}' as metadata_json,
          (select count(*) from authors_of a where a.resource_id = r.resource_id) as n_authors,
          (select string_agg(tag_name, '|' order by tag_name) from resource_tags t where t.resource_id = r.resource_id) as tags
        from {_NAMED} r where resource_id = 42""",
        *_ALL,
    ),
    "admin_resources": _sql(
        f"""select resource_id, category, (select min(author_name) from authors_of a where a.resource_id = r.resource_id) as author,
          (select count(*) from chunks c where c.resource_id = r.resource_id) as chunk_count,
          (select count(*) from chunks c join (select chunk_id from chunks where token_count >= 25) e using (chunk_id) where c.resource_id = r.resource_id) as embedding_count,
          coalesce((select string_agg(tag_name, '|' order by tag_name) from resource_tags t where t.resource_id = r.resource_id), '') as tags,
          (select count(*) from jobs j where j.resource_id = r.resource_id) as job_count,
          (select 'job ' || max_by(job_id, (created_at, 'job ' || job_id || ' failed')) || ' failed' from jobs j where j.resource_id = r.resource_id and status = 'FAILED') as latest_error_message,
          (select case when max_by(job_id, (created_at, 'job ' || job_id || ' failed')) % 2 = 0 then 'chunking' else 'embedding' end from jobs j where j.resource_id = r.resource_id and status = 'FAILED' having count(*) > 0) as latest_error_stage,
          (select max('ValueError') from jobs j where j.resource_id = r.resource_id and status = 'FAILED') as latest_error_type,
          (select max_by(job_id, (created_at, job_id)) from jobs j where j.resource_id = r.resource_id) as latest_job_id,
          (select max_by(status, (created_at, job_id)) from jobs j where j.resource_id = r.resource_id) as latest_job_status
        from {_NAMED} r""",
        *_ALL,
        "chunks",
        "jobs",
    ),
    "search_users": _sql("select user_id, username, status from users where status = 'ACTIVE' and (username ilike '%00001%' or email ilike '%00001%')", "users"),
    "search_authors": _sql("select * from authors where status = 'ACTIVE' and author_name ilike '%#0000000%' order by author_name, author_id limit 20 offset 3", "authors"),
    "search_approvals": _sql(
        """select request_id, username, email, approval_status, requested_at from (select o_orderkey as request_id, o_custkey as user_id, o_orderdate as requested_at, case o_orderstatus when 'F' then 'APPROVED' when 'O' then 'PENDING' else 'REJECTED' end as approval_status from orders)
        join users using (user_id) where approval_status = 'PENDING' and (username ilike '%00012%' or email ilike '%00012%')""",
        "users",
    ),
    "search_subscriptions": _sql(
        """select subscription_id, username, tier_name, s.created_at from subscriptions s join users u using (user_id) join tiers t using (tier_code)
        where tier_code = 'ASIA' and s.status = 'ACTIVE' and (username ilike '%000012%' or email ilike '%000012%')""",
        "subscriptions",
        "users",
        "tiers",
    ),
    "users_by_role": _sql(
        """select segment, count(*) as n, max(array_to_string(roles, ',')) as roles from (
          select segment, status, list_sort(case when status = 'ACTIVE' then [segment, 'READER'] else [segment] end) as roles from users)
        where list_contains(roles, 'BUILDING') or list_contains(roles, 'READER') group by segment""",
        "users",
    ),
    "table_page": "select * from customer order by c_custkey limit 50 offset 100",
    "table_list": " union all ".join(f"select '{n}' as table_name, count(*) as n_rows from {n}" for n in TABLES),
    "metadata_containment": "select event_id, event_type from events where props->>'$.k' = '69'",
    "languages": _sql("select language, count(*) as n, count(*) filter (status = 'ACTIVE') as active, count(*) filter (ingestion_status = 'READY') as ready from resources group by language", "resources"),
}
QUERIES = {name: globals()[name] for name in ORACLES}
