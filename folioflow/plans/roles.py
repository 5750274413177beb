"""The star-schema tables in the roles of the catalog: expressions that Spark and DuckDB read alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources.scratch import spread

#: Tables of long texts: work on them is spread over all cores.
TEXTS = ("documents", "pages")
#: Role -> (table, columns as expressions of that table).
ROLES: dict[str, tuple[str, dict[str, str]]] = {
    "resources": (
        "part",
        {
            "resource_id": "p_partkey",
            "title": "p_name",
            "description": "p_type",
            "publisher": "p_brand",
            "isbn": "concat('978-', cast(p_partkey as varchar(20)))",
            "category_id": "cast(p_partkey % 30 as int)",
            "published_date": "case when p_size % 7 = 0 then null else make_date(1990 + p_size % 30, 1 + p_size % 12, 1) end",
            "language": "case p_size % 5 when 0 then 'English' when 1 then 'German' when 2 then 'French' when 3 then 'Spanish' else '' end",
            "minimum_tier_code": "case when p_size < 20 then 'FREE' when p_size < 40 then 'BASIC' else 'PREMIUM' end",
            "status": "case when p_size % 10 = 9 then 'INACTIVE' else 'ACTIVE' end",
            "created_at": "make_date(2000 + cast(p_partkey % 20 as int), 1 + cast(p_partkey % 12 as int), 1 + cast(p_partkey % 28 as int))",
            "ingestion_status": "case when p_partkey % 5 = 0 then 'QUEUED' else 'READY' end",
            "rag_enabled": "p_partkey % 11 <> 0",
        },
    ),
    "categories": ("nation", {"category_id": "n_nationkey", "category_name": "n_name", "status": "case when n_nationkey % 6 = 5 then 'INACTIVE' else 'ACTIVE' end"}),
    "tiers": ("region", {"tier_code": "r_name", "tier_name": "r_name", "description": "concat('tier ', r_name)", "display_order": "r_regionkey", "status": "case when r_regionkey = 3 then 'INACTIVE' else 'ACTIVE' end"}),
    "authors": ("supplier", {"author_id": "s_suppkey", "author_name": "s_name", "status": "case when s_nationkey % 4 = 3 then 'INACTIVE' else 'ACTIVE' end"}),
    "users": ("customer", {"user_id": "c_custkey", "username": "c_name", "email": "concat(lower(c_name), '@example.org')", "status": "case when c_acctbal < 0 then 'INACTIVE' else 'ACTIVE' end", "segment": "c_mktsegment"}),
    "subscriptions": ("orders", {"subscription_id": "o_orderkey", "user_id": "o_custkey", "tier_code": "case cast(o_orderkey % 5 as int) when 0 then 'AFRICA' when 1 then 'AMERICA' when 2 then 'ASIA' when 3 then 'EUROPE' else 'MIDDLE EAST' end", "status": "case o_orderstatus when 'F' then 'EXPIRED' when 'O' then 'ACTIVE' else 'CANCELLED' end", "created_at": "o_orderdate"}),
    "jobs": ("orders", {"job_id": "o_orderkey", "resource_id": "o_custkey", "status": "case o_orderstatus when 'F' then 'FAILED' when 'O' then 'COMPLETED' else 'QUEUED' end", "created_at": "o_orderdate", "retry_count": "cast(o_orderkey % 5 as int)"}),
    "chunks": ("lineitem", {"chunk_id": "l_orderkey * 8 + l_linenumber", "resource_id": "l_partkey", "chunk_index": "l_linenumber", "token_count": "cast(l_quantity as int)", "chunk_type": "l_returnflag"}),
}
BRIDGE = "select distinct l_partkey as resource_id, l_suppkey as author_id from lineitem"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in TEXTS else rows


def role(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, columns = ROLES[name]
    return table(spark, sf_dir, source).selectExpr(*(f"{e} as {c}" for c, e in columns.items()))


def resource_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("resource_id"), F.col("l_suppkey").alias("author_id")).distinct()


def resource_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag for each word of a part's name and type."""
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", F.lower("p_type")), " "))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("resource_id"), F.explode(words).alias("tag_name"))


TAGS = "select distinct p_partkey as resource_id, unnest(string_split(p_name || ' ' || lower(p_type), ' ')) as tag_name from part"


def with_roles(sql: str, *names: str) -> str:
    """sql behind the roles' definitions, for DuckDB."""
    parts = []
    for name in names:
        if name == "resource_authors":
            parts.append(f"resource_authors as ({BRIDGE})")
        elif name == "resource_tags":
            parts.append(f"resource_tags as ({TAGS})")
        else:
            source, columns = ROLES[name]
            parts.append(f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {source})")
    return f"with {', '.join(parts)} {sql}"
