"""Tables written once for each stage, and read again instead of being built anew."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that tables are partitioned by: what searches select, or what is replaced as a whole.
PARTITIONS = {"embeddings": ["provider", "model", "version"], "profiling": ["job_id"], "entities": ["resource_bucket"], "relationships": ["resource_bucket"], "chunks": ["resource_bucket"]}
BUCKETS = 64


def bucketed(rows: DataFrame, key: str = "resource_id") -> DataFrame:
    """rows with resource_bucket: a bounded number of folders however many resources there are."""
    return rows.withColumn("resource_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))


def append(rows: DataFrame, path: str, table: str) -> None:
    """Add rows to a table; rows of one folder are brought together, so that files stay few."""
    by = PARTITIONS.get(table, [])
    if "resource_bucket" in by and "resource_bucket" not in rows.columns:
        rows = bucketed(rows)
    (rows.repartition(*by) if by else rows).write.mode("append").partitionBy(*by).parquet(path)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Put rows in place of the folders that they belong to; other folders stay."""
    rows.repartition(*by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table of a stage: read if an earlier run has finished it, else built and written."""
    if not exists(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def with_cache(rows: DataFrame, cache: DataFrame, keys: list[str], build: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(results of all rows, results that were built): a cached result stands for a row of equal keys, such as a chunk's hash and a version."""
    fresh = build(rows.join(cache.select(keys).distinct(), keys, "left_anti"))
    return rows.select(keys).distinct().join(cache, keys).unionByName(fresh.select(cache.columns)), fresh
