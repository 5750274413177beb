"""Batches of new users and of document metadata into catalog tables, checked before they are appended.

Ids are hashes of natural keys, so that a batch run twice adds nothing twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T


def natural_id(*parts: str | Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def registered(requests: DataFrame, users: DataFrame, tiers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(users, approvals, subscriptions, refused) of requests (full_name, email, account_id, tier_code).

    Refused with a reason: an unknown or inactive tier; an address or account that is known already or stands earlier in the batch.
    """
    keyed = requests.withColumn("email_key", F.lower("email"))
    active = tiers.where("status = 'ACTIVE'").select("tier_code", F.lit(True).alias("__tier")).distinct()
    known = users.select(F.lower("email").alias("email_key"), F.lit(True).alias("__mail")).distinct()
    accounts = users.where("account_id is not null").select("account_id", F.lit(True).alias("__account")).distinct()
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy("email_key", "account_id", "full_name", "tier_code"))
    told = keyed.join(active, "tier_code", "left").join(known, "email_key", "left").join(accounts, "account_id", "left").withColumns({"__a": first("email_key"), "__b": first("account_id")})
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = F.when(~flag("__tier"), "unknown tier").when(flag("__mail") | flag("__account") | (F.col("__a") > 1) | (F.col("__b") > 1), "user exists")
    told = told.withColumn("reason", reason).select("full_name", "email", "account_id", "tier_code", "reason")
    good = told.where("reason is null").withColumn("user_id", natural_id(F.lower("email")))
    return (
        good.select("user_id", "full_name", "email", "account_id", F.lit("ACTIVE").alias("status"), F.lit("APPROVED").alias("approval_status")),
        good.select(natural_id("user_id", F.lit("approval")).alias("request_id"), "user_id", F.lit("APPROVED").alias("status"), F.lit("Auto-approved during self-registration").alias("comments")),
        good.select(natural_id("user_id", "tier_code").alias("subscription_id"), "user_id", "tier_code", F.lit("ACTIVE").alias("status")),
        told.where("reason is not null"),
    )


def new_names(names: DataFrame, known: DataFrame, name: str, key: str) -> DataFrame:
    """Rows (key, name) of the names that the lookup table doesn't have, blank ones left out."""
    clean = names.select(F.nullif(T.one_space(F.col(name)), F.lit("")).alias(name)).where(F.col(name).isNotNull()).distinct()
    return clean.join(known.select(name), name, "left_anti").select(natural_id(name).alias(key), name)


def bridged(rows: DataFrame, owner: str, names: str) -> DataFrame:
    """Rows (owner, name, place) of arrays of names: cleaned, the first spelling of those that differ by case only."""
    flat = rows.select(owner, F.posexplode(names).alias("place", "name")).withColumn("name", T.one_space("name")).where("name <> ''")
    return flat.groupBy(owner, F.lower("name").alias("k")).agg(F.min_by("name", "place").alias("name"), F.min("place").alias("place")).drop("k")


def persisted_metadata(metadata: DataFrame, categories: DataFrame, authors: DataFrame, tags: DataFrame) -> dict[str, DataFrame]:
    """New rows of resources, categories, authors, tags and both bridges from metadata (resource_id, title, file_name, category_name, genre, author, tags, language, publisher)."""
    blank = lambda c: F.nullif(T.one_space(F.col(c)), F.lit(""))
    rows = metadata.withColumns({"category": F.coalesce(blank("category_name"), blank("genre")), "author_name": blank("author")})
    tag_rows = bridged(rows, "resource_id", "tags").withColumnRenamed("name", "tag_name")
    return {
        "categories": new_names(rows.select(F.col("category").alias("category_name")), categories, "category_name", "category_id"),
        "authors": new_names(rows, authors, "author_name", "author_id"),
        "tags": new_names(tag_rows, tags, "tag_name", "tag_id"),
        "resource_authors": rows.where("author_name is not null").select("resource_id", "author_name"),
        "resource_tags": tag_rows.select("resource_id", "tag_name"),
        "resources": rows.select("resource_id", F.coalesce(blank("title"), "file_name").alias("title"), "category", F.coalesce(blank("language"), F.lit("English")).alias("language"), blank("publisher").alias("publisher")),
    }


def union_of(*frames: DataFrame) -> DataFrame:
    """Rows of tables whose columns differ, in the order in which columns are first met."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
