"""Catalog search: optional filters, arrays of authors and tags, facets, pages, latest rows, lookups.

Filters are folded into one Column and reach the Parquet scan; authors and tags are semi joins, never expanded into the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.sources.scratch import kept

MOST_ROWS = 500
#: Columns that older catalog tables lack, with what stands for them.
OPTIONAL = {"ingestion_status": "string", "rag_enabled": "boolean", "metadata_json": "string", "storage_path": "string"}


def cleaned(value: str | None) -> str | None:
    """A stripped value; blank is none, and its filter is left out."""
    return (value or "").strip() or None


def checked_page(limit: int, offset: int) -> tuple[int, int]:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be 1..{MOST_ROWS}")
    if offset < 0:
        raise ValueError("offset must be 0 or more")
    return limit, offset


def with_optional(resources: DataFrame) -> DataFrame:
    """resources with the optional columns: null where the table lacks them, an empty object for metadata_json."""
    missing = {c: F.lit("{}" if c == "metadata_json" else None).cast(kind) for c, kind in OPTIONAL.items() if c not in resources.columns}
    return resources.withColumns(missing) if missing else resources


def named(resources: DataFrame, categories: DataFrame) -> DataFrame:
    """resources with the name of their category; those without one stay."""
    return resources.join(categories.select("category_id", F.col("category_name").alias("category")), "category_id", "left")


def containing(column: str | Column, text: str) -> Column:
    """Case-insensitive LIKE with the text anywhere; its wildcards keep their meaning."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")).ilike(f"%{text}%")


def search(
    resources: DataFrame,
    categories: DataFrame,
    authors_of: DataFrame,
    tags_of: DataFrame,
    *,
    q: str | None = None,
    author: str | None = None,
    category: str | None = None,
    tag: str | None = None,
    publisher: str | None = None,
    language: str | None = None,
    tier: str | None = None,
    status: str | None = "ACTIVE",
    published_from: str | None = None,
    published_to: str | None = None,
) -> DataFrame:
    """The resources, with their category, that meet all filters given.

    authors_of: (resource_id, author_name); tags_of: (resource_id, tag_name). A blank filter doesn't count.
    """
    q, author, category, tag, publisher, language = map(cleaned, (q, author, category, tag, publisher, language))
    tests = []
    for column, value in (("minimum_tier_code", cleaned(tier)), ("status", cleaned(status))):
        if value:
            tests.append(F.col(column) == value.upper())
    if cleaned(published_from):
        tests.append(F.col("published_date") >= F.lit(cleaned(published_from)).cast("date"))
    if cleaned(published_to):
        tests.append(F.col("published_date") <= F.lit(cleaned(published_to)).cast("date"))
    for column, value in (("publisher", publisher), ("language", language)):
        if value:
            tests.append(F.col(column).ilike(f"%{value}%"))
    found = named(resources.where(reduce(Column.__and__, tests)) if tests else resources, categories)
    if category:
        found = found.where(F.col("category").ilike(f"%{category}%"))
    for value, bridge, name in ((author, authors_of, "author_name"), (tag, tags_of, "tag_name")):
        if value:
            found = found.join(bridge.where(F.col(name).ilike(f"%{value}%")).select("resource_id"), "resource_id", "left_semi")
    if q:
        # One of several: an id list of matching authors and tags, joined once as a flag.
        linked = authors_of.where(containing("author_name", q)).select("resource_id").unionByName(tags_of.where(containing("tag_name", q)).select("resource_id")).distinct()
        own = reduce(Column.__or__, (containing(c, q) for c in ("title", "description", "publisher", "isbn", "category")))
        found = found.join(linked.withColumn("__linked", F.lit(True)), "resource_id", "left").where(own | F.coalesce("__linked", F.lit(False))).drop("__linked")
    return found


#: Sort keys by name; an unknown name sorts by title. The id comes last everywhere, so that pages are stable.
ORDERS = {
    "title": ("title", "-created_at"),
    "created_desc": ("-created_at", "title"),
    "created_asc": ("created_at", "title"),
    "published_desc": ("-published_date", "title"),
    "published_asc": ("published_date", "title"),
}


def ordered(found: DataFrame, sort: str = "title", key: str = "resource_id") -> DataFrame:
    columns = [F.desc_nulls_last(c[1:]) if c[0] == "-" else F.asc_nulls_last(c) for c in ORDERS.get(sort, ORDERS["title"])]
    return found.orderBy(*columns, key)


def page(found: DataFrame, limit: int = 20, offset: int = 0) -> DataFrame:
    limit, offset = checked_page(limit, offset)
    return found.offset(offset).limit(limit)


def with_arrays(found: DataFrame, authors_of: DataFrame, tags_of: DataFrame) -> DataFrame:
    """found with sorted arrays of its authors and tags, empty where there are none."""
    for bridge, name, out in ((authors_of, "author_name", "authors"), (tags_of, "tag_name", "tags")):
        wanted = bridge.join(found.select("resource_id").distinct(), "resource_id", "left_semi")
        lists = wanted.groupBy("resource_id").agg(F.sort_array(F.collect_list(name)).alias(out))
        found = found.join(lists, "resource_id", "left").withColumn(out, F.coalesce(out, F.array().cast("array<string>")))
    return found


def facets(categories: DataFrame, authors: DataFrame, tags_of: DataFrame, resources: DataFrame, tiers: DataFrame) -> DataFrame:
    """Rows (facet, value, position): active categories, authors and tiers, all tags, the languages in use."""
    active = F.col("status") == "ACTIVE"
    parts = [
        categories.where(active).select(F.lit("category").alias("facet"), F.col("category_name").alias("value"), F.lit(0).alias("place")),
        authors.where(active).select(F.lit("author"), "author_name", F.lit(0)),
        tags_of.select(F.lit("tag"), "tag_name", F.lit(0)).distinct(),
        resources.where("language <> ''").select(F.lit("language"), "language", F.lit(0)).distinct(),
        tiers.where(active).select(F.lit("tier"), "tier_code", "display_order"),
    ]
    union = reduce(DataFrame.union, parts)
    # Ranges of the order are numbered each by itself, then moved by what the ranges before hold: no task sees a whole facet.
    ranges = kept(union.repartitionByRange("facet", "place", "value").withColumn("range", F.spark_partition_id()), "facets")
    sizes = ranges.groupBy("facet", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("facet").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("facet", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("facet", "range").orderBy("place", "value"))
    return ranges.withColumn("own", own).join(starts, ["facet", "range"]).select("facet", "value", (F.col("start") + F.col("own")).cast("long").alias("position"))


def latest(rows: DataFrame, by: str, order: list[str], columns: list[str]) -> DataFrame:
    """Of each key, the columns of the row that is last in the order; no window and no sort, only a partial aggregate."""
    last = F.max_by(F.struct(*columns), F.struct(*order))
    return rows.groupBy(by).agg(last.alias("last")).select(by, "last.*")


def counts(rows: DataFrame, by: str, name: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias(name))


def admin_list(resources: DataFrame, categories: DataFrame, authors_of: DataFrame, chunks: DataFrame, embeddings: DataFrame, jobs: DataFrame, errors: DataFrame | None = None, tags_of: DataFrame | None = None) -> DataFrame:
    """Each resource with its category, first author, tags, counts of chunks, embeddings and jobs, latest job and latest error.

    errors: (resource_id, created_at, message, stage, type); without one, the error is the latest job's own message, if jobs have one.
    """
    said = ["error_message"] if "error_message" in jobs.columns else []
    out = (
        named(resources, categories)
        .join(authors_of.groupBy("resource_id").agg(F.min("author_name").alias("author")), "resource_id", "left")
        .join(counts(chunks, "resource_id", "chunk_count"), "resource_id", "left")
        .join(counts(chunks.join(embeddings, "chunk_id"), "resource_id", "embedding_count"), "resource_id", "left")
        .join(latest(jobs, "resource_id", ["created_at", "job_id"], ["job_id", "status", *said]).withColumnsRenamed({"job_id": "latest_job_id", "status": "latest_job_status"}), "resource_id", "left")
        .join(counts(jobs, "resource_id", "job_count"), "resource_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("chunk_count", "embedding_count", "job_count")})
    )
    if not said:
        out = out.withColumn("error_message", F.lit(None).cast("string"))
    if errors is not None:
        named_as = {"message": "latest_error_message", "stage": "latest_error_stage", "type": "latest_error_type"}
        out = out.join(latest(errors, "resource_id", ["created_at", "message"], list(named_as)).withColumnsRenamed(named_as), "resource_id", "left").withColumn("latest_error_message", F.coalesce("latest_error_message", "error_message"))
    else:
        out = out.withColumn("latest_error_message", F.col("error_message"))
    if tags_of is not None:
        tags = tags_of.groupBy("resource_id").agg(F.sort_array(F.collect_set("tag_name")).alias("tags"))
        out = out.join(tags, "resource_id", "left").withColumn("tags", F.coalesce("tags", F.array().cast("array<string>")))
    return out.drop("error_message")


def lookup(rows: DataFrame, columns: tuple[str, ...], q: str | None = None, **equal: str | None) -> DataFrame:
    """Rows of which one of the columns contains q, and whose columns named in equal hold the upper-cased values."""
    tests = [F.col(c) == cleaned(v).upper() for c, v in equal.items() if cleaned(v)]
    if cleaned(q):
        tests.append(reduce(Column.__or__, (containing(c, cleaned(q)) for c in columns)))
    return rows.where(reduce(Column.__and__, tests)) if tests else rows


def containment(column: str, wanted: dict, path: str = "$") -> Column:
    """A JSON text holds all of `wanted`: each leaf equal as text, arrays as sets of strings. paths.containing() tells types apart."""
    tests = []
    for key, value in wanted.items():
        # In brackets, so that a dot in a key is a part of it.
        at = f"{path}.{key}" if "'" in key else f"{path}['{key}']"
        if isinstance(value, dict):
            tests.append(containment(column, value, at))
        elif isinstance(value, list):
            have = F.from_json(F.get_json_object(column, at), "array<string>")
            tests.append(F.size(F.array_except(F.array(*(F.lit(str(v)) for v in value)), have)) == 0)
        else:
            text = {True: "true", False: "false"}.get(value, str(value)) if isinstance(value, bool) else str(value)
            tests.append(F.get_json_object(column, at) == text)
    return reduce(Column.__and__, tests, F.lit(True))
