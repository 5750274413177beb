"""What a search may see: resources that are ready and open to retrieval, one embedding space, and a request's filters."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import containment


@dataclass(frozen=True)
class Filters:
    """resource_ids: any of them; category: exactly; tags: any of them; metadata: all of it, as JSON containment. None or empty: no such filter."""

    resource_ids: tuple = ()
    category: str | None = None
    tags: tuple[str, ...] = ()
    metadata: dict = field(default_factory=dict)


def open_resources(resources: DataFrame, filters: Filters | None = None, tags: DataFrame | None = None) -> DataFrame:
    """The resources that a search may see. resources: (resource_id, rag_enabled, ingestion_status[, category_name, metadata]); tags: (resource_id, tag_name)."""
    filters = filters or Filters()
    out = resources.where(F.col("rag_enabled") & (F.col("ingestion_status") == "READY"))
    if filters.resource_ids:
        out = out.where(F.col("resource_id").isin(*filters.resource_ids))
    if filters.category is not None:
        out = out.where(F.col("category_name") == filters.category)
    if filters.metadata:
        out = out.where(containment("metadata", filters.metadata))
    if filters.tags:
        if tags is None:
            raise ValueError("a filter of tags needs the table of tags")
        out = out.join(tags.where(F.col("tag_name").isin(*filters.tags)), "resource_id", "left_semi")
    return out


def visible(chunks: DataFrame, resources: DataFrame, filters: Filters | None = None, tags: DataFrame | None = None) -> DataFrame:
    """The chunks (resource_id, ...) of resources that a search may see: a semi join before anything is scored."""
    return chunks.join(open_resources(resources, filters, tags).select("resource_id"), "resource_id", "left_semi")


def in_space(embeddings: DataFrame, provider: str, model: str, version: str, dimension: int) -> DataFrame:
    """Vectors of one embedding space."""
    wanted = {"provider": provider, "model": model, "version": version, "dimension": dimension}
    for name, value in wanted.items():
        embeddings = embeddings.where(F.col(f"embedding_{name}") == F.lit(value))
    return embeddings
