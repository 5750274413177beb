"""The catalog's tools by name, over a library of tables: pages of tables and searches, each a DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import catalog as C

MOST_ROWS = 100


@dataclass
class Library:
    """Tables by name; authors_of and tags_of name the bridges with their lookups joined."""

    tables: dict[str, DataFrame]
    authors_of: DataFrame
    tags_of: DataFrame


def _page(rows: DataFrame, limit: int, offset: int) -> DataFrame:
    if not 1 <= limit <= MOST_ROWS:
        raise ValueError(f"limit must be between 1 and {MOST_ROWS}")
    return C.page(rows, limit, offset)


def _required(name: str, value: str | None) -> str:
    if not C.cleaned(value):
        raise ValueError(f"{name} is required")
    return C.cleaned(value)


def _table(name: str) -> Callable[..., DataFrame]:
    def tool(library: Library, limit: int = 20, offset: int = 0) -> DataFrame:
        rows = library.tables[name]
        return _page(rows.orderBy(*rows.columns[:2]), limit, offset)

    return tool


def list_available_tables(library: Library) -> DataFrame:
    first = next(iter(library.tables.values()))
    return first.sparkSession.createDataFrame([(n,) for n in sorted(library.tables)], "table_name string")


def search_catalog_resources(library: Library, limit: int = 20, offset: int = 0, sort: str = "title", genre: str | None = None, **filters: str | None) -> DataFrame:
    filters["category"] = filters.get("category") or genre
    found = C.search(library.tables["resources"], library.tables["categories"], library.authors_of, library.tags_of, **filters)
    return C.with_arrays(_page(C.ordered(found, sort), limit, offset), library.authors_of, library.tags_of)


def get_resource_detail(library: Library, resource_id) -> DataFrame:
    _required("resource_id", str(resource_id))
    one = C.with_optional(C.named(library.tables["resources"].where(F.col("resource_id") == resource_id), library.tables["categories"]))
    return C.with_arrays(one, library.authors_of, library.tags_of)


def get_available_facets(library: Library) -> DataFrame:
    t = library.tables
    return C.facets(t["categories"], t["authors"], library.tags_of, t["resources"], t["subscription_tiers"])


def _search(name: str, columns: tuple[str, ...], order: tuple[str, ...]) -> Callable[..., DataFrame]:
    def tool(library: Library, q: str | None = None, limit: int = 20, offset: int = 0, **equal: str | None) -> DataFrame:
        return _page(C.lookup(library.tables[name], columns, q, **equal).orderBy(*order), limit, offset)

    return tool


TABLE_TOOLS = {
    "get_authors": "authors", "get_categories": "categories", "get_library_users": "users", "get_reading_progress": "reading_progress", "get_resource_authors": "resource_authors",
    "get_resource_tags": "resource_tags", "get_resources": "resources", "get_subscription_rules": "subscription_rules", "get_subscription_tiers": "subscription_tiers", "get_tags": "tags",
    "get_user_approval_requests": "approval_requests", "get_user_bookshelf": "bookshelf", "get_user_subscriptions": "subscriptions",
}
TOOLS: dict[str, Callable[..., DataFrame]] = {
    "list_available_tables": list_available_tables,
    "search_catalog_resources": search_catalog_resources,
    "get_resource_detail": get_resource_detail,
    "get_available_facets": get_available_facets,
    "get_books_by_author": lambda library, author, limit=20, offset=0: search_catalog_resources(library, limit, offset, author=_required("author", author)),
    "get_books_by_genre": lambda library, genre, limit=20, offset=0: search_catalog_resources(library, limit, offset, genre=_required("genre", genre)),
    "get_books_by_tag": lambda library, tag, limit=20, offset=0: search_catalog_resources(library, limit, offset, tag=_required("tag", tag)),
    "search_authors": _search("authors", ("author_name",), ("author_name", "author_id")),
    "search_users": _search("users", ("username", "email"), ("username", "user_id")),
    "search_subscriptions": _search("subscriptions", ("username", "email", "tier_code"), ("subscription_id",)),
    "search_approval_requests": _search("approval_requests", ("username", "email"), ("request_id",)),
} | {tool: _table(name) for tool, name in TABLE_TOOLS.items()}


def call(library: Library, tool: str, **arguments) -> DataFrame:
    if tool not in TOOLS:
        raise ValueError(f"unknown tool {tool}")
    return TOOLS[tool](library, **arguments)
