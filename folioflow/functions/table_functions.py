"""Table functions for SQL: chunks of a document's sections, and the catalog's searches by name.

    select * from chunks_of(table(sections) partition by doc_id order by (section), 120, 8)
    select * from books_by_genre('Poetry', 20, 0)
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from folioflow.operators.chunking import OVERLAP, SIZE, TOKENS, word_windows

#: What the table argument must have; its other columns are the document's own and come back as they are.
TITLE, BODY = "title", "body"


class ChunksOf:
    """Word windows of a partition's sections (title, body, keys), equal texts once, numbered from 0."""

    def __init__(self):
        self.seen: set[bytes] = set()
        self.index = 0

    @staticmethod
    def analyze(sections: AnalyzeArgument, size: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not sections.isTable:
            raise ValueError("the first argument must be a table: chunks_of(table(...) partition by ...)")
        given = {f.name: f for f in sections.dataType.fields}
        if missing := [c for c in (TITLE, BODY) if c not in given]:
            raise ValueError(f"the table has no column {', '.join(missing)}")
        for name, a in (("size", size), ("overlap", overlap)):
            if a is not None and (not a.isConstantExpression or not isinstance(a.dataType, (IntegerType, LongType))):
                raise ValueError(f"{name} must be a whole number")
        keys = [f for n, f in given.items() if n not in (TITLE, BODY)]
        own = [StructField("chunk_index", IntegerType()), StructField("section_title", StringType()), StructField("chunk_text", StringType()), StructField("token_count", IntegerType()), StructField("chunk_hash", StringType())]
        return AnalyzeResult(schema=StructType([*keys, *own]))

    def eval(self, section: Row, size: int = SIZE, overlap: int = OVERLAP) -> Iterator[tuple]:
        keys = [v for n, v in section.asDict().items() if n not in (TITLE, BODY)]
        for text in word_windows(re.sub(r"\s+", " ", section[BODY] or ""), size, overlap):
            digest = hashlib.sha256(text.encode())
            if text and digest.digest() not in self.seen:
                self.seen.add(digest.digest())
                yield (*keys, self.index, section[TITLE], text, len(TOKENS.findall(text)), digest.hexdigest())
                self.index += 1


#: Searches as SQL functions over the library's tables: (parameters, columns, query). A page of the rows in their order.
SEARCHES = {
    "books_by_genre": ("genre string", "resource_id, title, category_name", "select r.resource_id, r.title, c.category_name from library_resources r join library_categories c using (category_id) where c.category_name = genre", "title, resource_id"),
    "books_by_tag": ("tag string", "resource_id, title, tag_name", "select r.resource_id, r.title, t.tag_name from library_resources r join library_resource_tags t using (resource_id) where t.tag_name = tag", "title, resource_id"),
    "users_named": ("part string", "user_id, username, email", "select user_id, username, email from library_users where contains(lower(username), lower(part)) or contains(lower(email), lower(part))", "username, user_id"),
    "authors_named": ("part string", "author_id, author_name", "select author_id, author_name from library_authors where contains(lower(author_name), lower(part))", "author_name, author_id"),
}


def register(spark: SparkSession, tables: dict[str, DataFrame] | None = None) -> None:
    """chunks_of(), and the searches if there are tables, as temporary functions of the session; tables are those of operators.tools.Library."""
    spark.udtf.register("chunks_of", udtf(ChunksOf))
    for name, rows in (tables or {}).items():
        rows.createOrReplaceTempView(f"library_{name}")
    for name, (parameter, columns, query, order) in SEARCHES.items():
        if tables:
            kinds = ", ".join(f"{c} {t}" for c, t in spark.sql(query.replace(f"= {parameter.split()[0]}", "= ''").replace(f"lower({parameter.split()[0]})", "''")).dtypes)
            paged = f"select {columns} from (select *, row_number() over (order by {order}) as nth from ({query})) where nth > skip and nth <= skip + most"
            spark.sql(f"create or replace temporary function {name}({parameter}, most int default 20, skip int default 0) returns table ({kinds}) return {paged}")
