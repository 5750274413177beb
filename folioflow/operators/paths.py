"""JSON containment by a path index: typed leaves of documents, counted against those of a request, then the documents themselves.

A document is cut level by level into the leaves of its VARIANT: (path, kind, value) with numbers as numbers, so the text "69" isn't the
number 69. A step into an object is its key, a step into an array any place of it. A document that holds a request has all of the request's leaves,
which a counting semi join tells without reading documents; whether they stand together, in one element of an array, is then looked at in
the few that are left. The rules are those of the relational database's containment operator: objects by their keys, arrays as sets
whose elements contain each other, a bare value inside an array of the first level.
"""

from __future__ import annotations

import json
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from folioflow.sources.scratch import kept

#: Steps: a key behind a mark, any place of an array.
KEY, PLACE = "\x01", "\x02"


def leaves(docs: DataFrame, key: str, column: str) -> DataFrame:
    """Distinct rows (key, path, kind, value) of the leaves of JSON texts; empty objects and arrays are leaves of their own. Texts that are no JSON have none."""
    level = docs.select(key, F.lit("").alias("path"), F.try_parse_json(column).alias("v")).where(F.col("v").isNotNull())
    out = None
    while True:
        typed = kept(level.withColumn("kind", F.schema_of_variant("v")), "level")
        nested = F.col("kind").rlike("^(OBJECT|ARRAY)")
        number = F.col("kind").rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT|INT|SMALLINT|TINYINT)")
        kind = F.when(nested, F.left("kind", F.lit(1))).when(number, "n").when(F.col("kind") == "STRING", "s").when(F.col("kind") == "BOOLEAN", "b").otherwise("0")
        # Equal numbers are equal however they are written.
        value = F.when(number, F.to_json("v").cast("double").cast("string")).otherwise(F.to_json("v"))
        own = typed.where(~nested | F.to_json("v").isin("{}", "[]")).select(key, "path", kind.alias("kind"), value.alias("value"))
        out = own if out is None else out.unionByName(own)
        inner = typed.where(nested)
        if inner.isEmpty():
            return out.distinct()
        inner.createOrReplaceTempView("__level")
        # Documents are a few levels deep: a turn a level.
        level = inner.sparkSession.sql(f"select l.`{key}`, l.path, l.kind, e.key as step, e.value as v from __level l, lateral variant_explode(l.v) e")
        step = F.when(F.startswith("kind", F.lit("OBJECT")), F.concat(F.lit(KEY), "step")).otherwise(PLACE)
        level = level.select(key, F.concat("path", step).alias("path"), "v")


def holds(have, wanted) -> bool:
    """Whether a JSON value contains another."""

    def inside(a, b) -> bool:
        if isinstance(b, dict):
            return isinstance(a, dict) and all(k in a and inside(a[k], v) for k, v in b.items())
        if isinstance(b, list):
            return isinstance(a, list) and all(any(inside(x, y) for x in a) for y in b)
        return type(a) is type(b) and a == b or (isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool) and not isinstance(b, bool) and a == b)

    if isinstance(have, list) and not isinstance(wanted, (dict, list)):
        return any(inside(x, wanted) for x in have)
    return inside(have, wanted)


@F.pandas_udf(BooleanType())
def _holds(have: pd.Series, wanted: pd.Series) -> pd.Series:
    def one(a: str | None, b: str) -> bool:
        try:
            return a is not None and holds(json.loads(a), json.loads(b))
        except ValueError:
            return False

    return pd.Series([one(a, b) for a, b in zip(have, wanted)], dtype="boolean")


def containing(docs: DataFrame, requests: DataFrame, key: str, column: str, index: DataFrame | None = None) -> DataFrame:
    """Rows (query_id, key) of the documents (key, column) that hold a request (query_id, wanted), both JSON texts. index: leaves() of the documents, if stored."""
    asked = kept(requests.select("query_id", "wanted"), "asked")
    index = leaves(docs, key, column) if index is None else index
    need = leaves(asked, "query_id", "wanted").where("kind not in ('O', 'A')")
    # A bare value may also stand in an array of the first level.
    bare = need.where("path = ''").select("query_id", F.lit(PLACE).alias("path"), "kind", "value").withColumn("at", F.lit(""))
    need = kept(need.withColumn("at", F.col("path")).unionByName(bare), "need")
    count = need.groupBy("query_id").agg(F.count_distinct("at", "kind", "value").alias("n"))
    found = need.join(index, ["path", "kind", "value"]).groupBy("query_id", key).agg(F.count_distinct("at", "kind", "value").alias("had"))
    able = found.join(count, "query_id").where("had = n").select("query_id", key)
    # A request without a leaf, such as {}, is held by whatever has its shape: it is asked of all documents.
    shapes = asked.join(count, "query_id", "left_anti")
    if not shapes.isEmpty():
        able = able.unionByName(docs.where(F.col(column).isNotNull()).select(key).join(shapes.select("query_id")).select("query_id", key))
    full = able.join(asked, "query_id").join(docs.select(key, column), key)
    return full.where(_holds(F.col(column), F.col("wanted"))).select("query_id", key)
