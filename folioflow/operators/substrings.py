"""Which of many short values hold which of many phrases, by an equi-join on one rare piece of each phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Letters of a piece; shorter phrases are looked up whole.
PIECE = 3


def _pieces(c: Column, size: int) -> Column:
    return F.when(F.length(c) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - size + 1), lambda i: F.substring(c, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def literal_part(phrase: Column) -> Column:
    """The longest part of a phrase without the wildcards % and _."""
    parts = F.transform(F.split(phrase, "[%_]"), lambda p: F.struct(F.length(p).alias("n"), p.alias("part")))
    return F.array_max(parts)["part"]


def inside(values: DataFrame, asked: DataFrame, wildcards: bool = False) -> DataFrame:
    """Distinct rows (query_id, value) where the value holds the phrase. values: (value); asked: (query_id, phrase); both are compared as they are.

    A value that holds a phrase holds all of its pieces, so the two meet by the piece of the phrase that fewest values have; a phrase with a piece
    that no value has meets none. wildcards: % and _ in a phrase stand for any letters, as LIKE reads them. Null or empty phrases are in no value.
    """
    values = values.select("value").where("value is not null").distinct()
    asked = asked.select("query_id", "phrase").where("length(phrase) > 0").withColumn("__literal", literal_part(F.col("phrase")) if wildcards else F.col("phrase"))
    # LIKE takes a backslash for an escape: such phrases are read letter by letter.
    like = F.expr("contains(phrase, '%') or contains(phrase, '_')") & ~F.contains("phrase", F.lit("\\")) if wildcards else F.lit(False)
    holds = F.when(like, F.expr("value like concat('%', replace(phrase, '\\\\', ''), '%')")).otherwise(F.contains("value", F.col("phrase")))
    out = None
    for size in range(PIECE, 0, -1):
        some = asked.where(F.length("__literal") >= size if size == PIECE else F.length("__literal") == size)
        if size < PIECE and some.isEmpty():
            continue
        of_values = values.select("value", F.explode(_pieces(F.col("value"), size)).alias("piece"))
        known = of_values.groupBy("piece").agg(F.count("*").alias("n"))
        each = some.select("query_id", "phrase", F.explode(_pieces(F.col("__literal"), size)).alias("piece")).join(known, "piece", "left")
        rare = each.groupBy("query_id", "phrase").agg(F.min_by("piece", F.coalesce("n", F.lit(0))).alias("piece"), F.min(F.coalesce("n", F.lit(0))).alias("n")).where("n > 0")
        found = of_values.join(rare.select("query_id", "phrase", "piece"), "piece").where(holds).select("query_id", "value")
        out = found if out is None else out.unionByName(found)
    if wildcards and not (blank := asked.where("length(__literal) = 0")).isEmpty():  # nothing but wildcards
        out = out.unionByName(values.crossJoin(blank).where(holds).select("query_id", "value"))
    return out.distinct()
