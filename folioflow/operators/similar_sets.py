"""For each query the values most similar to it as sets of trigrams, without building the pairs that can't be among them.

Trigrams are taken in order of rarity. A value that shares none of a query's p rarest of m trigrams shares m - p at most, so
its similarity is (m - p) / m at most, and a value of similarity s shares s / (1 + s) of both sizes together. The rarest trigrams give the
first pairs, their exact scores a k-th score; then only as many further trigrams are looked up as a value of that score must share, and only for
values of a fitting size. Pairs carry numbers and sizes; trigrams themselves are fetched for pairs that can still reach the k-th score.

Cases: a null or empty value, or one without letters and digits, has no trigrams and is similar to nothing; a query likewise; equal
values of different keys are values of their own; of a table without values or queries nothing is found.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.scratch import kept

#: Pairs that a query's first look-up may build for each of its k results, unless its rarest trigram alone has more.
FIRST_PAIRS = 16
TINY = 1e-9


def _needed(score, m, n):
    """Trigrams that sets of m and n share at least, if they are so similar."""
    return F.ceil(score * (m + n) / (1 + score) - TINY)


def candidates(values: DataFrame, queries: DataFrame, k: int, least: float, key: str, floor: DataFrame | None = None, known: DataFrame | None = None, report: dict | None = None) -> DataFrame:
    """Rows (query_id, key, similarity) with similarity > least: all that can be among a query's k best, ties included.

    values: (key, value); queries: (query_id, query). known: pairs (query_id, key, score) found otherwise, whose scores count for the k-th one.
    floor: (query_id, floor): scores up to which pairs get by other means than these trigrams, so that nothing above `least` is cut for
    queries whose k-th score is below. report, if given, tells how many pairs were built.
    """
    own = kept(values.select(key, T.trigrams("value").alias("t")).withColumn("n", F.size("t")).where("n > 0"), "sets")
    asked = kept(queries.select("query_id", T.trigrams("query").alias("q")).withColumn("m", F.size("q")).where("m > 0"), "asked")
    postings = own.select(key, "n", F.explode("t").alias("gram"))
    grams = asked.select("query_id", "m", F.explode("q").alias("gram"))
    often = kept(postings.join(grams.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("df")), "often")
    rarest = Window.partitionBy("query_id").orderBy("df", "gram")
    # One query's trigrams: as many as its text has letters.
    ranked = grams.join(often, "gram", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    ranked = kept(ranked.withColumns({"p": F.row_number().over(rarest), "pairs": F.sum("df").over(rarest.rowsBetween(Window.unboundedPreceding, 0))}), "ranked")
    first = (F.col("pairs") <= FIRST_PAIRS * k) | (F.col("p") == F.col("from"))
    # The rarest trigram that any value has is looked up whatever it brings.
    begins = ranked.where("df > 0").groupBy("query_id").agg(F.min("p").alias("from"))
    looked = kept(ranked.join(begins, "query_id").withColumn("first", first), "looked")

    def met(some: DataFrame) -> DataFrame:
        """(query_id, key, m, n, shared) of the values that have some of the trigrams, counted by shared ones."""
        pairs = postings.join(some, "gram").groupBy("query_id", key, "m", "n").agg(F.count("*").alias("shared"))
        return pairs

    def exact(pairs: DataFrame) -> DataFrame:
        full = pairs.select("query_id", key).join(own, key).join(asked, "query_id")
        return full.select("query_id", key, T.trigram_similarity(F.col("t"), F.col("q")).alias("similarity"))

    begun = kept(met(looked.where("first").select("query_id", "m", "gram")), "begun")
    scores = kept(exact(begun), "scores")
    said = scores.select("query_id", key, F.col("similarity").alias("score"))
    if known is not None:
        said = said.unionByName(known.select("query_id", key, "score")).groupBy("query_id", key).agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"))
    kth = said.withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k).select("query_id", F.col("score").alias("kth"))
    if floor is not None:
        kth = kth.join(floor, "query_id", "left").where(F.col("kth") > F.coalesce("floor", F.lit(0.0))).select("query_id", "kth")
    # What a query must at least reach; below `least` nothing counts.
    bar = kept(asked.select("query_id", "m").join(kth, "query_id", "left").select("query_id", "m", F.greatest(F.coalesce("kth", F.lit(least)), F.lit(least)).alias("bar")), "bar")
    # A value at the bar shares bar * m trigrams, so one of the m - bar * m + 1 rarest at least.
    prefix = F.col("m") - F.ceil(F.col("bar") * F.col("m") - TINY) + 1
    reach = looked.join(bar.select("query_id", "bar"), "query_id").withColumn("prefix", prefix)
    rest = reach.where("p <= prefix and df > 0").select("query_id", "m", "gram", "bar", "prefix")
    fitting = (F.col("n") >= F.ceil(F.col("bar") * F.col("m") - TINY)) & (F.col("n") * F.col("bar") <= F.col("m") + TINY)
    # Of queries whose first look-up went as far as their prefix nothing is left to find.
    open_ = reach.where("p <= prefix and df > 0 and not first").select("query_id").distinct()
    more = postings.join(rest.join(open_, "query_id", "left_semi"), "gram").where(fitting).groupBy("query_id", key, "m", "n", "bar", "prefix").agg(F.count("*").alias("shared"))
    # What the rarer trigrams don't share, at most the others behind the prefix can.
    able = more.where(F.col("shared") + F.col("m") - F.col("prefix") >= _needed(F.col("bar"), F.col("m"), F.col("n")))
    new = kept(able.join(begun.select("query_id", key), ["query_id", key], "left_anti").select("query_id", key), "new")
    if report is not None:
        report.update(first=begun.count(), further=new.count(), all=own.count() * asked.count())
    return scores.unionByName(exact(new)).where(F.col("similarity") > least)
