"""Exact histogram of document lengths in tokens, with sums that answer every context limit.

Documents are aggregated by their encoded length before anything is shuffled further. Over the lengths in order, sums from the far end give,
for a limit at each length, how many documents are longer, how many tokens a cut at the limit keeps, and which quantile it is. A limit
between two lengths follows from the next greater one (at_limits). Sums run over blocks of lengths first, then inside the blocks, so
no task sees all lengths.

Cases: a null or empty text has length 0; repeated rows count one by one; ids don't matter; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, map_arrow, utf8
from .packing import ENCODE_TEXTS, word_ids

#: Lengths whose sums run together.
BLOCK = 64


def encoded_lengths(docs: DataFrame, tokenizer_path: str | None = None, text_col: str = "text") -> DataFrame:
    """Rows (length, n): documents of each length, summed up within each batch only."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")

    def make():
        encode = word_ids(tokenizer_path)

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            texts = [t or b"" for t in utf8(batch.column(0))]
            counts: dict[int, int] = {}
            for i in range(0, len(texts), ENCODE_TEXTS):
                for ids in encode(texts[i : i + ENCODE_TEXTS]):
                    counts[len(ids) // 4] = counts.get(len(ids) // 4, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "n"])

        return each

    return map_arrow(docs.select(F.col(text_col).alias("text")), make, "length long, n long")


def with_sums(counts: DataFrame) -> DataFrame:
    """counts (length, n), lengths repeated or not, as one row a length with the sums over all lengths.

    n_docs: of this length; docs_longer: of a greater one; docs_within, tokens_within: up to this one; tokens_kept: of all documents
    cut at this length; tokens_lost: the rest; quantile: docs_within over all documents.
    """
    # The histogram is used twice below: written once, so that texts are encoded once.
    by_length = Scratch(counts.sparkSession, "lengths").keep(counts.groupBy("length").agg(F.sum("n").alias("n_docs")).withColumn("block", F.expr(f"length div {BLOCK}")))
    blocks = by_length.groupBy("block").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("length")).alias("tokens"))
    later = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    # One row a block: as many as the longest document has blocks of BLOCK tokens.
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(everything).alias("all_docs"),
        F.sum("tokens").over(everything).alias("all_tokens"),
    )
    behind = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    summed = by_length.join(blocks, "block").select(
        "length",
        "n_docs",
        (F.col("docs_later") + F.coalesce(F.sum("n_docs").over(behind), F.lit(0))).alias("docs_longer"),
        (F.col("tokens_later") + F.coalesce(F.sum(F.col("n_docs") * F.col("length")).over(behind), F.lit(0))).alias("tokens_longer"),
        "all_docs",
        "all_tokens",
    )
    within, kept = F.col("all_tokens") - F.col("tokens_longer"), F.col("all_tokens") - F.col("tokens_longer") + F.col("length") * F.col("docs_longer")
    return summed.select(
        "length",
        "n_docs",
        "docs_longer",
        (F.col("all_docs") - F.col("docs_longer")).alias("docs_within"),
        within.alias("tokens_within"),
        kept.alias("tokens_kept"),
        (F.col("all_tokens") - kept).alias("tokens_lost"),
        ((F.col("all_docs") - F.col("docs_longer")) / F.col("all_docs")).alias("quantile"),
    )


def at_limits(sums: DataFrame, limits: list[int]) -> DataFrame:
    """Rows (limit, docs_within, docs_longer, tokens_kept, tokens_lost) for any context limits, from with_sums()."""
    spark = sums.sparkSession
    asked = F.broadcast(spark.createDataFrame([(int(x),) for x in sorted(set(limits))], "limit long"))
    # The lengths up to a limit leave their greatest; all documents stand in any row.
    last = sums.join(asked, F.col("length") <= F.col("limit")).groupBy("limit").agg(F.max_by(F.struct("docs_within", "docs_longer", "tokens_within"), "length").alias("r"))
    total = sums.agg(F.sum("n_docs").alias("all_docs"), F.sum(F.col("n_docs") * F.col("length")).alias("all_tokens"))
    given = asked.join(last, "limit", "left").join(F.broadcast(total))
    longer = F.coalesce("r.docs_longer", "all_docs", F.lit(0))
    kept = F.coalesce("r.tokens_within", F.lit(0)) + longer * F.col("limit")
    return given.select("limit", F.coalesce("r.docs_within", F.lit(0)).alias("docs_within"), longer.alias("docs_longer"), kept.alias("tokens_kept"), (F.coalesce("all_tokens", F.lit(0)) - kept).alias("tokens_lost"))


def value_at(sums: DataFrame, quantiles: list[float]) -> DataFrame:
    """Rows (quantile, length): the least length that at least that share of the documents doesn't exceed."""
    asked = F.broadcast(sums.sparkSession.createDataFrame([(float(q),) for q in sorted(set(quantiles))], "asked double"))
    return sums.join(asked, F.col("quantile") >= F.col("asked")).groupBy(F.col("asked").alias("quantile")).agg(F.min("length").alias("length"))


def op2_length_histogram(spark, sf_dir: str) -> DataFrame:
    return with_sums(encoded_lengths(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES = {"op2_length_histogram": op2_length_histogram}
ORACLES: dict[str, str] = {}
