"""A stored full-text index: postings by term in blocks of chunks, with a bound for each block, so that a search reads only blocks that can matter.

One table in a folder, partitioned by a bucket of the term and sorted by term: (term, block, most, keys, places). A block is up to BLOCK chunks of one
task; `most` is the greatest number of places that one of them has of the term. A row of the empty term lists all of a block's
chunks. More chunks are appended as a segment of blocks with greater numbers; chunks that are deleted are listed with the first block
number that the deletion doesn't concern, so that a chunk may come again.

The cover density of n terms is WEIGHT at most for each cover, and each cover but the first n - 1 terms ends at a place of its own, so a
chunk scores WEIGHT * (places - n + 1) at most. By that bound the blocks are read in turns.

Cases: a null text has no terms; a key that is stored twice without a deletion counts by its better score; an index of no
chunks finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from folioflow.functions.stem import stem
from folioflow.sources.scratch import dealt as in_tasks
from folioflow.sources.scratch import kept

from .fulltext import STOP, WEIGHT, WORD, cover_density

#: Chunks to a block; buckets of terms.
BLOCK, BUCKETS = 128, 32
#: Bits of a block's number below its segment, and below its task.
SEGMENT_BITS, TASK_BITS = 44, 24
POSTING = "term string, block long, most int, keys array<{key}>, places array<array<int>>"


def _bucket(term):
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _blocks_of(segment: int, stemmed: bool, key_type: pa.DataType):
    """Postings of each task's chunks (key, words), block by block."""
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(key_type), pa.list_(pa.list_(pa.int32()))]

    def run(batches) -> Iterator[pa.RecordBatch]:
        number = (segment << SEGMENT_BITS) | (TaskContext.get().partitionId() << TASK_BITS)
        known: dict[str, str | None] = dict.fromkeys(STOP)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                keys, texts = batch.column(0).slice(start, BLOCK), batch.column(1).slice(start, BLOCK)
                if len(known) > 1 << 20:
                    known = dict.fromkeys(STOP)
                yield _block(number, keys, texts, known, stemmed, kinds)
                number += 1

    return run


def _block(number: int, keys: pa.Array, texts: pa.ListArray, known: dict[str, str | None], stemmed: bool, kinds: list[pa.DataType]) -> pa.RecordBatch:
    """Postings of one block's chunks: words are told apart once, then sorted by term; chunks and places stay in order."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), np.int64)
    words = texts.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    for word in distinct:
        if word not in known:
            known[word] = stem(word) if stemmed else word
    terms = sorted({t for w in distinct if (t := known[w]) is not None})
    place = {t: i for i, t in enumerate(terms)}
    term_of = np.array([place.get(known[w], -1) for w in distinct], np.int64)
    term = term_of[words.indices.to_numpy()] if len(distinct) else np.empty(0, np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    order = np.flatnonzero(term >= 0)
    order = order[np.argsort(term[order], kind="stable")]
    term, chunk, at = term[order], chunk[order], at[order]
    # A posting is a run of one term and chunk; a term's row is a run of postings.
    first = np.flatnonzero(np.r_[True, (term[1:] != term[:-1]) | (chunk[1:] != chunk[:-1])]) if len(term) else np.empty(0, np.int64)
    counts = np.diff(np.r_[first, len(term)])
    rows = np.searchsorted(term[first], np.arange(len(terms)))
    ends = np.r_[rows, len(first)].astype(np.int32)
    most = np.maximum.reduceat(counts, rows) if len(terms) else np.empty(0, np.int64)
    places = pa.ListArray.from_arrays(pa.array(np.r_[first, len(term)].astype(np.int32)), pa.array(at.astype(np.int32)))
    # The row of the empty term comes first and has no places.
    held = pa.concat_arrays([keys, keys.take(pa.array(chunk[first]))])
    columns = (
        pa.array(["", *terms], kinds[0]),
        pa.array(np.full(len(terms) + 1, number), kinds[1]),
        pa.array(np.r_[0, most].astype(np.int32), kinds[2]),
        pa.ListArray.from_arrays(pa.array(np.r_[0, ends + len(keys)].astype(np.int32)), held),
        pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), places),
    )
    return pa.RecordBatch.from_arrays([c.cast(k) for c, k in zip(columns, kinds)], ["term", "block", "most", "keys", "places"])


def _groups(batches, size: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that agree in the first `size` columns, one group after the other; rows are sorted by these."""
    now, held = None, []
    for batch in batches:
        heads = list(zip(*(batch.column(i).to_pylist() for i in range(size))))
        for i, head in enumerate(heads):
            if head != now:
                if held:
                    yield now, held
                now, held = head, []
            held.append(tuple(batch.column(c)[i] for c in range(size, batch.num_columns)))
    if held:
        yield now, held


def _scores(spec: list[dict], rows: dict[str, tuple]) -> Iterator[tuple]:
    """(key, score) of the chunks of a block that match all items of an alternative and none of its negative ones. rows: term -> (keys, places)."""
    items: dict[tuple, list[tuple[int, str]]] = {}
    for s in spec:
        items.setdefault((s["negative"], s["item"]), []).append((s["place"], s["term"]))
    terms = {t for (negative, _), words in items.items() if not negative for _, t in words}
    if not terms or not terms <= rows.keys():
        return
    at = {t: {k: i for i, k in enumerate(keys)} for t, (keys, _) in rows.items()}
    together = set.intersection(*(set(at[t]) for t in terms))

    def places(term: str, key) -> list[int]:
        return rows[term][1][at[term][key]].as_py() if term in at and key in at[term] else []

    for key in together:
        stands = lambda words: bool(set.intersection(*({p - place for p in places(t, key)} for place, t in words)))  # noqa: E731, B023
        if all(stands(words) != negative for (negative, _), words in items.items()):
            yield key, cover_density([(p, t) for t in terms for p in places(t, key)], len(terms))


@dataclass(frozen=True)
class FullTextIndex:
    """An index in a folder, for keys of a column `key`."""

    spark: SparkSession
    folder: str
    key: str
    key_type: str
    stemmed: bool = True

    @classmethod
    def build(cls, chunks: DataFrame, folder: str, key: str = "chunk_id", text: str = "chunk_text", stemmed: bool = True) -> FullTextIndex:
        index = cls(chunks.sparkSession, folder, key, chunks.schema[key].dataType.simpleString(), stemmed)
        index._write(chunks, text, 0)
        index._gone(chunks.sparkSession.createDataFrame([], f"key {index.key_type}"), 0)
        return index

    def _write(self, chunks: DataFrame, text: str, segment: int) -> None:
        words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))
        rows = in_tasks(chunks.select(self.key, text)).select(self.key, words.alias("words"))
        postings = rows.mapInArrow(_blocks_of(segment, self.stemmed, to_arrow_type(rows.schema[0].dataType)), POSTING.format(key=self.key_type)).withColumn("bucket", _bucket("term"))
        # A term that most chunks have is dealt out by its blocks as well.
        dealt = postings.repartition(F.col("bucket"), F.pmod(F.xxhash64("block"), F.lit(4))).sortWithinPartitions("bucket", "term", "block")
        dealt.write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")

    def _gone(self, keys: DataFrame, before: int) -> None:
        keys.select("key", F.lit(before).cast("long").alias("before")).write.mode("append").parquet(f"{self.folder}/deleted")

    def _next(self) -> int:
        """The number of the next segment."""
        last = self.postings([""]).agg(F.max("block")).first()[0]
        return 0 if last is None else (last >> SEGMENT_BITS) + 1

    def append(self, chunks: DataFrame, text: str = "chunk_text") -> None:
        """Add chunks whose keys aren't there, or were deleted."""
        self._write(chunks, text, self._next())

    def delete(self, keys: DataFrame) -> None:
        """Mask chunks (key); they may be appended again."""
        self._gone(keys.select(F.col(self.key).cast(self.key_type).alias("key")).distinct(), self._next() << SEGMENT_BITS)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{POSTING.format(key=self.key_type)}, bucket int").parquet(f"{self.folder}/postings")
        if terms is None:
            return rows
        return rows.join(self.spark.createDataFrame([(t,) for t in terms], "term string").withColumn("bucket", _bucket("term")), ["bucket", "term"]) if len(terms) > 1 else rows.where((F.col("term") == terms[0]) & (F.col("bucket") == _bucket(F.lit(terms[0]))))

    def blocks(self) -> DataFrame:
        """Rows (key, block) of all chunks."""
        return self.postings([""]).select(F.explode("keys").alias(self.key), "block")

    def candidates(self, asked: DataFrame) -> DataFrame:
        """Rows (query_id, alternative, block, bound): blocks that have all terms of an alternative of fulltext.parsed(), and what a chunk there can score.

        Blocks of an alternative's rarest term are looked up first, the other terms only there. Places aren't read.
        """
        need = kept(asked.where("not negative").select("query_id", "alternative", "term").distinct(), "need")
        words = need.select("term").distinct().withColumn("bucket", _bucket("term"))
        # At most BUCKETS numbers: only their folders are read.
        buckets = [r[0] for r in words.select("bucket").distinct().collect()]
        heads = kept(self.postings().where(F.col("bucket").isin(buckets)).select("bucket", "term", "block", "most").join(words, ["bucket", "term"]).drop("bucket"), "heads")
        known = need.join(heads.groupBy("term").agg(F.count("*").alias("n")), "term", "left")
        rare = known.groupBy("query_id", "alternative").agg(F.min_by("term", F.struct(F.coalesce("n", F.lit(0)), "term")).alias("term"), F.count("*").alias("terms"))
        start = rare.join(heads.select("term", "block"), "term").select("query_id", "alternative", "terms", "block")
        met = start.join(need, ["query_id", "alternative"]).join(heads, ["term", "block"])
        whole = met.groupBy("query_id", "alternative", "block", "terms").agg(F.count("*").alias("n"), F.sum("most").alias("places")).where("n = terms")
        return whole.select("query_id", "alternative", "block", (WEIGHT * (F.col("places") - F.col("terms") + 1)).alias("bound"))

    def scored(self, asked: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows (query_id, key, text_score) of the chunks in blocks (query_id, alternative, block) that match. asked: fulltext.parsed()."""
        kind = asked.schema["query_id"].dataType
        spec = asked.groupBy("query_id", "alternative").agg(F.collect_list(F.struct("item", "negative", "place", "term")).alias("spec"), F.min(F.when(~F.col("negative"), F.col("term"))).alias("least"))
        terms = asked.select("query_id", "alternative", "term").distinct().join(spec, ["query_id", "alternative"])
        # What the alternative asks for goes along once a block.
        terms = terms.select("query_id", "alternative", "term", _bucket("term").alias("bucket"), F.when(F.col("term") == F.col("least"), F.col("spec")).alias("spec"))
        wanted = blocks.select("query_id", "alternative", "block").join(terms, ["query_id", "alternative"])
        # Terms that no query has are left behind before anything is shuffled.
        some = kept(terms.select("bucket", "term").distinct(), "some")
        places = self.postings().select("bucket", "term", "block", "keys", "places").join(some, ["bucket", "term"], "left_semi")
        rows = wanted.join(places, ["bucket", "term", "block"])
        order = ["query_id", "alternative", "block"]
        dealt = rows.select(*order, "term", "spec", "keys", "places").repartition(*order).sortWithinPartitions(*order)
        key = self.key
        kinds = [to_arrow_type(t) for t in (kind, rows.schema["keys"].dataType.elementType)] + [pa.int64(), pa.float64()]

        def run(batches) -> Iterator[pa.RecordBatch]:
            for (query, _, block), held in _groups(batches, 3):
                asked_for = next(r[1].as_py() for r in held if r[1].is_valid)
                found = list(_scores(asked_for, {r[0].as_py(): (r[2].as_py(), r[3].values) for r in held}))
                if found:
                    columns = ([query] * len(found), [k for k, _ in found], [block] * len(found), [s for _, s in found])
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["query_id", key, "block", "text_score"])

        found = dealt.mapInArrow(run, f"query_id {kind.simpleString()}, `{key}` {self.key_type}, block long, text_score double")
        gone = self.spark.read.schema(f"key {self.key_type}, before long").parquet(f"{self.folder}/deleted")
        live = found.join(gone, (found[key] == gone.key) & (found.block < gone.before), "left_anti")
        return live.groupBy("query_id", key).agg(F.max("text_score").alias("text_score"))

    def matches(self, asked: DataFrame) -> DataFrame:
        """Rows (query_id, key, text_score) of all chunks that match. asked: fulltext.parsed()."""
        asked = kept(asked, "asked")
        return self.scored(asked, self.candidates(asked))
