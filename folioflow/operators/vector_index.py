"""A stored index of vectors by cells: fitted on a bounded sample, holding every row, probed by the cells nearest to a query.

Three tables in a folder: `centres` (cell, centre), at most MOST_CELLS of them, `probes` (how many cells a query must look into for TARGET of its
neighbours, measured on the sample), and `rows` (key, vector), partitioned by cell. A row stands in the
cell of its nearest centre, so rows that are added later go to the same cells and move none that are there. A search reads
only the folders of cells that some query probes and scores their rows exactly; with probes=None it reads all of them and gives what
a scan of all vectors gives.

Cases: rows with a null vector aren't indexed; vectors of other lengths than the sample's first are an error; of a table without vectors the index is
empty and finds nothing; a repeated key is a row of its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioflow.sources.scratch import shared_folder

#: Vectors that cells are fitted on, rounds of fitting, most cells; cells are about the square root of the rows.
SAMPLE, ROUNDS, MOST_CELLS = 16_384, 12, 4096
#: Share of the nearest NEIGHBOURS that the probed cells are to hold, by CALIBRATED vectors of the sample against all of it.
TARGET, NEIGHBOURS, CALIBRATED = 0.96, 10, 512
#: Numbers of query vectors that are broadcast at once.
BLOCK_VALUES = 1 << 22
#: Scores that a task holds at once, whatever the numbers of rows and queries.
SCORES = 1 << 20


def unit(rows: np.ndarray) -> np.ndarray:
    return rows / np.maximum(np.linalg.norm(rows, axis=-1, keepdims=True), 1e-300)


def matrix(values: pa.ListArray) -> np.ndarray:
    """The vectors of a column without nulls, all of one length."""
    return np.asarray(values.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(values), -1)


def best_of_batch(scores: np.ndarray, keys: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, query) of each query's k best rows of a batch, ties by the lesser key: never more than k a query, whatever is equal."""
    if len(keys) <= k:
        return np.nonzero(np.ones_like(scores, bool))
    place = np.empty(len(keys), np.int64)
    place[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
    least = np.partition(scores, len(keys) - k, axis=0)[len(keys) - k]
    sure = scores > least
    missing = k - sure.sum(0)
    row, query = np.nonzero(scores == least)
    order = np.lexsort((place[row], query))
    row, query = row[order], query[order]
    some = np.arange(len(query)) - np.searchsorted(query, query) < missing[query]
    sure_row, sure_query = np.nonzero(sure)
    return np.r_[sure_row, row[some]], np.r_[sure_query, query[some]]


def best_of_blocks(rows: np.ndarray, asked: np.ndarray, keys: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, score) of each query's k best rows of a batch, for as many queries at once as SCORES allows."""
    size = max(1, SCORES // max(1, len(rows)))
    for start in range(0, len(asked), size):
        scores = rows @ asked[start : start + size].T
        row, query = best_of_batch(scores, keys, k)
        yield query + start, row, scores[row, query]


def fitted(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Unit centres of spherical k-means on a sample; a cell that becomes empty takes the vector farthest from its own centre."""
    rows = unit(sample)
    centres = rows[np.random.default_rng(seed).permutation(len(rows))[:cells]]
    for _ in range(ROUNDS):
        scores = rows @ centres.T
        near, close = scores.argmax(1), scores.max(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        empty = np.flatnonzero(np.bincount(near, minlength=len(centres)) == 0)
        sums[empty] = rows[np.argsort(close, kind="stable")[: len(empty)]]
        centres = unit(sums)
    return centres


def calibrated(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest cells that hold TARGET of the sample vectors' neighbours in the sample, beside themselves."""
    rows = unit(sample)
    asked = rows[:: max(1, len(rows) // CALIBRATED)]
    cell = (rows @ centres.T).argmax(1)
    order = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    scores = asked @ rows.T
    n = min(NEIGHBOURS + 1, len(rows))
    near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
    # The place of each neighbour's cell among its query's; a vector's own place is its first and counts as found.
    places = np.sort(np.take_along_axis(order, cell[near], axis=1).ravel())
    own = len(asked)
    return int(places[min(len(places) - 1, own + int(np.ceil(TARGET * (len(places) - own))) - 1)]) + 1 if len(places) > own else 1


@dataclass(frozen=True)
class VectorIndex:
    """An index in a folder, for keys of a column `key`."""

    spark: SparkSession
    folder: str
    key: str
    key_type: str

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, key: str = "chunk_id", vector: str = "vector", cells: int | None = None, sample: int = SAMPLE) -> VectorIndex:
        """Fit cells on `sample` vectors, those of the least key hashes, and store every vector in its cell."""
        spark, kind = vectors.sparkSession, vectors.schema[key].dataType.simpleString()
        index = cls(spark, folder, key, kind)
        there = vectors.where(F.col(vector).isNotNull())
        rows = there.count()
        # A few rows more than asked for by a share of all, the least hashes of these: no sort of the table. Repeated keys share a hash, so values are hashed too.
        share = min(1.0, 2 * sample / max(rows, 1) + 1e-4)
        some = there.where(F.pmod(F.xxhash64(key, vector), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select(vector).orderBy(F.xxhash64(key, vector)).limit(sample).toArrow()
        values = matrix(some.column(0).combine_chunks()) if some.num_rows else np.zeros((0, 1))
        centres = fitted(values, min(cells or max(1, round(rows**0.5)), MOST_CELLS, len(values))) if len(values) else values
        spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").coalesce(1).write.parquet(f"{folder}/centres")
        spark.createDataFrame([(calibrated(values, centres) if len(values) else 1,)], "probes int").coalesce(1).write.parquet(f"{folder}/probes")
        index.append(there, vector)
        return index

    def centres(self) -> np.ndarray:
        found = self.spark.read.parquet(f"{self.folder}/centres").orderBy("cell").toArrow()
        return matrix(found.column("centre").combine_chunks()) if found.num_rows else np.zeros((0, 1))

    def append(self, vectors: DataFrame, vector: str = "vector") -> None:
        """Store more vectors in the cells that there are."""
        centres, key = self.centres(), self.key

        def place(batches) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = (unit(matrix(batch.column(1))) @ centres.T).argmax(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32())], [key, "vector", "cell"])

        rows = vectors.where(F.col(vector).isNotNull()).select(self.key, F.col(vector).cast("array<double>").alias("vector"))
        placed = rows.mapInArrow(place, f"`{self.key}` {self.key_type}, vector array<double>, cell int")
        # A cell's rows are dealt out over several tasks and files by their keys, so that a cell with most rows isn't one task's.
        parts = F.pmod(F.xxhash64(self.key), F.lit(8))
        placed.repartition(F.col("cell"), parts).write.mode("append").partitionBy("cell").parquet(f"{self.folder}/rows")

    def rows(self) -> DataFrame:
        """Rows (key, vector, cell)."""
        return self.spark.read.schema(f"`{self.key}` {self.key_type}, vector array<double>, cell int").parquet(f"{self.folder}/rows")

    def probes(self) -> int:
        """Cells to probe for TARGET of the neighbours; vectors without clusters need most of the cells."""
        return self.spark.read.parquet(f"{self.folder}/probes").first()[0]

    def top(self, queries: DataFrame, k: int, probes: int | None = None) -> DataFrame:
        """Rows (query_id, key, vector_score, vector_rank): of each query (query_id, vector) the k best of the nearest `probes` cells, all cells if None.

        Queries are taken in blocks of BLOCK_VALUES numbers, whose candidates are written before the next block's. No vector is
        shuffled: a task scores its files' rows against the queries that probe their cell and hands on k a query at most.
        """
        centres, key = self.centres(), self.key
        kind = queries.schema["query_id"].dataType.simpleString()
        schema = f"query_id {kind}, `{self.key}` {self.key_type}, vector_score double"
        if not len(centres):
            return self.spark.createDataFrame([], f"{schema}, vector_rank int")
        path = f"{shared_folder(self.spark)}/probed-{uuid.uuid4().hex}"
        total = queries.agg(F.sum(F.size("vector"))).first()[0] or 0
        count = max(1, -(-total // BLOCK_VALUES))
        for b in range(count):
            block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(count)) == b).select("query_id", "vector").toArrow()
            asked = unit(matrix(block.column(1).combine_chunks())) if block.num_rows else np.zeros((0, centres.shape[1]))
            n = len(centres) if probes is None else min(probes, len(centres))
            nearest = np.argpartition(-(asked @ centres.T), n - 1, axis=1)[:, :n] if len(asked) else np.zeros((0, n), np.int64)
            by_cell = {c: np.flatnonzero((nearest == c).any(1)) for c in np.unique(nearest).tolist()} if n < len(centres) else dict.fromkeys(range(len(centres)), np.arange(len(asked)))
            sent = self.spark.sparkContext.broadcast((block.column(0).combine_chunks(), asked, by_cell))

            def run(batches, sent=sent) -> Iterator[pa.RecordBatch]:
                ids, asked, by_cell = sent.value
                for batch in batches:
                    cells = batch.column(2).to_numpy()
                    for cell in np.unique(cells).tolist():
                        some = by_cell.get(cell)
                        if some is None or not len(some):
                            continue
                        part = batch.filter(pa.array(cells == cell))
                        for query, row, score in best_of_blocks(unit(matrix(part.column(1))), asked[some], part.column(0), k):
                            yield pa.RecordBatch.from_arrays([ids.take(pa.array(some[query])), part.column(0).take(pa.array(row)), pa.array(score)], ["query_id", key, "vector_score"])

            # The list has at most MOST_CELLS cells; only their folders are read.
            read = self.rows() if probes is None else self.rows().where(F.col("cell").isin(list(by_cell)))
            read.select(self.key, "vector", "cell").mapInArrow(run, schema).write.mode("append").parquet(path)
            sent.destroy()
        best = Window.partitionBy("query_id").orderBy(F.desc("vector_score"), self.key)
        return self.spark.read.schema(schema).parquet(path).withColumn("vector_rank", F.row_number().over(best)).where(F.col("vector_rank") <= k)
