"""The vector index: recall, exactness over all cells, appended rows, ties, nulls, empty tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import search as S
from folioflow.operators import vector_index as V
from folioflow.plans import registry


def rows(df):
    return sorted((r["query_id"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())


def test_recall_over_all_rows(spark, medium):
    exact, found = rows(registry.QUERIES["vector_search"](spark, medium)), rows(registry.QUERIES["vector_search_indexed"](spark, medium))
    assert len(set(exact) & set(found)) >= 0.9 * len(exact)


def test_few_cells_are_read(spark, medium, tmp_path):
    vectors = spark.read.parquet(f"{medium}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    index = V.VectorIndex.build(vectors, str(tmp_path / "v"))
    plan = index.rows().where(F.col("cell").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "cell" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert index.rows().count() == vectors.count() and len(index.centres()) == round(vectors.count() ** 0.5)


def test_appending_moves_no_row(spark, tmp_path):
    rng = np.random.default_rng(0)
    some = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    df = spark.createDataFrame(some, "chunk_id long, vector array<double>")
    index = V.VectorIndex.build(df.where("chunk_id < 200"), str(tmp_path / "v"), cells=12)
    before = {r["chunk_id"]: r["cell"] for r in index.rows().collect()}
    index.append(df.where("chunk_id >= 200"))
    after = {r["chunk_id"]: r["cell"] for r in index.rows().collect()}
    assert len(after) == 400 and all(after[k] == c for k, c in before.items())
    queries = df.where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")
    want = [(r[0], r[1], r[3]) for r in S.vector_top(df, queries, 5).collect()]
    assert sorted((r[0], r[1], r[3]) for r in index.top(queries, 5).collect()) == sorted(want)


@pytest.mark.parametrize("block", [V.BLOCK_VALUES, 64])
def test_equal_vectors_nulls_and_blocks(spark, tmp_path, monkeypatch, block):
    """Most rows equal: ties by key, k rows a batch at most; several blocks of queries."""
    monkeypatch.setattr(V, "BLOCK_VALUES", block)
    monkeypatch.setattr(S, "BLOCK_VALUES", block)
    given = [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(3000)] + [(3000 + i, [0.0, 1.0, float(i), 0.0]) for i in range(50)] + [(9000, None), (9001, [0.0] * 4)]
    df = spark.createDataFrame(given, "chunk_id long, vector array<double>").repartition(3)
    queries = df.where("chunk_id % 100 = 1 and vector is not null").select(F.col("chunk_id").alias("query_id"), "vector")
    index = V.VectorIndex.build(df, str(tmp_path / "v"))
    got = sorted((r[0], r[1], r[3]) for r in index.top(queries, 4).collect())
    assert got == sorted((r[0], r[1], r[3]) for r in S.vector_top(df, queries, 4).collect())
    assert [g[1] for g in got if g[0] == 101] == [0, 1, 2, 3]
    nothing = V.VectorIndex.build(df.limit(0), str(tmp_path / "none"))
    assert nothing.top(queries, 4).collect() == [] and index.top(queries.limit(0), 4).collect() == []


def test_best_of_batch_equals_sorting():
    import pyarrow as pa

    rng = np.random.default_rng(2)
    for n, k in ((1, 3), (30, 4), (200, 10)):
        scores, keys = rng.integers(0, 4, (n, 5)).astype(float), rng.permutation(n)
        row, query = V.best_of_batch(scores, pa.array(keys), k)
        for q in range(5):
            want = sorted(range(n), key=lambda i: (-scores[i, q], keys[i]))[:k]
            assert sorted(row[query == q].tolist()) == sorted(want)


def test_scores_held_at_once_are_bounded(monkeypatch):
    rng = np.random.default_rng(3)
    rows, asked, keys = rng.normal(size=(500, 4)), rng.normal(size=(70, 4)), pa.array(rng.permutation(500))
    rows[100:140] = rows[0]
    sizes, plain = [], V.best_of_batch
    whole = rows @ asked.T
    monkeypatch.setattr(V, "SCORES", 4_000)
    monkeypatch.setattr(V, "best_of_batch", lambda scores, keys, k: sizes.append(scores.size) or plain(scores, keys, k))
    found = {(int(q), int(r)): s for query, row, score in V.best_of_blocks(rows, asked, keys, 5) for q, r, s in zip(query, row, score)}
    row, query = plain(whole, keys, 5)
    assert max(sizes) <= 4_000 and len(sizes) == 9
    assert found == pytest.approx({(int(q), int(r)): whole[r, q] for r, q in zip(row, query)})
