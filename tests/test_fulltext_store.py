"""The stored full-text index: postings, pruned search and keyword search against plain Python; segments and deletions."""

import os
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.functions.stem import stem
from folioflow.operators import fulltext as X
from folioflow.operators import fulltext_store
from folioflow.operators import search as S
from folioflow.operators.fulltext_store import FullTextIndex
from folioflow.plans import registry
from folioflow.sources import scratch

STOP = set(X.STOP)


def terms_of(text):
    """term -> places, stop words left out."""
    out = {}
    for at, word in enumerate(re.findall(r"[^\W_]+", text.lower())):
        if word not in STOP:
            out.setdefault(stem(word), []).append(at)
    return out


def density(places, n):
    """Covers by trying every stretch: smallest ones hold all terms, and no smaller one inside does."""
    found = sorted((p, t) for t, ps in places.items() for p in ps)
    covers = []
    for i in range(len(found)):
        seen = set()
        for j in range(i, len(found)):
            seen.add(found[j][1])
            if len(seen) == n:
                covers.append((i, j))
                break
    smallest = [c for c in covers if not any(o != c and c[0] <= o[0] and o[1] <= c[1] for o in covers)]
    return sum(X.WEIGHT / (1 + found[j][0] - found[i][0] - (j - i)) for i, j in smallest)


def phrase_score(index, words):
    """Score of a chunk for words that must stand side by side, stop words counted as places."""
    asked = [(i, stem(w)) for i, w in enumerate(words) if w not in STOP]
    if not asked or any(t not in index for _, t in asked):
        return None
    if not set.intersection(*({p - i for p in index[t]} for i, t in asked)):
        return None
    terms = {t for _, t in asked}
    return density({t: index[t] for t in terms}, len(terms))


def words_score(index, words):
    asked = {stem(w) for w in words if w not in STOP}
    return None if not asked or not asked <= index.keys() else density({t: index[t] for t in asked}, len(asked))


def keyword_plain(chunks, queries, k):
    """keyword_top() of chunks {id: (text, title, category)} and queries {id: (words, exact)}."""
    texts = {c: terms_of(v[0]) for c, v in chunks.items()}
    out = {}
    for q, (query, exact) in queries.items():
        words, phrase, rows = re.findall(r"[^\W_]+", query.lower()), query.lower(), []
        for c, (text, title, category) in chunks.items():
            score = (phrase_score if exact else words_score)(texts[c], words)
            in_title, in_category = phrase in title.lower(), phrase in category.lower()
            if score is None and not in_title and not in_category:
                continue
            same = phrase == title.lower()
            total = (score or 0) + 10 * same + (phrase in text.lower()) + 5 * in_title + 2 * in_category
            match = 2.0 if same else 1.0 if in_title else 0.0
            rows.append((-match, 0, -round(total, 9), c))
        out[q] = [(r[3], -r[2]) for r in sorted(rows)[:k]]
    return out


def given(seed=1, n=900):
    """Chunks in which few words recur often, in very different numbers."""
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("run", "wolf", "stone", "river", "light") for b in ("", "s", "er", "fall")] + ["the", "of"]
    chunks = {}
    for i in range(n):
        length = rng.choice([0, 3, 10, 40]) if i % 90 else 600
        chunks[i] = (" ".join(rng.choice(words) for _ in range(length)), f"Title {i}" if i % 7 else "Stone River", rng.choice(["Wolf", "Other"]))
    queries = {0: ("stone river", False), 1: ("wolf", False), 2: ("river of light", True), 3: ("runs stonefall", False), 4: ("wolf of the river", True), 5: ("nothing here", False), 6: ("the", False), 7: ("title 5", False)}
    return chunks, queries


def frames(spark, chunks, queries):
    c = spark.createDataFrame([(i, *v, 0) for i, v in chunks.items()], "chunk_id long, chunk_text string, title string, category string, chunk_index int").repartition(4)
    q = spark.createDataFrame([(i, t, "exact_quote" if e else "title_lookup") for i, (t, e) in queries.items()], "query_id int, normalised string, intent string")
    return c, q


def got(df):
    out = {}
    for r in df.orderBy("query_id", "keyword_rank").collect():
        out.setdefault(r["query_id"], []).append((r["chunk_id"], pytest.approx(r["keyword_score"], abs=1e-6)))
    return out


def test_pruned_search_equals_plain(spark, tmp_path, monkeypatch):
    from folioflow.operators import fulltext_store

    monkeypatch.setattr(fulltext_store, "BLOCK", 8)
    monkeypatch.setattr(S, "FIRST_BLOCKS", 4)
    chunks, queries = given()
    c, q = frames(spark, chunks, queries)
    index, report = FullTextIndex.build(c, str(tmp_path / "x")), {}
    found = got(S.keyword_top(c, q, 3, index=index, report=report))
    want = {k: v for k, v in keyword_plain(chunks, queries, 3).items() if v}
    assert found == want
    # Blocks whose bound doesn't reach the k-th score aren't read.
    assert report["first"] + report["rest"] < 0.8 * report["blocks"]


def test_segments_and_deletions(spark, tmp_path):
    chunks, queries = given(2, 300)
    c, q = frames(spark, chunks, queries)
    index = FullTextIndex.build(c.where("chunk_id < 100"), str(tmp_path / "x"))
    index.append(c.where("chunk_id >= 100"))
    index.delete(c.where("chunk_id % 3 = 0").select("chunk_id"))
    index.append(c.where("chunk_id % 9 = 0"))
    left = {i: v for i, v in chunks.items() if i % 3 or i % 9 == 0}
    asked = X.parsed(q.select("query_id", F.col("normalised").alias("query"), (F.col("intent") == "exact_quote").alias("exact")), "exact")
    rows = {(r["query_id"], r["chunk_id"]): r["text_score"] for r in index.matches(asked).collect()}
    want = {(n, i): s for n, (t, exact) in queries.items() for i, v in left.items() if (s := (phrase_score if exact else words_score)(terms_of(v[0]), re.findall(r"[^\W_]+", t.lower()))) is not None}
    assert rows.keys() == want.keys() and all(rows[p] == pytest.approx(s) for p, s in want.items())


def test_alternatives_and_exclusions_equal_the_scan(spark, tmp_path):
    chunks, _ = given(3, 200)
    c, _ = frames(spark, chunks, {0: ("x", False)})
    c = c.unionByName(spark.createDataFrame([(999, None, "t", "c", 0)], c.schema))
    asked = X.parsed(spark.createDataFrame([(1, "stone or wolf river"), (2, 'light -"stone river"'), (3, "-stone"), (4, '"run wolf" or "wolf run" -light'), (5, "")], "query_id int, query string"))
    rows = lambda df: sorted((r["query_id"], r["chunk_id"], round(r["text_score"], 9)) for r in df.collect())
    assert rows(FullTextIndex.build(c, str(tmp_path / "x")).matches(asked)) == rows(X.search(X.index(c), asked)) != []
    assert FullTextIndex.build(c.limit(0), str(tmp_path / "none")).matches(asked).collect() == []


def test_keyword_search_equals_plain(spark, small):
    """The query over all documents and passages."""
    docs = {i: (t, f"document {i}", s) for i, t, s in duckdb.sql(f"select doc_id, text, source from '{small}/documents.parquet'").fetchall()}
    asked = S.understood(spark.read.parquet(f"{small}/benchmark.parquet").selectExpr("item_id as query_id", "text as query")).collect()
    want = keyword_plain(docs, {r["query_id"]: (r["normalised"], r["intent"] == "exact_quote") for r in asked}, 10)
    found = registry.QUERIES["keyword_search"](spark, small)
    assert got(found) == {q: [(c, round(s, 6)) for c, s in v] for q, v in want.items() if v}
    again = {(r["query_id"], r["chunk_id"]) for r in registry.QUERIES["fulltext_search"](spark, small).collect()}
    assert again == {(r["query_id"], d) for r in asked for d, v in docs.items() if phrase_score(terms_of(v[0]), re.findall(r"[^\W_]+", r["query"].lower())) is not None}


def test_tasks_grow_in_number_with_the_files(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet").select("doc_id", "text")
    size = sum(os.path.getsize(f.removeprefix("file://")) for f in docs.inputFiles())
    many = scratch.dealt(docs, size // 20)
    assert many.rdd.getNumPartitions() >= 20 and many.count() == docs.count()
    assert max(r["count"] for r in many.groupBy(F.spark_partition_id().alias("at")).count().collect()) < 0.1 * docs.count()
    assert scratch.dealt(docs).rdd.getNumPartitions() == docs.rdd.getNumPartitions()
    made = spark.range(5)
    assert scratch.dealt(made).rdd.getNumPartitions() == made.rdd.getNumPartitions()


def test_a_block_of_postings():
    """A block's postings equal plain Python; words are told apart once."""
    words = [["b", "a", "b"], None, [], ["the", "c", "a"]]
    batch = pa.RecordBatch.from_arrays([pa.array([7, None, 9, 8]), pa.array(words, pa.list_(pa.string()))], ["k", "words"])
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))]
    rows = fulltext_store._block(5, batch.column(0), batch.column(1), dict.fromkeys(["the"]), False, kinds).to_pylist()
    assert rows == [
        {"term": "", "block": 5, "most": 0, "keys": [7, None, 9, 8], "places": []},
        {"term": "a", "block": 5, "most": 1, "keys": [7, 8], "places": [[1], [2]]},
        {"term": "b", "block": 5, "most": 2, "keys": [7], "places": [[0, 2]]},
        {"term": "c", "block": 5, "most": 1, "keys": [8], "places": [[1]]},
    ]
