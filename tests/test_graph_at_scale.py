"""Similar names by rising bounds and components by contraction, against plain Python."""

import random
import re
import time

from pyspark.sql import functions as F

from folioflow.operators import components as C
from folioflow.operators import graph as G
from folioflow.operators.similar_sets import candidates
from folioflow.plans import registry


def grams(text):
    return {p[i : i + 3] for w in re.findall(r"[^\W_]+", (text or "").lower()) for p in [f"  {w} "] for i in range(len(p) - 2)}


def similarity(a, b):
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def words(rng, n):
    syllables = ["ka", "to", "mi", "ren", "sol", "var", "dun", "pel", "qui", "zor", "ab"]
    return " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4))) for _ in range(n))


def test_best_names_equal_all_pairs(spark):
    rng = random.Random(1)
    names = [(i, words(rng, rng.randrange(1, 5))) for i in range(800)] + [(900 + i, "kato " + words(rng, 1)) for i in range(200)] + [(2000, None), (2001, ""), (2002, "..."), (2003, "kato"), (2004, "kato")]
    queries = [(i, rng.choice(names)[1] if i % 2 else words(rng, 2)) for i in range(40)] + [(50, ""), (51, None), (52, "kato"), (53, "zzzz")]
    report = {}
    df, asked = spark.createDataFrame(names, "entity_key long, name string"), spark.createDataFrame(queries, "query_id int, query string")
    found = sorted((r["query_id"], r["entity_key"], round(r["score"], 9), r["rank"]) for r in G.similar_names(df, asked, 5, report=report).collect())
    want = []
    for q, text in queries:
        rows = [(-1.0 if text and n and text.lower() in n.lower() else -similarity(text, n), i) for i, n in names]
        want += [(q, i, round(-s, 9), r + 1) for r, (s, i) in enumerate(sorted(r for r in rows if r[0] < -G.LEAST_SIMILARITY)[:5])]
    assert found == sorted(want)
    assert report["first"] + report["further"] < 0.5 * report["all"]
    assert G.similar_names(df.limit(0), asked, 5).collect() == [] == G.similar_names(df, asked.limit(0), 5).collect()


def test_few_pairs_are_built_over_all_names(spark, medium):
    names = spark.read.parquet(f"{medium}/documents.parquet").select(F.col("doc_id").alias("entity_key"), F.substring("text", 1, 60).alias("value"))
    queries = names.where("entity_key % 50 = 0").select(F.col("entity_key").alias("query_id"), F.col("value").alias("query"))
    report = {}
    found = candidates(names, queries, 5, G.LEAST_SIMILARITY, "entity_key", report=report)
    assert found.groupBy("query_id").count().count() == queries.count()
    assert report["first"] + report["further"] < 0.4 * report["all"], report


def test_relationships_equal_all_pairs(spark):
    rng = random.Random(6)
    kinds = ["RELATED_TO", "PART_OF", "NEXT_TO", "KATOMI"]
    links = [(i, i % 9, rng.choice(kinds), rng.choice([words(rng, 3), None, ""]), words(rng, 1), words(rng, 1)) for i in range(300)]
    queries = [(i, words(rng, 2)) for i in range(20)] + [(30, "part of"), (31, "katomi"), (32, "to"), (33, links[5][4])]
    df = spark.createDataFrame(links, "relationship_id long, resource_id long, relationship_type string, description string, source_name string, target_name string")
    asked = spark.createDataFrame(queries, "query_id int, query string")
    found = sorted((r["query_id"], r["relationship_id"], round(r["score"], 6), r["rank"]) for r in G.relationship_top(df, asked, 4).collect())
    want = []
    for q, text in queries:
        rows, low = [], text.lower()
        for i, _, kind, about, a, b in links:
            about = about or ""
            if similarity(about, text) > G.LEAST_SIMILARITY or any(low in x.lower() for x in (about, kind, a, b)):
                rows.append((-max(similarity(about, text), similarity(kind, text.upper()), 1.0 * (low in about.lower()), 0.8 * (low in a.lower()), 0.8 * (low in b.lower())), i))
        want += [(q, i, round(-s, 6), r + 1) for r, (s, i) in enumerate(sorted(rows)[:4])]
    assert found == sorted(want)


def plain_components(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for g, u, v in edges:
        if u is not None and v is not None and u != v:
            a, b = root((g, u)), root((g, v))
            parent[max(a, b, key=lambda n: n[1])] = min(a, b, key=lambda n: n[1])
    return sorted(((g, n, root((g, n))[1]) for g, n in parent), key=repr)


def test_components_equal_plain_whatever_a_task_holds(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.choice([1, 2, None]), f"n{rng.randrange(160):03}", f"n{rng.randrange(160):03}") for _ in range(170)] + [(3, f"p{i:03}", f"p{i + 1:03}") for i in range(60)] + [(4, "x", "x"), (4, None, "x"), (1, "n001", "n002")] * 2
    df = spark.createDataFrame(edges, "resource_id long, u string, v string").repartition(5)
    for held in (C.HELD, 7):
        monkeypatch.setattr(C, "HELD", held)
        assert sorted(((r["resource_id"], r["node"], r["root"]) for r in C.components(df, ["resource_id"]).collect()), key=repr) == plain_components(edges)
    assert C.components(df.limit(0), ["resource_id"]).collect() == []


def test_a_path_of_ten_thousand_names(spark):
    names = [f"{i:05}" for i in range(10_001)]
    random.Random(4).shuffle(names)
    df = spark.createDataFrame([(1, a, b) for a, b in zip(names, names[1:])], "resource_id long, source_key string, target_key string")
    start = time.perf_counter()
    rows = G.communities(df).groupBy("community").count().collect()
    assert [(r["community"], r["count"]) for r in rows] == [("00000", 10_001)]
    assert time.perf_counter() - start < 30


def test_summaries_take_the_first_names(spark, small):
    labels = spark.createDataFrame([(1, f"k{i}", "k0") for i in range(30)], "resource_id long, entity_key string, community string")
    nodes = spark.createDataFrame([(1, f"k{i}", f"Name {29 - i:02}") for i in range(30)], "resource_id long, entity_key string, name string")
    row = G.community_summaries(labels, nodes).first()
    assert (row["entity_count"], row["name"]) == (30, "Name 00, Name 01, Name 02") and "Name 07." in row["summary"]
    assert registry.QUERIES["graph_communities"](spark, small).columns == ["resource_id", "entity_key", "community"]


def test_equal_texts_are_compared_once(spark, monkeypatch):
    links = spark.range(600).selectExpr("id as relationship_id", "id % 7 as resource_id", "upper(concat('KIND ', id % 2)) as relationship_type", "case when id % 3 = 0 then null else 'old plate' end as description", "'hot bolt' as source_name", "concat('Brand#', id % 2) as target_name")
    summaries = links.selectExpr("relationship_id as summary_id", "resource_id", "concat('blue ring ', relationship_id % 2) as summary_text")
    nodes = links.selectExpr("relationship_id as entity_key", "concat('large bolt ', relationship_id % 2) as name")
    queries = spark.range(90).selectExpr("id as query_id", "case id % 4 when 0 then 'bolt' when 1 then 'old plates' when 2 then 'ring' end as query")
    sizes = []

    def counted(values, asked, *args, **more):
        sizes.append((values.count(), asked.count()))
        return candidates(values, asked, *args, **more)

    monkeypatch.setattr(G, "candidates", counted)
    found = {}
    for kind, rows in (("relationship_id", G.relationship_top(links, queries, 5)), ("summary_id", G.summary_top(summaries, queries, 5)), ("entity_key", G.similar_names(nodes, queries, 5))):
        for r in rows.collect():
            found.setdefault((kind, r["query_id"]), []).append((r["rank"], r[kind]))
    assert max(values for values, _ in sizes) <= 20 and max(asked for _, asked in sizes) <= 3
    held = lambda kind, query: [key for _, key in sorted(found.get((kind, query), []))]
    for query in range(0, 90, 4):
        assert held("relationship_id", query) == [0, 1, 2, 3, 4] == held("entity_key", query)
        assert held("summary_id", query + 2) == [0, 1, 2, 3, 4] if query + 2 < 90 else True
        assert held("relationship_id", query + 1) == [1, 2, 4, 5, 7] if query + 1 < 90 else True
        assert not any(q == query + 3 for _, q in found)
