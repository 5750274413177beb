import re

import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import search as S


def asked(spark, *queries):
    return {r.query: r for r in S.understood(spark.createDataFrame([(q,) for q in queries], "query string")).collect()}


def test_understanding(spark):
    found = asked(spark, "Tell me about  the novel: A Christams Carol", 'find "the best of times it was"', "Who is Marley?", "bhagawad geetha", "please summarize everything about long and winding rivers", "quiet rivers mountains valleys forests oceans deserts")
    first = found["Tell me about  the novel: A Christams Carol"]
    assert (first.normalised, first.intent, first.spelling_normalised) == ("A Christmas Carol", "summary_request", True)
    assert found['find "the best of times it was"'].normalised == "the best of times it was"
    assert found['find "the best of times it was"'].intent == "exact_quote"
    assert found["Who is Marley?"].intent == "factual_question"
    assert (found["bhagawad geetha"].normalised, found["bhagawad geetha"].intent) == ("bhagavad gita", "title_lookup")
    assert found["quiet rivers mountains valleys forests oceans deserts"].intent == "broad_document_query"


def test_words_end_at_letters_of_other_scripts_as_in_sql(spark):
    found = asked(spark, "Osrr rañmente mimente mentetall nisa wera ñdo con", "Iequega doñes laasboadota Larrieque ciónraezque venisa nadela", "osrr dona mimente mentetall nisa wera condo")
    assert [r.intent for r in found.values()] == ["factual_question", "factual_question", "broad_document_query"]


def test_oversampling():
    assert S.retrieval_k(10, 5) == 50 and S.retrieval_k(50, 5) == 250 and S.retrieval_k(10, hybrid=False) == 10
    with pytest.raises(ValueError):
        S.retrieval_k(51)


def lists(spark):
    v = spark.createDataFrame([(1, "v", 0.9, 1), (1, "both", 0.8, 2)], "query_id int, chunk_id string, vector_score double, vector_rank int")
    k = spark.createDataFrame([(1, "both", 3.0, 0.0, 1), (1, "k", 2.0, 2.0, 2)], "query_id int, chunk_id string, keyword_score double, resource_match_score double, keyword_rank int")
    return v, k


def test_rank_fusion_rewards_both(spark):
    scores = {r.chunk_id: r.score for r in S.fused_by_rank(*lists(spark)).collect()}
    assert scores["both"] == pytest.approx(0.7 / 62 + 0.3 / 61) and scores["both"] > scores["v"] > scores["k"]


def test_score_fusion(spark):
    scores = {r.chunk_id: r.score for r in S.fused_by_score(*lists(spark)).collect()}
    assert scores == pytest.approx({"v": 0.7, "both": 0.3, "k": 0.2})


def test_vector_top_matches_brute_force(spark, small):
    vectors = spark.read.parquet(f"{small}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    queries = vectors.where("chunk_id < 3").select(F.col("chunk_id").alias("query_id"), "vector")
    found = {(r.query_id, r.vector_rank): r.chunk_id for r in S.vector_top(vectors, queries, 4).collect()}
    import numpy as np

    rows = sorted((r.chunk_id, r.vector) for r in vectors.collect())
    m = np.array([v for _, v in rows], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(3):
        assert [found[q, i + 1] for i in range(4)] == np.argsort(-(m @ m[q]), kind="stable")[:4].tolist()


def test_vector_top_of_nothing(spark):
    none = spark.createDataFrame([], "query_id long, vector array<double>")
    chunks = spark.createDataFrame([(1, [1.0, 0.0])], "chunk_id long, vector array<double>")
    assert S.vector_top(chunks, none, 3).count() == 0


def chunk_rows(spark, *rows):
    return spark.createDataFrame(list(rows), "chunk_id string, chunk_text string, title string, category string, chunk_index int")


def test_keyword_top(spark):
    chunks = chunk_rows(spark, ("a", "golden rivers and silver lakes", "Rivers", "nature", 0), ("b", "golden lakes", "Lakes", "nature", 1), ("c", "nothing", "golden rivers", "x", 2))
    queries = S.understood(spark.createDataFrame([(1, "golden rivers")], "query_id int, query string"))
    rows = S.keyword_top(chunks, queries, 5).orderBy("keyword_rank").collect()
    assert [(r.chunk_id, r.resource_match_score) for r in rows] == [("c", 2.0), ("a", 0.0)]
    assert rows[0].keyword_score == pytest.approx(15.0) and rows[1].keyword_score == pytest.approx(1.1)


def decide(spark, text, **more):
    values = {"chunk_id": 1, "chunk_text": text, "resource_match_score": 0.0, "chunk_searchable": None, "chunk_quality": None} | more
    df = spark.createDataFrame([tuple(values.values())], "chunk_id int, chunk_text string, resource_match_score double, chunk_searchable boolean, chunk_quality string")
    r = S.decided(df).first()
    return r.keep, r.reason


def test_quality_decisions(spark):
    good = "many plain words about several different places"
    assert decide(spark, good) == (True, "searchable_text")
    assert decide(spark, good, chunk_searchable=False) == (False, "chunk_metadata_not_searchable")
    assert decide(spark, "Printed at the old press by the publisher") == (False, "short_boilerplate_text")
    assert decide(spark, "few words", resource_match_score=1.0) == (True, "resource_metadata_match")
    assert decide(spark, "few words") == (False, "low_value_result_text")
    assert decide(spark, None) == (False, "low_value_result_text")


def rerank(spark, query, intent, text, **more):
    values = {"query_id": 1, "query": query, "intent": intent, "chunk_id": "a", "chunk_text": text, "title": "", "chunk_index": 3, "score": 0.0, "resource_match_score": 0.0} | more
    df = spark.createDataFrame([tuple(values.values())], "query_id int, query string, intent string, chunk_id string, chunk_text string, title string, chunk_index int, score double, resource_match_score double")
    return S.reranked(df, 5).first().rerank_score


def test_rerank_scores(spark):
    # The phrase, full coverage, nothing missing.
    assert rerank(spark, "golden rivers", "title_lookup", "the golden rivers") == pytest.approx(3.0 + 2.5 + 0.75)
    # A matching title: its coverage, the resource's match, an early chunk.
    assert rerank(spark, "golden rivers", "title_lookup", "x", title="Golden Rivers", resource_match_score=2.0) == pytest.approx(1.2 + 0.70 + 0.40)
    # An exact quote that isn't there; a short first chunk is penalised.
    assert rerank(spark, "one two three four five six seven eight", "exact_quote", "zzz", chunk_index=0) == pytest.approx(-0.35 - 0.25)


def test_ranking_drops_low_scores(spark):
    df = spark.createDataFrame([(1, "a", 0.2, False, 0.0, 0), (1, "b", -0.1, False, 0.0, 1), (1, "c", 0.1, True, 0.0, 2)], "query_id int, chunk_id string, score double, exact_phrase_match boolean, resource_match_score double, chunk_index int")
    assert [(r.chunk_id, r.rank) for r in S.ranked(df, 5).orderBy("rank").collect()] == [("c", 1), ("a", 2)]


def test_term_match(spark):
    df = spark.createDataFrame([(["golden", "rivers"], "Golden Rivers"), (["golden"], "Golden Gate Bridge Park"), (["x"], "y")], "q array<string>, t string")
    assert [r[0] for r in df.select(S.term_match(F.col("q"), F.col("t"))).collect()] == [2.0, 1.0, 0.0]


def test_ci_metrics_as_tab_separated_values(spark, tmp_path):
    from folioflow.sources import web

    report = '{"component": {"key": "shop", "measures": [{"metric": "coverage", "value": "87.5"}, {"metric": "bugs", "value": "3"}]}}'
    rows = web.ci_metrics(spark.createDataFrame([(report,), ("no json",), (None,)], "report string"))
    web.write_tsv(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*.csv")).read_text()
    assert text.splitlines() == ["project\tmetric\tvalue", "shop\tcoverage\t87.5", "shop\tbugs\t3.0"]


def test_phrases_inside_values_by_brute_force(spark):
    import random

    from folioflow.operators.substrings import inside

    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc %_") for _ in range(rng.randrange(n)))
    values, phrases = [word(14) for _ in range(60)] + [None, ""], [(i, word(6)) for i in range(80)] + [(80, None), (81, "")]
    found = inside(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(phrases, "query_id int, phrase string"))
    assert sorted(map(tuple, found.collect())) == sorted({(i, v) for i, p in phrases if p for v in values if v and p in v})
    like = lambda p: re.compile(".*" + "".join("." if c == "_" else ".*" if c == "%" else c for c in p) + ".*", re.S)
    found = inside(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(phrases, "query_id int, phrase string"), wildcards=True)
    got = {tuple(r) for r in found.collect() if r[1]}
    assert got == {(i, v) for i, p in phrases if p for v in values if v and like(p).fullmatch(v)}


def test_reranking_of_all_passages_by_brute_force(spark, small):
    """The rerank formula in plain Python over what keyword search finds."""
    import math

    from folioflow.plans import registry
    from folioflow.plans import search as P

    aliases, stop = T.ALIASES, set(T.STOP_WORDS)

    def terms(text):
        low = [w.strip("'-").lower() for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9'-]*", text or "")]
        return list(dict.fromkeys(aliases.get(w, w) for w in low if len(w) >= 3 and w not in stop))

    flat = lambda text: " ".join(w.strip("'-").lower() for w in re.findall(r"[A-Za-z0-9][A-Za-z0-9'-]*", text or ""))
    texts = {r["chunk_id"]: r for r in P.document_chunks(spark, small).collect()}
    asked = {r["query_id"]: (r["normalised"], r["intent"]) for r in S.understood(P._passages(spark, small)).collect()}
    by_query: dict = {}
    for r in registry.QUERIES["keyword_search"](spark, small).collect():
        query, intent = asked[r["query_id"]]
        chunk = texts[r["chunk_id"]]
        low, match = (chunk["chunk_text"] or "").lower(), r["resource_match_score"]
        q, have, title = terms(query), set(terms(chunk["chunk_text"])), set(terms(chunk["title"]))
        phrase = flat(query) != "" and flat(query) in flat(chunk["chunk_text"])
        lookup = intent == "title_lookup" or 1 <= len(q) <= 4
        missing = sum(w not in have for w in q)
        cover = 0.0
        if q:
            cover = 2.5 * (len(q) - missing) / len(q) + (1.2 if lookup else 0.25) * sum(w in title for w in q) / len(q) + (0.75 if missing == 0 else 0.35 if missing <= max(1, len(q) // 4) else 0.0)
        penalty = min(1.0, (0.25 if len(chunk["chunk_text"] or "") < 350 else 0.0) + 0.35 * sum(m in low for m in S.FRONT_MARKS))
        resource = min(match * 0.35, 0.70) if lookup else min(match * 0.08, 0.12)
        early = max(0.0, 0.55) if lookup and match > 0 else 0.0
        by_intent = {"exact_quote": 1.25 if phrase else -0.35, "summary_request": min(match * 0.30, 0.50) - penalty * 0.75, "broad_document_query": min(match * 0.20, 0.35) - penalty * 0.60}.get(intent, 0.0)
        asks = query.lower()
        evidence = sum(0.80 for m in S.EVIDENCE if m in low) if "impression" in asks or "perceiv" in asks else 0.0
        quote = 1.0 if ("quote" in asks or len(query.split()) > 8) and phrase else 0.0
        score = (3.0 if phrase else 0.0) + cover + resource + early + by_intent + min(evidence + quote, 3.5) - (0.0 if lookup else penalty)
        final = score + min(math.log1p(max(r["keyword_score"], 0.0)) / 10, 0.60)
        by_query.setdefault(r["query_id"], []).append((final, score, match, r["chunk_id"]))
    found: dict = {}
    for r in registry.QUERIES["reranking"](spark, small).collect():
        found.setdefault(r["query_id"], {})[r["chunk_id"]] = (r["rerank_score"], r["score"], r["rank"])
    assert found.keys() == by_query.keys()
    for query, rows in by_query.items():
        for place, (final, score, _, chunk) in enumerate(sorted(rows, key=lambda x: (-round(x[0], 7), -x[2], x[3])), 1):
            if found[query].get(chunk):
                got = found[query][chunk]
                assert got[0] == pytest.approx(score, abs=1e-5) and got[1] == pytest.approx(final, abs=1e-5)
                assert abs(got[2] - place) <= sum(abs(f - final) < 1e-6 for f, *_ in rows) - 1


def test_equal_wordings_are_looked_up_once(spark, monkeypatch):
    chunks = spark.range(60).selectExpr("id as chunk_id", "'' as chunk_text", "concat('hot bolt ', id % 2) as title", "concat('brand#', id % 3) as author", "id % 7 as chunk_index")
    queries = spark.range(80).selectExpr("100 + id as query_id", "case id % 3 when 0 then 'brand#1' when 1 then 'bolt 1' end as normalised", "'title_lookup' as intent")
    sizes, plain = [], S.inside
    monkeypatch.setattr(S, "inside", lambda values, asked, *more: sizes.append(asked.count()) or plain(values, asked, *more))
    found = {}
    for r in S.keyword_top(chunks, queries, 4).collect():
        found.setdefault(r["query_id"], []).append((r["keyword_rank"], r["chunk_id"], r["keyword_score"], r["resource_match_score"]))
    assert sizes == [3]
    for query in range(80):
        want = {0: [(1, 1, 3.0, 0.0), (2, 4, 3.0, 0.0), (3, 7, 3.0, 0.0), (4, 10, 3.0, 0.0)], 1: [(1, 7, 5.0, 1.0), (2, 21, 5.0, 1.0), (3, 35, 5.0, 1.0), (4, 49, 5.0, 1.0)], 2: []}[query % 3]
        assert sorted(found.get(100 + query, [])) == want


def test_decisions_of_single_chunks_need_no_shuffle(spark, small):
    """Documents that stand once each are looked at where they lie, in one pass."""
    from folioflow.plans import registry

    plan = registry.QUERIES["quality_decisions"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan and plan.count("regexp_replace(") < 20
