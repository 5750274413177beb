"""Retrieval queries: vectors over embeddings, benchmark passages over documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.functions import vectors as V
from folioflow.operators import gates as G
from folioflow.operators import search as S
from folioflow.operators.fulltext_store import FullTextIndex
from folioflow.operators.vector_index import VectorIndex
from folioflow.sources.scratch import kept, shared_folder, stored

from .chunks import COUNT, MEANINGFUL, TABLE_HEAVY, TERMS, VISIBLE, _list
from .roles import resource_tags, role, table, with_roles

K = 10


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label")


def _asked_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).where("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), "vector")


def document_chunks(spark, sf_dir):
    """Documents as chunks of their own."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.concat(F.lit("document "), "doc_id").alias("title"), F.col("source").alias("category"), F.lit(0).alias("chunk_index"))


def _passages(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def vector_search(spark, sf_dir):
    """Every fiftieth vector against all of them."""
    return S.vector_top(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), K).select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"), "vector_rank")


def vector_search_in_space(spark, sf_dir):
    """The same queries inside one embedding space, whose name is the label."""
    named = _vectors(spark, sf_dir).withColumns({"embedding_provider": F.lit("given"), "embedding_model": F.concat(F.lit("m"), "label"), "embedding_version": F.lit("1"), "embedding_dimension": F.size("vector")})
    space = G.in_space(named, "given", "m3", "1", 64)
    return S.vector_top(space, _asked_vectors(spark, sf_dir), K).select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"), "vector_rank")


def _vector_index(spark, sf_dir):
    return VectorIndex.build(_vectors(spark, sf_dir), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")


def vector_search_indexed(spark, sf_dir):
    """Every fiftieth vector against all of them, by the nearest cells of a stored index."""
    index = _vector_index(spark, sf_dir)
    return index.top(_asked_vectors(spark, sf_dir), K, index.probes()).select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"), "vector_rank")


def vector_search_all_cells(spark, sf_dir):
    """The same by all cells of the index, which has been filled in two turns: what a scan of all vectors gives."""
    vectors, odd = _vectors(spark, sf_dir), F.col("chunk_id") % 2 == 1
    index = VectorIndex.build(vectors.where(~odd), f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    index.append(vectors.where(odd))
    return index.top(_asked_vectors(spark, sf_dir), K).select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"), "vector_rank")


#: What the filtered searches ask for, beside resources that are ready and open.
ASKED_TAGS, ASKED_CATEGORY = ("small", "steel", "navy"), "NATION_7"


def _resources(spark, sf_dir):
    return role(spark, sf_dir, "resources").join(role(spark, sf_dir, "categories").select("category_id", "category_name"), "category_id", "left")


def vector_search_filtered(spark, sf_dir):
    """Vectors of resources that are ready, open, and have any of the tags; a vector belongs to the resource of its number."""
    vectors = _vectors(spark, sf_dir).withColumn("resource_id", F.col("chunk_id") + 1)
    seen = G.visible(vectors, _resources(spark, sf_dir), G.Filters(tags=ASKED_TAGS), resource_tags(spark, sf_dir))
    return S.vector_top(seen, _asked_vectors(spark, sf_dir), K).select("query_id", "chunk_id", F.round("vector_score", 6).alias("score"), "vector_rank")


def _named_chunks(spark, sf_dir):
    """Parts as chunks without a text, so that only names match."""
    tags = F.lower("description").alias("tags")
    return _resources(spark, sf_dir).select("resource_id", F.col("resource_id").alias("chunk_id"), F.lit("").alias("chunk_text"), "title", F.col("publisher").alias("author"), F.col("category_name").alias("category"), tags, (F.col("resource_id") % 7).alias("chunk_index"))


def _name_queries(spark, sf_dir):
    """Letters from the middle of a name, a brand, or a category, inside words as well."""
    part = table(spark, sf_dir, "part").where("p_partkey % 50 = 0")
    wording = "case p_partkey % 4 when 0 then substring(p_name, 3, 7) when 1 then p_brand when 2 then p_name else substring(lower(p_type), 2, 8) end"
    return part.selectExpr("p_partkey as query_id", f"{wording} as normalised", "'title_lookup' as intent")


def keyword_search_by_names(spark, sf_dir):
    """Title, author, category and tags, with their boosts, over ready and open resources."""
    seen = G.visible(_named_chunks(spark, sf_dir), _resources(spark, sf_dir))
    return S.keyword_top(seen, _name_queries(spark, sf_dir), K).select("query_id", "chunk_id", "keyword_score", "resource_match_score", "keyword_rank")


def keyword_search_filtered(spark, sf_dir):
    """The same in one category."""
    seen = G.visible(_named_chunks(spark, sf_dir), _resources(spark, sf_dir), G.Filters(category=ASKED_CATEGORY))
    return S.keyword_top(seen, _name_queries(spark, sf_dir), K).select("query_id", "chunk_id", "keyword_score", "resource_match_score", "keyword_rank")


def keyword_search_by_tags(spark, sf_dir):
    """Tags put together from their table, each resource's in order, as the text that queries are looked for in."""
    tags = resource_tags(spark, sf_dir).groupBy("resource_id").agg(F.array_join(F.sort_array(F.collect_set("tag_name")), " ").alias("tags"))
    seen = G.visible(_named_chunks(spark, sf_dir).drop("tags").join(tags, "resource_id", "left"), _resources(spark, sf_dir))
    return S.keyword_top(seen, _name_queries(spark, sf_dir), K).select("query_id", "chunk_id", "keyword_score", "resource_match_score", "keyword_rank")


def query_understanding(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.col("text").alias("query"))
    return S.understood(turns).select("conv_id", "turn", F.sha2("normalised", 256).alias("normalised"), "intent", F.size("terms").alias("n_terms"))


def text_index(spark, sf_dir):
    """The stored index of the documents' texts: built by the first search, and shared by all of them."""
    docs = document_chunks(spark, sf_dir)
    folder = stored(spark, "documents-text", docs, lambda f: FullTextIndex.build(docs, f))
    return FullTextIndex(spark, folder, "chunk_id", docs.schema["chunk_id"].dataType.simpleString())


def keyword_search(spark, sf_dir):
    """Benchmark passages that stand in documents, by all of their terms."""
    return S.keyword_top(document_chunks(spark, sf_dir), S.understood(_passages(spark, sf_dir)), K, index=text_index(spark, sf_dir)).select("query_id", "chunk_id", F.round("keyword_score", 6).alias("keyword_score"), "resource_match_score", "keyword_rank")


def _two_lists(spark, sf_dir):
    """Two lists of the same queries: by whole vectors, and by their first eight numbers."""
    vector = S.vector_top(_vectors(spark, sf_dir), _asked_vectors(spark, sf_dir), K)
    head = lambda rows: rows.withColumn("vector", F.slice("vector", 1, 8))
    other = S.vector_top(head(_vectors(spark, sf_dir)), head(_asked_vectors(spark, sf_dir)), K)
    return vector, other.select("query_id", "chunk_id", F.col("vector_score").alias("keyword_score"), (F.col("chunk_id") % 3).cast("double").alias("resource_match_score"), F.col("vector_rank").alias("keyword_rank"), (F.col("chunk_id") % 7 == 0).alias("exact_phrase_match"))


def fusion_by_rank(spark, sf_dir):
    return S.fused_by_rank(*_two_lists(spark, sf_dir)).select("query_id", "chunk_id", "vector_rank", "keyword_rank", F.round("score", 9).alias("score"))


def fusion_by_score(spark, sf_dir):
    return S.fused_by_score(*_two_lists(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def quality_decisions(spark, sf_dir):
    return S.decided(S.with_decision_flags(document_chunks(spark, sf_dir)).withColumn("resource_match_score", F.when(F.col("chunk_id") % 9 == 0, 1.0).otherwise(0.0))).select("chunk_id", "keep", "reason")


def reranking(spark, sf_dir):
    """Each passage against the documents that hold it, by the rerank formula."""
    asked = S.understood(_passages(spark, sf_dir)).select("query_id", F.col("normalised").alias("query"), "intent")
    found = kept(S.keyword_top(document_chunks(spark, sf_dir), S.understood(_passages(spark, sf_dir)), K, index=text_index(spark, sf_dir)), "found").withColumn("score", F.col("keyword_score"))
    full = found.join(document_chunks(spark, sf_dir), "chunk_id").join(asked, "query_id")
    return S.ranked(S.reranked(full, K), K).select("query_id", "chunk_id", "rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("score", 6).alias("score"))


def hybrid_search(spark, sf_dir):
    """Benchmark passages over documents, from wording to snippets. Vectors are the repeatable stand-in for a model."""
    chunks = document_chunks(spark, sf_dir).withColumn("vector", V.hashed_embedding(F.col("chunk_text"), 32))
    queries = _passages(spark, sf_dir).withColumn("vector", V.hashed_embedding(F.col("query"), 32))
    return S.hybrid(chunks, queries, K, index=text_index(spark, sf_dir))


def relevance_labels(spark, sf_dir):
    """Mean text measures by label: the evaluation join."""
    docs = table(spark, sf_dir, "documents").select("doc_id", T.token_count("text").alias("tokens"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy("quality").agg(F.count("*").alias("n"), F.round(F.avg("tokens"), 4).alias("avg_tokens"), F.sum("toxic").alias("toxic"))


COSINE = "list_cosine_similarity(cast({0} as double[]), cast({1} as double[]))"
RANKED = f"""vector_top as (select * from (select q.vec_id as query_id, e.vec_id as chunk_id, {COSINE.format("e.embedding", "q.embedding")} as vector_score,
  cast(row_number() over (partition by q.vec_id order by {COSINE.format("e.embedding", "q.embedding")} desc, e.vec_id) as int) as vector_rank from embeddings e, embeddings q where q.vec_id % 50 = 0) where vector_rank <= {K})"""
HEAD = COSINE.format("e.embedding[1:8]", "q.embedding[1:8]")
LISTS = f"""{RANKED}, keyword_top as (select query_id, chunk_id, score as keyword_score, cast(chunk_id % 3 as double) as resource_match_score, keyword_rank, chunk_id % 7 = 0 as exact from (
  select q.vec_id as query_id, e.vec_id as chunk_id, {HEAD} as score, cast(row_number() over (partition by q.vec_id order by {HEAD} desc, e.vec_id) as int) as keyword_rank
  from embeddings e, embeddings q where q.vec_id % 50 = 0) where keyword_rank <= {K})"""
OPEN = "select r.*, c.category_name from resources r left join categories c using (category_id) where r.rag_enabled and r.ingestion_status = 'READY'"
BY_NAMES = """, seen as ({open}), asked as (select p_partkey as query_id, lower(case p_partkey % 4 when 0 then substring(p_name, 3, 7) when 1 then p_brand when 2 then p_name else substring(lower(p_type), 2, 8) end) as phrase from part where p_partkey % 50 = 0),
  told as (select query_id, resource_id as chunk_id, resource_id % 7 as chunk_index, lower(title) = phrase as same, contains(lower(title), phrase) as t, contains(lower(publisher), phrase) as a, contains(lower(coalesce(category_name, '')), phrase) as c, contains(lower(description), phrase) as d from seen, asked),
  scored as (select query_id, chunk_id, chunk_index, 10.0 * cast(same as int) + 5 * cast(t as int) + 3 * cast(a as int) + 2 * cast(c as int) + 2 * cast(d as int) as s, case when same then 2.0 when t then 1.0 else 0.0 end as m from told where t or a or c or d),
  ranked as (select *, cast(row_number() over (partition by query_id order by m desc, case when m > 0 then chunk_index else 0 end, s desc, chunk_id) as int) as keyword_rank from scored)
  select query_id, chunk_id, cast(s as double) as keyword_score, cast(m as double) as resource_match_score, keyword_rank from ranked where keyword_rank <= {k}"""
PART = "case when max({0}) over w > min({0}) over w then ({0} - min({0}) over w) / (max({0}) over w - min({0}) over w) else cast({0} > 0 as double) end"
FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"
SQL_QUOTE = S.QUOTE.replace("'", "''")
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
# Each run of letters, quotes and hyphens is a word that may be misspelt as a whole, in any of three cases.
RESPELT = f"""trim(array_to_string(list_transform(regexp_extract_all({{0}}, '[A-Za-z''-]+|[^A-Za-z''-]+'), lambda w: case when not list_contains({_list(T.ALIASES)}, lower(w)) then w
  when w = upper(w) then upper({{1}}) when w = upper(w[1]) || lower(w[2:]) then upper({{1}}[1]) || {{1}}[2:] else {{1}} end), ''))""".replace("{1}", f"map({_list(T.ALIASES)}, {_list(T.ALIASES.values())})[lower(w)]")
ORACLES = {
    "query_understanding": rf"""with asked as (select conv_id, turn, {FLAT} as original from conversations where role = 'user'), quoted as (select *, regexp_matches(original, '{SQL_QUOTE}') as q from asked),
      candidates as (select *, case when q then {STRIP.format(f"regexp_extract(original, '{SQL_QUOTE}', 1)")} else original end as candidate from quoted),
      bare as (select *, {STRIP.format(f"regexp_replace(candidate, '{S.QUESTION_PREFIX}', '')")} as unasked from candidates),
      clean as (select *, coalesce(nullif({STRIP.format(f"regexp_replace(unasked, '{S.SUBJECT_PREFIX}', '')")}, ''), nullif(unasked, ''), candidate) as cleaned from bare),
      spelt as (select *, {RESPELT.format("cleaned")} as spelt from clean),
      told as (select *, {TERMS.format("spelt")} as terms, len(list_filter(string_split_regex(spelt, '\s+'), lambda w: w <> '')) as n_words, len(regexp_extract_all(spelt, '[,;:.!?]')) as marks from spelt)
      select conv_id, turn, sha256(coalesce(nullif(spelt, ''), original)) as normalised, case when q or (n_words >= 8 and marks >= 2) then 'exact_quote' when regexp_matches(original, '{S.SUMMARY}') then 'summary_request'
        when regexp_matches(original, '{S.QUESTION}') or ends_with(original, '?') then 'factual_question' when len(list_distinct(terms)) between 1 and 4 then 'title_lookup' else 'broad_document_query' end as intent, cast(len(terms) as int) as n_terms from told""",
    "quality_decisions": rf"""with flat as (select doc_id, {FLAT} as t, trim(regexp_replace(regexp_replace(text, '(?i)\[Page\s+\d+\]', ' ', 'g'), '\s+', ' ', 'g')) as shown from documents),
      measured as (select doc_id, {MEANINGFUL.format("t")} as n, list_bool_or(list_transform({_list(S.RESULT_BOILERPLATE)}, lambda p: contains(lower(t), p))) as phrase, contains(lower(t), '[page') and {MEANINGFUL.format("shown")} < 5 as marker,
        coalesce({COUNT.format("t", r"\p{L}")} / {VISIBLE.format("t")} < 0.45, false) and not {TABLE_HEAVY.format("t")} as poor,
        coalesce(list_sum(list_transform({_list(T.MOJIBAKE)}, lambda m: (length(t) - length(replace(t, m, ''))) / length(m))) / {VISIBLE.format("t")} > 0.08, false) as broken from flat),
      told as (select doc_id, case when (phrase and n < 60) or marker then 'short_boilerplate_text' when doc_id % 9 = 0 then 'resource_metadata_match' when n < 5 or poor or broken then 'low_value_result_text' else 'searchable_text' end as reason from measured)
      select doc_id as chunk_id, reason in ('resource_metadata_match', 'searchable_text') as keep, reason from told""",
    "vector_search": f"with {RANKED} select query_id, chunk_id, round(vector_score, 6) as score, vector_rank from vector_top",
    "vector_search_in_space": f"""select query_id, chunk_id, round(score, 6) as score, vector_rank from (select q.vec_id as query_id, e.vec_id as chunk_id, {COSINE.format("e.embedding", "q.embedding")} as score,
      cast(row_number() over (partition by q.vec_id order by {COSINE.format("e.embedding", "q.embedding")} desc, e.vec_id) as int) as vector_rank from embeddings e, embeddings q where q.vec_id % 50 = 0 and e.label = 3) where vector_rank <= {K}""",
    "vector_search_filtered": with_roles(
        f""", seen as ({OPEN} and exists (select 1 from resource_tags t where t.resource_id = r.resource_id and t.tag_name in {ASKED_TAGS}))
      select query_id, chunk_id, round(score, 6) as score, vector_rank from (select q.vec_id as query_id, e.vec_id as chunk_id, {COSINE.format("e.embedding", "q.embedding")} as score,
      cast(row_number() over (partition by q.vec_id order by {COSINE.format("e.embedding", "q.embedding")} desc, e.vec_id) as int) as vector_rank from embeddings e join seen on seen.resource_id = e.vec_id + 1, embeddings q where q.vec_id % 50 = 0) where vector_rank <= {K}""",
        "resources", "categories", "resource_tags",
    ),
    "keyword_search_by_names": with_roles(BY_NAMES.format(open=OPEN, k=K), "resources", "categories"),
    "keyword_search_filtered": with_roles(BY_NAMES.format(open=f"{OPEN} and category_name = '{ASKED_CATEGORY}'", k=K), "resources", "categories"),
    "keyword_search_by_tags": with_roles(
        BY_NAMES.format(open=OPEN, k=K).replace("contains(lower(description), phrase) as d", "contains((select lower(string_agg(tag_name, ' ' order by tag_name)) from resource_tags t where t.resource_id = seen.resource_id), phrase) as d"),
        "resources", "categories", "resource_tags",
    ),
    "fusion_by_rank": f"""with {LISTS} select query_id, chunk_id, vector_rank, keyword_rank, round(coalesce(0.7 / (60 + vector_rank), 0) + coalesce(0.3 / (60 + keyword_rank), 0) + coalesce(cast(exact as double), 0), 9) as score
      from vector_top full join keyword_top using (query_id, chunk_id)""",
    "fusion_by_score": f"""with {LISTS}, v as (select *, {PART.format("vector_score")} as part from vector_top window w as (partition by query_id)), k as (select *, {PART.format("keyword_score")} as part from keyword_top window w as (partition by query_id)),
      plain as (select query_id, chunk_id, coalesce(v.part, 0) * 0.7 + coalesce(k.part, 0) * 0.3 as p, coalesce(exact, false) as exact, coalesce(resource_match_score, 0) as m from v full join k using (query_id, chunk_id))
      select query_id, chunk_id, round(case when exact then greatest(p, 1) else p end + least(m * 0.1, 0.2), 6) as score from plain""",
    "relevance_labels": r"select quality, count(*) as n, round(avg(len(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'))), 4) as avg_tokens, cast(sum(toxic) as bigint) as toxic from documents join labels using (doc_id) group by quality",
}
ORACLES["vector_search_all_cells"] = ORACLES["vector_search"]
QUERIES = {name: globals()[name] for name in (*ORACLES, "vector_search_indexed", "keyword_search", "reranking", "hybrid_search")}
