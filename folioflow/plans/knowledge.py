"""Queries of graphs, answers, questions, pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import answer as A
from folioflow.operators import cleanup as P
from folioflow.operators import embedding as E
from folioflow.operators import graph as G
from folioflow.operators import routing as R
from folioflow.operators import search as S
from folioflow.sources import files as files_source
from folioflow.sources import web

from . import chunks as chunk_plans
from .roles import table
from .search import document_chunks, text_index

MENTION = "concat('Part-', cast(l_partkey % 40 as varchar(10)))"


def _mentions(spark, sf_dir):
    """Parts named in orders, in the place of names in chunks."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 20 as resource_id", "l_orderkey as chunk_id", "l_linenumber as chunk_index", "l_partkey * 1000 + l_suppkey as position", f"case when l_quantity > 25 then upper({MENTION}) else {MENTION} end as name",
        "case when l_returnflag = 'A' then null else l_returnflag end as entity_type", "case when l_linestatus = 'F' then concat('ships ', cast(l_suppkey as varchar(10))) end as description", "l_discount as confidence",
    )


def _edges(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey % 20 as resource_id", "l_orderkey as chunk_id", "l_linenumber as chunk_index", f"{MENTION} as source", "concat('part ', cast(l_suppkey % 45 as varchar(10)))  as target",
        "case when l_tax > 0.04 then 'sold with' else '' end as relationship_type", "cast(null as varchar(10)) as description", "l_tax as confidence",
    )


def graph_entities(spark, sf_dir):
    return G.entities(_mentions(spark, sf_dir))


def graph_relationships(spark, sf_dir):
    return G.relationships(_edges(spark, sf_dir), G.entities(_mentions(spark, sf_dir))).drop("description")


def _sparse(spark, sf_dir):
    """An edge for each part, sixty in a resource, so that there are several communities in each."""
    rows = table(spark, sf_dir, "part")
    return rows.selectExpr("cast(floor(p_partkey / 60) as bigint) as resource_id", "concat('n', cast(p_partkey % 30 as varchar(10))) as source_key", "concat('n', cast(100 + p_size * 7 % 101 as varchar(10))) as target_key").distinct()


def graph_communities(spark, sf_dir):
    return G.communities(_sparse(spark, sf_dir).where("source_key <> target_key"))


def graph_summaries(spark, sf_dir):
    labels = graph_communities(spark, sf_dir)
    return G.community_summaries(labels, labels.select("resource_id", "entity_key", F.upper("entity_key").alias("name")))


def graph_facts(spark, sf_dir):
    """Facts of each resource as JSON."""
    nodes = G.entities(_mentions(spark, sf_dir))
    return G.facts(nodes, G.relationships(_edges(spark, sf_dir), nodes))


def graph_from_text(spark, sf_dir):
    """Names in documents by rule, their neighbours as edges, and what is left of both."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("resource_id"), F.col("doc_id").alias("chunk_id"), F.lit(0).alias("chunk_index"), F.col("text").alias("chunk_text"))
    mentions = G.capitalised_mentions(docs)
    nodes = G.entities(mentions)
    return G.relationships(G.neighbours(mentions), nodes).groupBy("resource_id").agg(F.count("*").alias("edges"), F.sum("mention_count").alias("mentions"))


def entity_search(spark, sf_dir):
    """Suppliers' customers by fuzzy name."""
    names = table(spark, sf_dir, "part").select(F.col("p_name").alias("entity_key"), F.col("p_name").alias("name")).distinct()
    queries = table(spark, sf_dir, "part").where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.concat(F.substring("p_name", 1, 6), F.lit(" x")).alias("query"))
    return G.similar_names(names, queries, 5).select("query_id", "entity_key", F.round("score", 6).alias("score"), "rank")


def _graph_queries(spark, sf_dir):
    return table(spark, sf_dir, "part").where("p_partkey % 50 = 0").selectExpr("p_partkey as query_id", "case when p_partkey % 100 = 0 then substring(p_type, 3, 6) else concat(substring(p_name, 1, 7), ' x') end as query")


def _links(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr(
        "p_partkey as relationship_id", "p_partkey % 40 as resource_id", "upper(replace(substring(p_type, 1, 12), ' ', '_')) as relationship_type", "case when p_partkey % 4 = 0 then null else p_type end as description", "p_name as source_name", "p_brand as target_name"
    )


def _abstracts(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey as summary_id", "p_partkey % 40 as resource_id", "concat(p_name, ' ', p_type) as summary_text")


def relationship_search(spark, sf_dir):
    """Relationships that a query names, by description, type or either end."""
    return G.relationship_top(_links(spark, sf_dir), _graph_queries(spark, sf_dir), 5).select("query_id", "relationship_id", F.round("score", 6).alias("score"), "rank")


def summary_search(spark, sf_dir):
    return G.summary_top(_abstracts(spark, sf_dir), _graph_queries(spark, sf_dir), 5).select("query_id", "summary_id", F.round("score", 6).alias("score"), "rank")


def graph_search(spark, sf_dir):
    """All of a graph search: entities, relationships, summaries, and the first chunks of the resources that they are of."""
    part = table(spark, sf_dir, "part")
    nodes = part.selectExpr("p_name as entity_key", "p_name as name", "p_partkey % 40 as resource_id")
    chunks = part.selectExpr("p_partkey as chunk_id", "p_partkey % 40 as resource_id", "p_size as chunk_index", "p_type as chunk_text")
    found = G.graph_search(nodes, _links(spark, sf_dir), _abstracts(spark, sf_dir), chunks, _graph_queries(spark, sf_dir), 5)
    ids = {"entities": "entity_key", "relationships": "relationship_id", "summaries": "summary_id", "chunks": "chunk_id"}
    rows = [found[kind].select("query_id", F.lit(kind).alias("kind"), F.col(key).cast("string").alias("id"), "rank").distinct() for kind, key in ids.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])


def related_chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("resource_id"), (F.col("doc_id") % 13).alias("chunk_index"), F.col("text").alias("chunk_text"))
    return G.related_chunks(docs, docs.where("resource_id = 'src3'"), docs.where("chunk_id % 50 = 7"), 60)


def _answers(spark, sf_dir):
    """Turns as answers, with citations made up by rule, and the turn before as the source."""
    from pyspark.sql import Window

    turns = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn")
    rows = turns.withColumn("source", F.lag("text").over(before)).where("source is not null")
    cite = F.expr("case cast(conv_id + turn as int) % 5 when 0 then '' when 1 then ' [Source rank 1, chunk 0]' when 2 then ' [Source rank 2, chunk 0]' when 3 then ' [Source rank 1, chunk 4, page 3]' else ' probably [Source rank 1]' end")
    own = F.when(F.col("turn") % 2 == 0, F.col("source")).otherwise(F.col("text"))
    sources = F.array(F.struct(F.lit(1).alias("rank"), F.lit(0).alias("chunk_index"), F.col("source").alias("chunk_text")))
    return rows.select("conv_id", "turn", F.concat(F.regexp_replace(own, "\n", " "), cite).alias("answer"), F.when(F.col("conv_id") % 7 == 0, "Where is Zanzibar").otherwise("who is it").alias("query"), sources.alias("sources"))


def faithfulness(spark, sf_dir):
    return A.verified(_answers(spark, sf_dir)).select("conv_id", "turn", "supported", "reason", "overlap")


def answer_status(spark, sf_dir):
    return A.settled(A.verified(_answers(spark, sf_dir))).groupBy("status").agg(F.count("*").alias("n"))


def grounded_answers(spark, sf_dir):
    """Search, context, two models of which one fails, verdicts."""
    found = S.hybrid(document_chunks(spark, sf_dir), table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), 5, index=text_index(spark, sf_dir))
    asked = S.understood(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))).select("query_id", F.col("normalised").alias("query"), "intent")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))
    pages = {c: F.lit(None).cast("int") for c in ("page_start", "page_end")} | {"section_title": F.lit(None).cast("string")}
    results = found.select("query_id", "rank", "chunk_id", "title", "chunk_index").join(docs, "chunk_id").join(asked, "query_id").withColumns(pages)
    contexts = A.packed_context(results, 5, 4000, 900)

    def broken(prompts):
        raise RuntimeError("no model here")

    out = A.answered(contexts, {"extractive": A.extractive, "broken": broken})
    return A.settled(A.verified(out)).select("query_id", "model", "ok", "status", "reason", "error")


def answer_events(spark, sf_dir):
    """Progress of a comparison as server-sent frames, and read back."""
    answers = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("model"), (F.col("item_id") % 3 > 0).alias("ok"), F.col("text").alias("answer"), F.lit(None).cast("string").alias("error"))
    frames = A.progress_events(answers).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "frame"))), lambda s: s["frame"]), "").alias("text"))
    return web.events_of(frames).select("query_id", "seq", "event")


def routed_questions(spark, sf_dir):
    """Customers' names in questions of every kind to tools."""
    kinds = ["books by the {} in stock", "find users {} with status active", "show subscriptions for {} premium", "pending approval requests {}", "what tags are there", "genre: {}", "find author {}", "list books about {}", "tell me {}"]
    case = F.element_at(F.array(*(F.concat(*(F.lit(x) if i == 0 else F.concat(F.col("c_name"), F.lit(x)) for i, x in enumerate(k.split("{}")))) for k in kinds)), (F.col("c_custkey") % len(kinds) + 1).cast("int"))
    out = R.routed(table(spark, sf_dir, "customer").select("c_custkey", case.alias("question")))
    return out.select("c_custkey", "tool", "chosen_by", F.to_json("arguments").alias("arguments"))


def page_texts(spark, sf_dir):
    """The plain text of web pages."""
    return table(spark, sf_dir, "pages").select("page_id", files_source.html_text("html").alias("text"))


def cleaned_documents(spark, sf_dir):
    """Documents as if extracted from PDF pages."""
    return P.cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))


def embedded_chunks(spark, sf_dir):
    """Vectors for chunks' texts with their context, bad ones apart."""
    texts = chunk_plans.kept_chunks(spark, sf_dir).withColumn("title", F.concat(F.lit("document "), "doc_id"))
    chunks = texts.select("doc_id", "chunk_index", E.input_text("title", "chunk_text", "section_title").alias("text"))
    out = E.embedded(chunks, E.hashed(16), 16)
    return out.select("doc_id", "chunk_index", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), "error")


TRI = "list_distinct(flatten(list_transform(list_filter(string_split_regex(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"
KEY = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
MENTIONS = f"""mentions as (select l_orderkey % 20 as resource_id, l_orderkey as chunk_id, l_linenumber as chunk_index, l_partkey * 1000 + l_suppkey as position, case when l_quantity > 25 then upper({MENTION}) else {MENTION} end as name,
  case when l_returnflag = 'A' then 'UNKNOWN' else l_returnflag end as entity_type, case when l_linestatus = 'F' then concat('ships ', cast(l_suppkey as varchar(10))) end as description, l_discount as confidence from lineitem),
entities as (select resource_id, {KEY.format("name")} as entity_key, arg_min(name, (chunk_index, position, chunk_id)) as name,
  coalesce(arg_min(entity_type, (chunk_index, position, chunk_id)) filter (entity_type <> 'UNKNOWN'), 'UNKNOWN') as entity_type, arg_min(description, (chunk_index, position, chunk_id)) filter (description is not null) as description,
  max(confidence) as confidence, count(distinct chunk_id) as chunk_count, count(*) as mention_count from mentions group by all)"""
WORD = "list_distinct(list_transform(list_filter(list_transform(regexp_extract_all({0}, '[A-Za-z][A-Za-z'']{{2,}}'), lambda w: trim(lower(w), '''')), lambda w: not list_contains({1}, w)), lambda w: substring(w, 1, 10)))"
STOP = "[" + ", ".join(f"'{w}'" for w in A.EVIDENCE_STOP) + "]"
INFER = "[" + ", ".join(f"'{w}'" for w in A.INFERENCE) + "]"
VERDICT = f"""turns as (select *, lag(text) over (partition by conv_id order by turn) as source from conversations),
answers as (select conv_id, turn, regexp_replace(replace(case when turn % 2 = 0 then source else text end, chr(10), ' '), '^\\s+|\\s+$', '', 'g') as said, cast(conv_id + turn as int) % 5 as kind, conv_id % 7 = 0 as zanzibar, source from turns where source is not null),
terms as (select *, case kind when 4 then ' probably' else '' end as tail, {WORD.format("said || case kind when 4 then ' probably ' else ' ' end", STOP)} as own, {WORD.format("source", STOP)} as context from answers),
measured as (select *, case when len(own) > 0 and len(context) > 0 then len(list_intersect(own, context)) / len(own) else 0 end as overlap from terms),
verdicts as (select conv_id, turn, round(overlap, 4) as overlap, case when list_bool_or(list_transform({INFER}, lambda p: contains(lower(said || tail), p))) then 'answer_uses_unsupported_inference_language'
  when kind = 0 then 'answer_has_no_source_rank_citations' when kind = 2 then 'answer_cites_source_ranks_not_in_context' when kind = 3 then 'answer_cites_wrong_chunk_for_source_rank'
  when zanzibar and not list_contains(context, 'zanzibar') then 'query_named_anchors_not_found_in_selected_context' when overlap < 0.20 then 'answer_terms_not_supported_by_selected_context'
  else 'answer_citations_match_selected_context' end as reason from measured)"""
SPARSE = "sparse as (select distinct cast(floor(p_partkey / 60) as bigint) as resource_id, concat('n', cast(p_partkey % 30 as varchar(10))) as a, concat('n', cast(100 + p_size * 7 % 101 as varchar(10))) as b from part)"
REACH = f"""{SPARSE}, links as (select resource_id, a, b from sparse union select resource_id, b, a from sparse),
reach as (select resource_id, a, a as b from links union select r.resource_id, r.a, l.b from reach r join links l on l.resource_id = r.resource_id and l.a = r.b),
labels as (select resource_id, a as entity_key, min(b) as community from reach group by all)"""
SIMILAR = "coalesce(len(list_intersect({0}, {1})) / nullif(len(list_distinct(list_concat({0}, {1}))), 0), 0)"
GRAPH = f"""gq as (select p_partkey as query_id, case when p_partkey % 100 = 0 then substring(p_type, 3, 6) else substring(p_name, 1, 7) || ' x' end as query from part where p_partkey % 50 = 0),
  gl as (select p_partkey as relationship_id, p_partkey % 40 as resource_id, upper(replace(substring(p_type, 1, 12), ' ', '_')) as kind, case when p_partkey % 4 = 0 then null else p_type end as description, p_name as source, p_brand as target from part),
  rels as (select query_id, relationship_id, resource_id, {SIMILAR.format(TRI.format("coalesce(description, '')"), TRI.format("query"))} as sim, {SIMILAR.format(TRI.format("kind"), TRI.format("query"))} as kind_sim,
    contains(lower(coalesce(description, '')), lower(query)) as d, contains(lower(kind), lower(query)) as t, contains(lower(source), lower(query)) or contains(lower(target), lower(query)) as e from gl, gq),
  rel_scored as (select query_id, relationship_id, resource_id, greatest(sim, kind_sim, case when d then 1 else 0 end, case when e then 0.8 else 0 end) as score from rels where sim > 0.1 or d or t or e),
  rel_top as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, relationship_id) as int) as rank from rel_scored) where rank <= 5),
  sums as (select query_id, p_partkey as summary_id, p_partkey % 40 as resource_id, {SIMILAR.format(TRI.format("(p_name || ' ' || p_type)"), TRI.format("query"))} as score, contains(lower(p_name || ' ' || p_type), lower(query)) as d from part, gq),
  sum_top as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, summary_id) as int) as rank from sums where score > 0.1 or d) where rank <= 5),
  ents as (select query_id, entity_key, greatest({SIMILAR.format(TRI.format("entity_key"), TRI.format("query"))}, case when contains(lower(entity_key), lower(query)) then 1 else 0 end) as score from (select distinct p_name as entity_key from part), gq),
  ent_top as (select * from (select *, cast(row_number() over (partition by query_id order by score desc, entity_key) as int) as rank from ents where score > 0.1) where rank <= 5),
  near as (select query_id, p_partkey % 40 as resource_id from ent_top join part on p_name = entity_key union select query_id, resource_id from rel_top union select query_id, resource_id from sum_top),
  chunk_top as (select * from (select query_id, p_partkey as chunk_id, cast(row_number() over (partition by query_id order by p_size, p_partkey) as int) as rank from near join part on p_partkey % 40 = resource_id) where rank <= 5)"""
LINKED = f"""edges as (select l_orderkey % 20 as resource_id, l_orderkey as chunk_id, {KEY.format(MENTION)} as source_key, 'part ' || (l_suppkey % 45) as target_key,
  case when l_tax > 0.04 then 'SOLD_WITH' else 'RELATED_TO' end as relationship_type, l_tax as confidence from lineitem),
linked as (select resource_id, source_key, target_key, relationship_type, count(*) as mention_count, count(distinct chunk_id) as chunk_count, max(confidence) as confidence from edges e
  where source_key <> target_key and (resource_id, source_key) in (select resource_id, entity_key from entities) and (resource_id, target_key) in (select resource_id, entity_key from entities) group by all)"""
REPAIRED = "j"
for wrong, right in P.JOINED.items():
    REPAIRED = rf"regexp_replace({REPAIRED}, '\b{wrong}\b', '{right}', 'g')"
ORACLES = {
    "relationship_search": f"with {GRAPH} select query_id, relationship_id, round(score, 6) as score, rank from rel_top",
    "summary_search": f"with {GRAPH} select query_id, summary_id, round(score, 6) as score, rank from sum_top",
    "graph_search": f"""with {GRAPH} select query_id, 'entities' as kind, entity_key as id, rank from ent_top union all select query_id, 'relationships', cast(relationship_id as varchar), rank from rel_top
      union all select query_id, 'summaries', cast(summary_id as varchar), rank from sum_top union all select query_id, 'chunks', cast(chunk_id as varchar), rank from chunk_top""",
    "graph_entities": f"with {MENTIONS} select * from entities",
    "graph_relationships": f"with {MENTIONS}, {LINKED} select * from linked",
    "graph_facts": f"""with {MENTIONS}, {LINKED},
      ent as (select resource_id, cast(to_json(list({{entity_key: entity_key, name: name, entity_type: entity_type, chunk_count: chunk_count}} order by n)) as varchar) as entities
        from (select *, row_number() over (partition by resource_id order by entity_key) as n from entities) where n <= {G.FACT_ENTITIES} group by resource_id),
      rel as (select resource_id, cast(to_json(list({{source_key: source_key, target_key: target_key, relationship_type: relationship_type, mention_count: mention_count}} order by n)) as varchar) as relationships
        from (select *, row_number() over (partition by resource_id order by source_key, target_key, relationship_type) as n from linked) where n <= {G.FACT_RELATIONSHIPS} group by resource_id)
      select resource_id, entities, coalesce(relationships, '[]') as relationships from ent left join rel using (resource_id)""",
    "graph_from_text": rf"""with named as (select doc_id, regexp_extract_all(text, '[\p{{Ll}},;] (\p{{Lu}}[\p{{L}}''-]{{2,}}(?: \p{{Lu}}[\p{{L}}''-]{{2,}})*)', 1) as names from documents),
      mentions as (select doc_id, unnest(names) as name, generate_subscripts(names, 1) as position from named),
      keyed as (select doc_id, {KEY.format("name")} as source_key, lead({KEY.format("name")}) over (partition by doc_id order by position) as target_key from mentions)
      select doc_id as resource_id, count(distinct (source_key, target_key)) as edges, count(*) as mentions from keyed where source_key <> target_key and source_key <> '' and target_key <> '' group by doc_id""",
    "embedded_chunks": rf"""with {chunk_plans.KEPT}, context as (select k.*, c.section_title from kept k join (select doc_id, chunk_text, min(section_title) as section_title from chunks group by all) c using (doc_id, chunk_text)),
      hashed as (select doc_id, chunk_index, sha256('Title: document ' || doc_id || case when coalesce(section_title, '') <> '' then chr(10) || 'Section: ' || section_title else '' end || chr(10) || chr(10)
        || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(chunk_text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', ' ', 'g'), '(?i)\[Page\s+\d+\]', ' ', 'g'), '(?i)\bdocument ' || doc_id || '\b\s*\d*', ' ', 'g'), '\s+', ' ', 'g'))) as h from context)
      select doc_id, chunk_index, round(list_sum(list_transform(range(0, 16), lambda i: cast('0x' || substring(h, 2 * i + 1, 2) as int) / 255)), 6) as total, cast(null as varchar) as error from hashed""",
    "routed_questions": """select c_custkey, case c_custkey % 9 when 0 then 'get_books_by_author' when 1 then 'search_users' when 2 then 'search_subscriptions' when 3 then 'search_approval_requests' when 4 then 'get_tags'
        when 5 then 'get_books_by_genre' when 6 then 'search_authors' when 7 then 'search_catalog_resources' end as tool, case c_custkey % 9 when 4 then 'hints' when 8 then null else 'rule' end as chosen_by,
      replace(case c_custkey % 9 when 0 then '{"author":"@"}' when 1 then '{"q":"@","status":"ACTIVE"}' when 2 then '{"tier":"PREMIUM","q":"for @"}' when 3 then '{"q":"@","status":"PENDING"}'
        when 5 then '{"genre":"@"}' when 6 then '{"status":"ACTIVE","q":"@"}' when 7 then '{"q":"about @"}' end, '@', c_name) as arguments from customer""",
    "cleaned_documents": rf"""with whole as (select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '[\x{{F000}}-\x{{F8FF}}]', '', 'g'), '(?im)^(\[Page\s+\d+\])$', chr(1) || '\1', 'g'), chr(1)), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '') as pages from documents),
      paged as (select doc_id, len(pages) as n, unnest(pages) as body, generate_subscripts(pages, 1) as page from whole),
      cut as (select doc_id, n, page, list_transform(string_split_regex(body, '\r\n|[\n\r\x0B\x0C\x1C-\x1E]'), lambda l: regexp_replace(l, '^\s+|\s+$', '', 'g')) as ls from paged),
      lines as (select doc_id, n, page, unnest(ls) as l, generate_subscripts(ls, 1) as line from cut),
      keyed as (select *, lower(regexp_replace(l, '\s+', ' ', 'g')) as k from lines),
      told as (select *, l = '' or regexp_matches(l, '{P.MARKER}') as plain, list_bool_or(list_transform({chunk_plans._list(P.BOILERPLATE_LINES)}, lambda p: contains(k, p))) as boiler,
        length(k) <= {P.HEADER_CHARS} and len(string_split(k, ' ')) <= {P.HEADER_WORDS} as short from keyed),
      running as (select doc_id, k from told where n >= {P.LEAST_PAGES} and short and not plain and not boiler group by doc_id, n, k having count(distinct page) >= greatest({P.LEAST_PAGES}, floor(n * {P.HEADER_SHARE}))),
      judged as (select t.*, case when plain then 'keep' when r.k is not null then 'repeated' when boiler then 'boilerplate' when regexp_full_match(t.k, '\d{{1,4}}') and try_cast(t.k as int) between 1 and greatest(n + 5, 10) then 'number' else 'keep' end as what
        from told t left join running r on r.doc_id = t.doc_id and r.k = t.k),
      bodies as (select doc_id, page, regexp_replace(regexp_replace(coalesce(string_agg(case when what = 'keep' then l end, chr(10) order by line), ''), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') as body,
        count_if(what = 'repeated') as r, count_if(what = 'boilerplate') as b, count_if(what = 'number') as p from judged group by doc_id, page),
      docs as (select doc_id, coalesce(string_agg(case when body <> '' then body end, chr(10) || chr(10) order by page), '') as t, sum(r) as r, sum(b) as b, sum(p) as p from bodies group by doc_id),
      joined as (select *, regexp_replace(regexp_replace(regexp_replace(t, '([A-Za-z])-\s*\n\s*([a-z])', '\1\2', 'g'), '\b([A-Za-z]{{3,}})-\s+([a-z]{{2,}})\b', '\1\2', 'g'), '(?m)(^|\n)([A-Z])\s*\n+\s*([a-z][^\n]*)', '\1\2\3', 'g') as j from docs)
      select doc_id, coalesce(regexp_replace({REPAIRED}, '^\s+|\s+$', '', 'g'), '') as text, cast(coalesce(r, 0) as bigint) as repeated_lines, cast(coalesce(b, 0) as bigint) as boilerplate_lines, cast(coalesce(p, 0) as bigint) as page_number_lines,
        cast(coalesce(len(regexp_extract_all(j, '\b({"|".join(P.JOINED)})\b')), 0) as int) as joined_words from whole left join joined using (doc_id)""",
    "graph_communities": f"with recursive {REACH} select * from labels",
    "graph_summaries": f"""with recursive {REACH}, named as (select resource_id, community, count(*) as entity_count, list_slice(list_sort(list(upper(entity_key))), 1, 8) as names from labels group by all)
      select resource_id, community, entity_count, array_to_string(list_slice(names, 1, 3), ', ') as name, 'Related graph cluster containing ' || array_to_string(names, ', ') || '.' as summary from named""",
    "entity_search": f"""with names as (select distinct p_name as entity_key, {TRI.format("p_name")} as t from part), queries as (select p_partkey as query_id, substring(p_name, 1, 6) || ' x' as query from part where p_partkey % 50 = 0),
      asked as (select *, {TRI.format("query")} as q from queries),
      scored as (select query_id, entity_key, greatest(len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q))), case when contains(lower(entity_key), lower(query)) then 1 else 0 end) as score from names, asked)
      select query_id, entity_key, round(score, 6) as score, rank from (select *, cast(row_number() over (partition by query_id order by score desc, entity_key) as int) as rank from scored where score > 0.1) where rank <= 5""",
    "related_chunks": "select doc_id as chunk_id, source as resource_id, doc_id % 13 as chunk_index, left(text, 700) as snippet from documents where source = 'src3' or doc_id % 50 = 7 order by doc_id % 13, doc_id limit 60",
    "faithfulness": f"with {VERDICT} select conv_id, turn, reason = 'answer_citations_match_selected_context' as supported, reason, overlap from verdicts",
    "answer_status": f"with {VERDICT} select case when reason = 'answer_citations_match_selected_context' then 'answered' else 'insufficient_context' end as status, count(*) as n from verdicts group by all",
    "answer_events": "select item_id as query_id, unnest([0, 1, 2, 3]) as seq, unnest(['start', r, r, 'done']) as event from (select item_id, case when item_id % 3 > 0 then 'result' else 'error' end as r from benchmark)",
    "page_texts": r"""with a as (select page_id, regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', ' ', 'g') as t from pages),
      b as (select page_id, regexp_replace(regexp_replace(regexp_replace(t, '(?is)<script\b[^>]*>.*?(</script\s*>|\z)', ' ', 'g'), '(?is)<style\b[^>]*>.*?(</style\s*>|\z)', ' ', 'g'), '(?is)<nav\b[^>]*>.*?(</nav\s*>|\z)', ' ', 'g') as t from a),
      c as (select page_id, regexp_replace(t, '<[^>]*>', ' ', 'g') as t from b)
      select page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) as text from c""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "grounded_answers")}
