"""Queries of full-text search, catalog tools, registration and stored stages."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioflow.functions import table_functions
from folioflow.operators import fulltext as X
from folioflow.operators import paths
from folioflow.operators import registration as G
from folioflow.operators import search as S
from folioflow.operators import tools as L
from folioflow.operators.chunking import sections
from folioflow.operators.metrics import Stages
from folioflow.sources import sse, web
from folioflow.sources.scratch import shared_folder

from .chunks import CHUNKS, OVERLAP, SIZE, TOKEN
from .roles import resource_authors, resource_tags, role, table, with_roles
from .search import document_chunks, text_index


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"))


def fulltext_index(spark, sf_dir):
    """Terms of the index, without stems: documents and places of each."""
    return X.index(_docs(spark, sf_dir), stemmed=False).groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.size("positions")).alias("places"), F.max(F.element_at("positions", -1)).alias("last_place"))


def _queries(spark, sf_dir):
    """The first words of passages: all of them, or as a phrase, or either of two, or without a third."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(X.WORD), F.lit(0))
    w = lambda i: F.get(words, F.lit(i))
    kind = F.col("item_id") % 4
    query = F.when(kind == 0, F.concat_ws(" ", w(0), w(1))).when(kind == 1, F.concat(F.lit('"'), w(0), F.lit(" "), w(1), F.lit('"'))).when(kind == 2, F.concat(w(1), F.lit(" or "), w(4))).otherwise(F.concat(w(1), F.lit(" -"), w(2)))
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), query.alias("query"))


def fulltext_matches(spark, sf_dir):
    """Documents of each query, without stems."""
    return X.search(X.index(_docs(spark, sf_dir), stemmed=False), X.parsed(_queries(spark, sf_dir), stemmed=False)).groupBy("query_id").agg(F.count("*").alias("n"), F.min("chunk_id").alias("first_id"), F.max("chunk_id").alias("last_id"))


def fulltext_search(spark, sf_dir):
    """Passages as phrases over stems, ranked by cover density."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit(True).alias("exact"))
    return text_index(spark, sf_dir).matches(X.parsed(asked, "exact"))


def chunk_function(spark, sf_dir):
    """Chunks by the table function, called in SQL over the documents' sections."""
    _docs(spark, sf_dir).select(F.col("chunk_id").alias("doc_id"), F.posexplode(sections(F.coalesce("chunk_text", F.lit("")))).alias("section", "s")).selectExpr("doc_id", "section", "s.title as title", "s.body as body").createOrReplaceTempView("document_sections")
    table_functions.register(spark)
    return spark.sql(f"select doc_id, chunk_index, section_title, token_count, chunk_hash from chunks_of(table(document_sections) partition by doc_id order by (section), {SIZE}, {OVERLAP})")


def search_functions(spark, sf_dir):
    """Searches of the catalog as table functions."""
    table_functions.register(spark, _library(spark, sf_dir).tables)
    return spark.sql(
        """select 'genre' as search, cast(resource_id as string) as id, title as name from books_by_genre('NATION_7', 5, 3) union all select 'tag', cast(resource_id as string), title from books_by_tag('steel', 8)
        union all select 'user', cast(user_id as string), username from users_named('0011') union all select 'author', cast(author_id as string), author_name from authors_named('007', 30)"""
    )


def event_source(spark, sf_dir):
    """Turns as server-sent events: written by the data source, and read back by it."""
    sse.register(spark)
    folder = f"{shared_folder(spark)}/events-{uuid.uuid4().hex}".removeprefix("file:")
    turns = table(spark, sf_dir, "conversations")
    turns.select(F.col("role").alias("event"), F.to_json(F.struct("conv_id", "turn", F.sha2("text", 256).alias("digest"))).alias("data")).write.format("sse").mode("append").save(folder)
    found = spark.read.format("sse").load(folder).select("event", F.from_json("data", "conv_id long, turn long, digest string").alias("d"))
    return found.select("d.conv_id", "d.turn", F.col("event").alias("role"), "d.digest")


def contained_metadata(spark, sf_dir):
    """Events whose properties hold a request, numbers as numbers: a request for every value up to 99, and the same as texts."""
    events = table(spark, sf_dir, "events").select("event_id", "props")
    asked = spark.range(100).select(F.col("id").alias("query_id"), F.concat(F.lit('{"k": '), F.when(F.col("id") % 10 == 9, F.concat(F.lit('"'), "id", F.lit('"'))).otherwise(F.col("id").cast("string")), F.lit("}")).alias("wanted"))
    return paths.containing(events, asked, "event_id", "props")


REPORTS = """select c_nationkey % 5 as project, case when c_nationkey % 5 = 4 then '<testsuites><testsuite' when c_nationkey % 5 = 3 then concat('<coverage line-rate="', cast(count(*) % 100 as varchar(10)), 'e-2"/>')
  else concat('<testsuites>', '<testsuite tests="', cast(count(*) as varchar(10)), '" failures="', cast(count(*) % 7 as varchar(10)), '" errors="0" time="1.5"/>', '<testsuite tests="2" skipped="1"/>', '</testsuites>') end as report
  from customer group by c_nationkey"""


def ci_reports(spark, sf_dir):
    """XML reports made of customers' counts: two suites each, coverage for some, one that is cut off."""
    table(spark, sf_dir, "customer").createOrReplaceTempView("ci_customers")
    return web.ci_reports(spark.sql(REPORTS.replace("from customer", "from ci_customers"))).groupBy("project", "metric", "source").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def search_metrics(spark, sf_dir):
    """Rows of each stage of a hybrid search, as profiling rows tell them."""
    stages = Stages()
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    S.hybrid(document_chunks(spark, sf_dir), passages, 10, index=text_index(spark, sf_dir), stages=stages)
    return stages.rows(spark, "search").select("event_index", "name", F.col("details")["rows"].cast("long").alias("n_rows"), (F.col("ms") > 0).alias("timed"))


def _library(spark, sf_dir) -> L.Library:
    authors_of = resource_authors(spark, sf_dir).join(role(spark, sf_dir, "authors"), "author_id").select("resource_id", "author_name")
    names = {"resources": "resources", "categories": "categories", "authors": "authors", "users": "users", "subscriptions": "subscriptions", "subscription_tiers": "tiers"}
    tables = {name: role(spark, sf_dir, r) for name, r in names.items()} | {"resource_tags": resource_tags(spark, sf_dir), "resource_authors": resource_authors(spark, sf_dir)}
    return L.Library(tables, authors_of, resource_tags(spark, sf_dir))


def tool_calls(spark, sf_dir):
    """Rows that several tools give, counted by tool."""
    library = _library(spark, sf_dir)
    calls = [("get_books_by_tag", {"tag": "bolt", "limit": 100}), ("get_books_by_author", {"author": "#000000001", "limit": 7, "offset": 2}), ("get_available_facets", {}), ("search_users", {"q": "00012", "status": "active", "limit": 50}), ("get_categories", {"limit": 10, "offset": 20}), ("get_resource_detail", {"resource_id": 7})]
    parts = [L.call(library, tool, **args).agg(F.count("*").alias("n")).select(F.lit(tool).alias("tool"), "n") for tool, args in calls]
    return G.union_of(*parts)


def books_by_genre(spark, sf_dir):
    return L.call(_library(spark, sf_dir), "get_books_by_genre", genre="nation_2", limit=30, offset=3).select("resource_id", "title", "category", F.array_join("tags", "|").alias("tags"))


def registrations(spark, sf_dir):
    """Customers asking to be users, some twice, some with unknown tiers."""
    asking = table(spark, sf_dir, "customer").selectExpr("c_name as full_name", "case when c_custkey % 4 = 0 then 'SAME@X.ORG' else concat(c_name, '@x.org') end as email", "concat('a', cast(c_custkey as varchar(20))) as account_id", "case when c_custkey % 5 = 0 then 'NONE' else 'ASIA' end as tier_code")
    users = table(spark, sf_dir, "customer").where("c_custkey % 7 = 0").selectExpr("lower(concat(c_name, '@X.org')) as email", "cast(null as string) as account_id")
    accepted, _, _, refused = G.registered(asking, users, role(spark, sf_dir, "tiers"))
    return accepted.select(F.lit("accepted").alias("outcome")).unionByName(refused.select(F.col("reason").alias("outcome"))).groupBy("outcome").agg(F.count("*").alias("n"))


def metadata_rows(spark, sf_dir):
    """New lookup rows and bridges from parts as metadata, counted."""
    metadata = table(spark, sf_dir, "part").selectExpr(
        "p_partkey as resource_id", "case when p_size % 2 = 0 then concat(' ', p_name, '  x ') else ' ' end as title", "concat(p_name, '.txt') as file_name", "case when p_size % 3 = 0 then '' else p_type end as category_name",
        "concat('genre ', cast(p_size % 4 as varchar(5))) as genre", "p_brand as author", "array(p_name, upper(p_name), p_type, ' ') as tags", "cast(null as string) as language", "p_brand as publisher",
    )
    known = table(spark, sf_dir, "part").where("p_partkey < 5")
    found = G.persisted_metadata(metadata, known.select(F.col("p_type").alias("category_name")), known.select(F.col("p_brand").alias("author_name")), known.select(F.col("p_name").alias("tag_name")))
    return G.union_of(*(rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, rows in found.items()))


STOP = "[" + ", ".join(f"'{w}'" for w in X.STOP) + "]"
PLACED = f"""placed as (select doc_id, w, p - 1 as p from (select doc_id, unnest(ws) as w, generate_subscripts(ws, 1) as p from (select doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as ws from documents)) where not list_contains({STOP}, w))"""
ASKED = """asked as (select item_id, item_id % 4 as kind, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as ws from benchmark)"""


def _matches() -> str:
    has = lambda i: f"exists (select 1 from placed p where p.doc_id = d.doc_id and p.w = ws[{i}])"
    kept = lambda i: f"not list_contains({STOP}, ws[{i}])"
    # A stop word asks for nothing; a query of stop words only, or an alternative of them, matches nothing.
    both = f"({kept(1)} or {kept(2)}) and (not {kept(1)} or {has(1)}) and (not {kept(2)} or {has(2)})"
    pair = f"({kept(1)} or {kept(2)}) and case when {kept(1)} and {kept(2)} then exists (select 1 from placed p join placed q on p.doc_id = q.doc_id and q.p = p.p + 1 where p.doc_id = d.doc_id and p.w = ws[1] and q.w = ws[2]) when {kept(1)} then {has(1)} else {has(2)} end"
    either = f"({kept(2)} and {has(2)}) or ({kept(5)} and {has(5)})"
    without = f"{kept(2)} and {has(2)} and not ({kept(3)} and {has(3)})"
    return f"case kind when 0 then {both} when 1 then {pair} when 2 then {either} else {without} end"


ORACLES = {
    "fulltext_index": f"with {PLACED} select w as term, count(distinct doc_id) as docs, count(*) as places, cast(max(p) as int) as last_place from placed group by w",
    "fulltext_matches": f"with {PLACED}, {ASKED} select item_id as query_id, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from asked, documents d where {_matches()} group by item_id",
    "tool_calls": with_roles(
        """, bolts as (select count(*) as n from resources r where status = 'ACTIVE' and exists (select 1 from resource_tags t where t.resource_id = r.resource_id and tag_name ilike '%bolt%')),
          firsts as (select count(*) as n from resources r where status = 'ACTIVE' and exists (select 1 from resource_authors a join authors using (author_id) where a.resource_id = r.resource_id and author_name ilike '%#000000001%'))
        select 'get_books_by_tag' as tool, least(n, 100) as n from bolts union all select 'get_books_by_author', greatest(least(n - 2, 7), 0) from firsts
        union all select 'get_available_facets', (select count(*) from categories where status = 'ACTIVE') + (select count(*) from authors where status = 'ACTIVE') + (select count(distinct tag_name) from resource_tags)
          + (select count(distinct language) from resources where language <> '') + (select count(*) from tiers where status = 'ACTIVE')
        union all select 'search_users', least(count(*), 50) from users where status = 'ACTIVE' and (username ilike '%00012%' or email ilike '%00012%')
        union all select 'get_categories', greatest(least(count(*) - 20, 10), 0) from categories union all select 'get_resource_detail', count(*) from resources where resource_id = 7""",
        "resources",
        "categories",
        "authors",
        "users",
        "tiers",
        "resource_authors",
        "resource_tags",
    ),
    "books_by_genre": with_roles(
        """select resource_id, title, category_name as category, (select string_agg(tag_name, '|' order by tag_name) from resource_tags t where t.resource_id = r.resource_id) as tags
        from (select r.*, category_name from resources r join categories using (category_id) where r.status = 'ACTIVE' and category_name ilike '%nation_2%' order by title, created_at desc, resource_id limit 30 offset 3) r""",
        "resources",
        "categories",
        "resource_tags",
    ),
    "registrations": """with asking as (select c_custkey, case when c_custkey % 4 = 0 then 'same@x.org' else lower(c_name) || '@x.org' end as mail, c_custkey % 5 = 0 as no_tier from customer),
      told as (select *, row_number() over (partition by mail order by mail, 'a' || c_custkey) as nth, mail in (select lower(c_name) || '@x.org' from customer where c_custkey % 7 = 0) as known from asking)
      select case when no_tier then 'unknown tier' when known or nth > 1 then 'user exists' else 'accepted' end as outcome, count(*) as n from told group by all""",
    "metadata_rows": """with known as (select * from part where p_partkey < 5), named as (select *, case when p_size % 3 = 0 then 'genre ' || (p_size % 4) else p_type end as category from part),
      tags as (select distinct p_partkey, lower(t) as k, case when lower(t) = lower(p_type) and lower(t) <> lower(p_name) then p_type else p_name end as tag from (select p_partkey, p_name, p_type, unnest([p_name, p_type]) as t from part))
      select 'categories' as table_name, (select count(distinct category) from named where category not in (select p_type from known)) as n
      union all select 'authors', (select count(distinct p_brand) from part where p_brand not in (select p_brand from known)) union all select 'tags', (select count(distinct tag) from tags where tag not in (select p_name from known))
      union all select 'resource_authors', (select count(*) from part) union all select 'resource_tags', (select count(*) from tags) union all select 'resources', (select count(*) from part)""",
}
ORACLES |= {
    "chunk_function": f"with {CHUNKS} select doc_id, chunk_index, section_title, cast(len(regexp_extract_all(chunk_text, '{TOKEN}')) as int) as token_count, sha256(chunk_text) as chunk_hash from chunks",
    "search_functions": with_roles(
        """, genre as (select resource_id, title, row_number() over (order by title, resource_id) as nth from resources join categories using (category_id) where category_name = 'NATION_7'),
      tag as (select resource_id, title, row_number() over (order by title, resource_id) as nth from resources join resource_tags using (resource_id) where tag_name = 'steel'),
      named as (select user_id, username, row_number() over (order by username, user_id) as nth from users where contains(lower(username), '0011') or contains(lower(email), '0011')),
      writers as (select author_id, author_name, row_number() over (order by author_name, author_id) as nth from authors where contains(lower(author_name), '007'))
      select 'genre' as search, cast(resource_id as varchar) as id, title as name from genre where nth between 4 and 8 union all select 'tag', cast(resource_id as varchar), title from tag where nth <= 8
      union all select 'user', cast(user_id as varchar), username from named where nth <= 20 union all select 'author', cast(author_id as varchar), author_name from writers where nth <= 30""",
        "resources", "categories", "resource_tags", "users", "authors",
    ),
    "event_source": "select conv_id, turn, role, sha256(text) as digest from conversations",
    "contained_metadata": "select cast(v as bigint) as query_id, event_id from (select event_id, cast(props->>'$.k' as int) as v, json_type(props->'$.k') as kind from events) where kind in ('UBIGINT', 'BIGINT') and v between 0 and 99 and v % 10 <> 9",
    "ci_reports": f"""with reports as ({REPORTS}), told as (select project, 'corrupt' as metric, 'UNREADABLE' as source, cast(null as double) as value from reports where report like '%<testsuite'
      union all select project, 'coverage_percent', 'LOCAL_COVERAGE_XML', round(100 * cast(regexp_extract(report, 'line-rate="([^"]*)"', 1) as double), 2) from reports where report like '<coverage%'
      union all select project, m.metric, 'LOCAL_JUNIT_XML', m.value from (select project, unnest([{{'metric': 'tests', 'value': 2.0 + cast(regexp_extract(report, 'tests="([0-9]+)"', 1) as int)}}, {{'metric': 'test_failures', 'value': cast(regexp_extract(report, 'failures="([0-9]+)"', 1) as double)}},
        {{'metric': 'test_errors', 'value': 0.0}}, {{'metric': 'skipped_tests', 'value': 1.0}}, {{'metric': 'test_execution_time_ms', 'value': 1500.0}}]) as m from reports where report like '%</testsuites>'))
      select project, metric, source, count(*) as n, round(sum(value), 4) as total from told group by all""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "fulltext_search", "search_metrics")}
