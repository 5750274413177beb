"""Queries over the text of documents and their chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.operators import chunking as K

from .roles import table

SIZE, OVERLAP = 120, 8


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _chunks(spark, sf_dir):
    return K.recursive_chunks(_docs(spark, sf_dir), SIZE, OVERLAP)


def text_measures(spark, sf_dir):
    """Tokens, hash, meaningful words, ratios of every document."""
    return _docs(spark, sf_dir).select(
        "doc_id",
        T.token_count("text").alias("token_count"),
        F.sha2("text", 256).alias("text_hash"),
        F.size(T.meaningful("text")).alias("meaningful"),
        F.round(T.alpha_ratio("text"), 6).alias("alpha_ratio"),
        F.round(T.digit_ratio("text"), 6).alias("digit_ratio"),
        T.numeric_table("text").alias("numeric_table"),
        (T.phrases_in(F.lower("text"), K.BOILERPLATE) > 0).alias("boilerplate"),
    )


def text_cleaned(spark, sf_dir):
    """Cleaned chunk text, display text, keys of all lines."""
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.cleaned_chunk("text"), 256).alias("cleaned"), F.length(T.display("text")).alias("display_chars"), F.sha2(F.array_join(F.transform(F.split("text", "\n", -1), T.line_key), "\n"), 256).alias("line_keys"))


def search_terms(spark, sf_dir):
    """Distinct search terms and the normalised beginning of every conversation's turns."""
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(F.array_sort(F.array_distinct(T.search_terms("text"))), " ").alias("terms"), F.length(T.normalised("text")).alias("normalised_chars"))


def snippets(spark, sf_dir):
    """Snippets of documents around the words of a query."""
    return _docs(spark, sf_dir).select("doc_id", T.snippet("text", F.lit("license password theth"), 120).alias("snippet"))


def sections(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.posexplode(K.sections("text")).alias("section", "s")).select("doc_id", "section", F.col("s.title").alias("title"), F.size(T.words("s.body")).alias("n_words"))


def recursive_chunks(spark, sf_dir):
    return _chunks(spark, sf_dir).select("doc_id", "chunk_index", "section_title", "token_count", "char_count", "chunk_hash")


def chunk_classes(spark, sf_dir):
    return K.classified(_chunks(spark, sf_dir)).groupBy("quality", "searchable", "front_matter", "boilerplate").agg(F.count("*").alias("n"), F.sum("meaningful").alias("meaningful"))


def kept_chunks(spark, sf_dir):
    """Chunks worth storing, with their texts."""
    return K.quality_chunks(_chunks(spark, sf_dir))


def quality_chunks(spark, sf_dir):
    return kept_chunks(spark, sf_dir).select("doc_id", "chunk_index", "token_count", "chunk_hash", "quality")


def chunk_diagnostics(spark, sf_dir):
    return K.diagnostics(K.quality_chunks(_chunks(spark, sf_dir)))


def semantic_chunks(spark, sf_dir):
    """Paragraph groups, classified, small ones merged."""
    return K.chunked(_docs(spark, sf_dir), "SEMANTIC_RECURSIVE", SIZE, OVERLAP)


def recursive_merged(spark, sf_dir):
    return K.chunked(_docs(spark, sf_dir), "INTELLIGENT_RECURSIVE", SIZE, OVERLAP)


def _list(phrases) -> str:
    return "[" + ", ".join("'" + p.replace("'", "''") + "'" for p in phrases) + "]"


TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
MEANINGFUL = "len(list_filter(regexp_extract_all({0}, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda w: not regexp_full_match(w, '[ivxlcdmIVXLCDM]+') and length(trim(w, '''-')) >= 3))"
VISIBLE = r"nullif(length(regexp_replace({0}, '\s+', '', 'g')), 0)"
COUNT = "(len(regexp_extract_all({0}, '{1}')))"
TABLE_HEAVY = (
    r"(coalesce(" + COUNT.format("{0}", r"\p{{Nd}}") + " / " + VISIBLE + " >= 0.25, false) and ((length({0}) - length(replace({0}, '|', ''))) + (length({0}) - length(replace({0}, chr(9), '')))"
    r" + (length({0}) - length(replace({0}, '  ', ''))) // 2 + (length({0}) - length(replace({0}, ',', ''))) + (length({0}) - length(replace({0}, ';', ''))) + (length({0}) - length(replace({0}, ':', ''))) >= 3"
    r" or len(regexp_extract_all({0}, '\b[A-Z]{{1,6}}[-_/]?\d{{2,}}\b|\b\d+[A-Z]+[-_/]?\d*\b')) >= 2))"
)
STOP = _list(T.STOP_WORDS)
TERMS = f"""list_transform(list_filter(list_transform(regexp_extract_all({{0}}, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda w: lower(trim(w, '''-'))),
  lambda w: length(w) >= 3 and not list_contains({STOP}, w)), lambda w: coalesce(map({_list(T.ALIASES)}, {_list(T.ALIASES.values())})[w], w))"""
HEADING = r"""(length(l) <= 120 and not regexp_full_match(l, '\p{L}') and (starts_with(l, '#') or (upper(l) = l and lower(l) <> l)
  or (ends_with(l, ':') and len(list_filter(string_split_regex(trim(l, '#: '), '\s+'), lambda w: w <> '')) between 1 and 4 and not regexp_matches(trim(l, '#: '), '[,;?!—]')
    and not (lower(substring(trim(l, '#: '), 1, 1)) = substring(trim(l, '#: '), 1, 1) and upper(substring(trim(l, '#: '), 1, 1)) <> substring(trim(l, '#: '), 1, 1)))))"""
SECTIONS = rf"""
lines as (select doc_id, i, regexp_replace(line, '^\s+|\s+$', '', 'g') as l from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as i from documents)),
marked as (select *, case when l <> '' and {HEADING} then 1 else 0 end as h from lines),
numbered as (select *, sum(h) over (partition by doc_id order by i) as s from marked),
bodies as (select doc_id, s, max(case when h = 1 then trim(l, '#: ') end) as title, string_agg(case when h = 0 then l else '' end, chr(10) order by i) as body from numbered group by doc_id, s),
sections as (select doc_id, row_number() over (partition by doc_id order by s) - 1 as section, title, list_filter(string_split_regex(body, '\s+'), lambda w: w <> '') as words from bodies where trim(body, chr(10)) <> '')"""
CHUNKS = rf"""{SECTIONS},
windows as (select doc_id, section, title, w, array_to_string(list_slice(words, w * {SIZE - OVERLAP} + 1, w * {SIZE - OVERLAP} + {SIZE}), ' ') as chunk_text
  from (select *, unnest(generate_series(0, greatest(0, cast(ceil((len(words) - {SIZE}) / {float(SIZE - OVERLAP)}) as int)))) as w from sections)),
firsts as (select *, row_number() over (partition by doc_id, chunk_text order by section, w) as nth from windows where chunk_text <> ''),
chunks as (select doc_id, cast(row_number() over (partition by doc_id order by section, w) - 1 as int) as chunk_index, title as section_title, chunk_text from firsts where nth = 1)"""
LOW = r"lower(trim(regexp_replace(chunk_text, '\s+', ' ', 'g')))"
CLASSES = rf"""{CHUNKS},
flat as (select *, trim(regexp_replace(chunk_text, '\s+', ' ', 'g')) as t, {LOW} as low from chunks),
measured as (select *, {MEANINGFUL.format("t")} as meaningful, list_bool_or(list_transform({_list(K.BOILERPLATE)}, lambda p: contains(low, p))) as boilerplate,
  chunk_index <= 5 and list_bool_or(list_transform({_list(K.FRONT_MATTER)}, lambda p: contains(low, p))) as front_matter,
  chunk_index <= 5 and len(list_filter({_list(K.CONTENTS)}, lambda p: contains(low, p))) >= 2 as toc, {TABLE_HEAVY.format("t")} as numeric_table,
  {COUNT.format("t", r"\p{L}")} / {VISIBLE.format("t")} as alpha from flat),
stored as (select *, meaningful >= 5 and not (boilerplate and meaningful < 40 and not front_matter) and not (coalesce(alpha < 0.45, false) and not numeric_table) as store from measured),
classes as (select *, store and not (front_matter or toc) as searchable, case when not store then 'filtered' when toc then 'toc' when front_matter then 'front_matter' else 'searchable' end as quality from stored)"""
KEPT = rf"""{CLASSES},
once as (select *, row_number() over (partition by doc_id, chunk_text order by chunk_index) as again from classes where store),
kept as (select doc_id, cast(row_number() over (partition by doc_id order by chunk_index) - 1 as int) as chunk_index, chunk_text, quality, cast(len(regexp_extract_all(chunk_text, '{TOKEN}')) as int) as token_count from once where again = 1)"""

ORACLES = {
    "text_measures": rf"""select doc_id, cast(len(regexp_extract_all(text, '{TOKEN}')) as int) as token_count, sha256(text) as text_hash, cast({MEANINGFUL.format("text")} as int) as meaningful,
      round({COUNT.format("text", r"\p{L}")} / {VISIBLE.format("text")}, 6) as alpha_ratio, round({COUNT.format("text", r"\p{Nd}")} / {VISIBLE.format("text")}, 6) as digit_ratio,
      {TABLE_HEAVY.format("text")} as numeric_table, list_bool_or(list_transform({_list(K.BOILERPLATE)}, lambda p: contains(lower(text), p))) as boilerplate from documents""",
    "text_cleaned": r"""select doc_id, sha256(array_to_string(list_filter(list_transform(string_split(regexp_replace(text, '(?i)\[Page\s+\d+\]', ' ', 'g'), chr(10)), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))) as cleaned,
      cast(length(trim(regexp_replace(regexp_replace(text, '(?i)\[Page\s+\d+\]', ' ', 'g'), '\s+', ' ', 'g'))) as int) as display_chars,
      sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda x: lower(trim(regexp_replace(x, '\s+', ' ', 'g')))), chr(10))) as line_keys from documents""",
    "search_terms": rf"""select conv_id, turn, array_to_string(list_sort(list_distinct({TERMS.format("text")})), ' ') as terms,
      cast(length(array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9][A-Za-z0-9''-]*'), lambda w: lower(trim(w, '''-'))), ' ')) as int) as normalised_chars from conversations""",
    "snippets": r"""with flat as (select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as t from documents),
      placed as (select *, case when regexp_matches(t, '(?i)license|password|theth') then length(regexp_extract(t, '(?is)^(.*?)(license|password|theth)', 1)) + 1 else 0 end as hit from flat),
      cut as (select *, greatest(hit - 1 - 40, 0) as s, least(greatest(hit - 1 - 40, 0) + 120, length(t)) as e from placed)
      select doc_id, case when length(t) <= 120 then t when hit > 0 then case when s > 0 then '...' else '' end || trim(substring(t, s + 1, e - s)) || case when e < length(t) then '...' else '' end
        else rtrim(substring(t, 1, 117)) || '...' end as snippet from cut""",
    "sections": f"with {SECTIONS} select doc_id, cast(section as int) as section, title, cast(len(words) as int) as n_words from sections",
    "recursive_chunks": f"with {CHUNKS} select doc_id, chunk_index, section_title, cast(len(regexp_extract_all(chunk_text, '{TOKEN}')) as int) as token_count, cast(length(chunk_text) as int) as char_count, sha256(chunk_text) as chunk_hash from chunks",
    "chunk_classes": f"with {CLASSES} select quality, searchable, front_matter, boilerplate, count(*) as n, cast(sum(meaningful) as bigint) as meaningful from classes group by all",
    "quality_chunks": f"with {KEPT} select doc_id, chunk_index, token_count, sha256(chunk_text) as chunk_hash, quality from kept",
    "chunk_diagnostics": f"""with {KEPT}, classes_of as (select doc_id, quality, count(*) as n from kept group by all)
      select doc_id, count(*) as chunks, min(token_count) as min_tokens, max(token_count) as max_tokens, round(avg(token_count), 2) as avg_tokens,
        (select string_agg(quality || '=' || n, ',' order by quality) from classes_of c where c.doc_id = k.doc_id) as by_class from kept k group by doc_id""",
}
QUERIES = {name: globals()[name] for name in (*ORACLES, "semantic_chunks", "recursive_merged")}
