"""Answers: sources picked and packed under a budget of characters, prompts, citations verified, models compared.

A question's sources are an array of at most `k` structs in its row, so packing and verifying are expressions of one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioflow.functions import text as T

MOST_CHARS, SOURCE_CHARS, LEAST_OVERLAP = 12_000, 1_800, 0.20

# What questions, answers and citations are read by.
CITATION = r"(?i)\[\s*Source\s+rank\s+(\d+)(?:[^\]]*?chunk\s+(\d+))?[^\]]*\]"
EVIDENCE_WORD = r"[A-Za-z][A-Za-z']{2,}"
EVIDENCE_STOP = (
    "and", "answer", "are", "but", "chunk", "context", "from", "has", "have", "his", "into", "not", "page", "rank", "she", "source", "that", "the", "their",
    "this", "was", "were", "with",
)
ANCHOR = r"\b[A-Z][A-Za-z']{2,}\b"
ANCHOR_STOP = ["How", "Tell", "What", "When", "Where", "Which", "Who", "Why"]
INFERENCE = ("can be inferred", "could be inferred", "it can be inferred", "might have", "may have", "probably", "likely", "not directly mentioned", "not explicitly mentioned")
FOCUS_STOP = (
    "about", "from", "have", "that", "tell", "there", "this", "what", "when", "where", "which", "with",
)
FOCUS_NAMES = ["brenton", "brunton", "maharshi", "paul", "ramana"]
IMPRESSION = {"impress": 4, "perceiv": 4, "reactio": 3, "peace": 3, "quiet": 3, "restful": 2}
NO_CONTEXT = "I could not find enough retrieved context to answer this question without guessing."


def quoted(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def focus_weights(query: Column, intent: Column) -> Column:
    """map<stem, weight>: seven letters of each word of four and more; names weigh 1, exact quotes at least 4."""
    terms = F.filter(T.found(F.lower(query), r"[A-Za-z][A-Za-z']+"), lambda w: (F.length(w) >= 4) & ~F.array_contains(quoted(FOCUS_STOP), w))
    own = F.transform(terms, lambda w: F.struct(F.substring(w, 1, 7).alias("stem"), F.when(F.array_contains(quoted(FOCUS_NAMES), w), 1).otherwise(3).alias("weight")))
    low = F.lower(query)
    extra = F.when(low.contains("impression") | low.contains("perceiv"), F.array(*(F.struct(F.lit(s).alias("stem"), F.lit(w).alias("weight")) for s, w in IMPRESSION.items()))).otherwise(F.array().cast("array<struct<stem:string,weight:int>>"))
    # Later entries count: a stem's last word, then the words of impression.
    last = F.aggregate(F.concat(own, extra), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<int>")), lambda m, e: F.map_concat(F.map_filter(m, lambda k, v: k != e["stem"]), F.create_map(e["stem"], e["weight"])))
    stems = F.transform(terms, lambda w: F.substring(w, 1, 7))
    return F.transform_values(last, lambda k, v: F.when((intent == "exact_quote") & F.array_contains(stems, k), F.greatest(v, F.lit(4))).otherwise(v))


def focus_score(text: Column, weights: Column) -> Column:
    hits = F.filter(F.map_entries(weights), lambda e: F.contains(F.lower(text), e["key"]))
    return F.aggregate(hits, F.lit(0), lambda s, e: s + e["value"])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: expressions inside lambdas are computed wherever they stand."""
    return F.element_at(F.transform(F.array(value), body), 1)


def excerpt(text: Column, weights: Column, limit: Column) -> Column:
    """The text if it fits, else the sentences around the one of greatest weight, else a window of characters at its start."""

    def around(flat: Column, sentences: Column, best: Column) -> Column:
        first = F.greatest(F.lit(1), best - 2)
        near = T.stripped(F.array_join(F.slice(sentences, first, best + 4 - first), ""))
        # Sentences leave out marks that stand alone, so their start is looked up in the text.
        begin = F.instr(flat, F.element_at(sentences, best)) - 1 - F.floor(limit / 3).cast("int")
        end = F.least(F.length(flat), F.greatest(F.lit(0), begin) + limit)
        cut = lambda start: F.concat(F.when(start > 0, "...").otherwise(""), T.stripped(F.substring(flat, start + 1, end - start)), F.when(end < F.length(flat), "...").otherwise(""))
        return let(near, lambda n: F.when(F.length(n) <= limit, n).otherwise(let(F.greatest(F.lit(0), end - limit), cut)))

    def chosen(flat: Column, sentences: Column) -> Column:
        plain = F.concat(F.rtrim(F.substring(flat, F.lit(1), limit)), F.lit("..."))
        best = let(F.transform(sentences, lambda x: focus_score(x, weights)), lambda scores: F.array_position(scores, F.array_max(scores)).cast("int"))
        return F.when((F.size(sentences) == 0) | (F.size(weights) == 0), plain).otherwise(let(best, lambda b: around(flat, sentences, b)))

    return let(T.one_space(text), lambda flat: F.when(F.length(flat) <= limit, flat).otherwise(let(T.found(flat, r"[^.!?]+[.!?]?"), lambda found: chosen(flat, found))))


def citation_label(s: Column) -> Column:
    pages = F.when(s["page_start"].isNotNull(), F.concat(F.lit(", page "), s["page_start"].cast("string"), F.when(s["page_end"] != s["page_start"], F.concat(F.lit("-"), s["page_end"].cast("string"))).otherwise(""))).otherwise("")
    section = F.when(F.coalesce(s["section_title"], F.lit("")) != "", F.concat(F.lit(", section "), s["section_title"])).otherwise("")
    return F.concat(F.lit("[Source rank "), s["rank"].cast("string"), F.lit(", title "), F.coalesce(s["title"], F.lit("")), F.lit(", chunk "), s["chunk_index"].cast("string"), pages, section, F.lit("]"))


SOURCE = ("rank", "chunk_id", "title", "chunk_index", "page_start", "page_end", "section_title", "chunk_text")


def packed_context(results: DataFrame, k: int = 8, most: int = MOST_CHARS, per_source: int = SOURCE_CHARS) -> DataFrame:
    """Rows (query_id, query, context, sources) from results (query_id, query, intent, SOURCE columns).

    The first k ranks in the order of focus, each cut to its share, until the budget is used up.
    """
    rows = results.where(F.col("rank") <= k).withColumn("weights", focus_weights(F.col("query"), F.col("intent")))
    text = F.concat_ws(" ", F.coalesce("section_title", F.lit("")), F.coalesce("chunk_text", F.lit("")))
    broad = F.col("intent").isin("summary_request", "broad_document_query")
    less = F.when(broad & (F.col("chunk_index") == 0) & (F.length(text) < 350), 2).otherwise(0)
    scored = rows.withColumn("focus", focus_score(text, F.col("weights")) - less)
    # At most k sources a question.
    one = scored.groupBy("query_id").agg(F.first("query").alias("query"), F.first("weights").alias("weights"), F.sort_array(F.collect_list(F.struct((-F.col("focus")).alias("o"), "rank", F.struct(*SOURCE).alias("s")))).alias("all"))
    n = F.size("all")
    share = F.greatest(F.lit(500), F.floor((most - n * 180) / F.greatest(F.lit(1), n)).cast("int"))
    start = F.struct(F.lit(most).alias("left"), F.lit(False).alias("over"), F.array().cast("array<string>").alias("blocks"), F.array().cast("array<int>").alias("ranks"))

    def add(state: Column, item: Column) -> Column:
        s, left = item["s"], state["left"]
        limit = F.least(F.lit(per_source), share, F.greatest(F.lit(500), left - 250))

        def put(whole: Column) -> Column:
            over = (F.length(whole) > left) & (left < 500)
            block = F.when(F.length(whole) > left, F.rtrim(F.substring(whole, F.lit(1), left))).otherwise(whole)
            added = F.struct((left - F.length(block)).alias("left"), F.lit(False).alias("over"), F.concat(state["blocks"], F.array(block)).alias("blocks"), F.concat(state["ranks"], F.array(s["rank"].cast("int"))).alias("ranks"))
            return F.when(over, F.struct(left.alias("left"), F.lit(True).alias("over"), state["blocks"].alias("blocks"), state["ranks"].alias("ranks"))).otherwise(added)

        skip = state["over"] | (left <= 0) | (F.trim(F.coalesce(s["chunk_text"], F.lit(""))) == "")
        return F.when(skip, state).otherwise(let(F.concat(citation_label(s), F.lit("\n"), excerpt(s["chunk_text"], F.col("weights"), limit)), put))

    done = one.withColumn("state", F.aggregate("all", start, add))
    chosen = F.filter(F.transform("all", lambda a: a["s"]), lambda s: F.array_contains(F.col("state.ranks"), s["rank"].cast("int")))
    return done.select("query_id", "query", F.array_join("state.blocks", "\n\n").alias("context"), chosen.alias("sources"))


def prompt(query: Column, context: Column, instruction: str, mode: str) -> Column:
    """Instruction, rules of citation, mode, question and context in one text."""
    rules = "Cite each sentence with source rank and chunk, for example: [Source rank 1, chunk 8, page 19].\nUse only source ranks present in the context labels.\nIf no context supports the question, respond exactly: insufficient_context."
    return F.concat(F.lit(f"{instruction}\n\nCitation rules:\n{rules}\n\nAnswer mode:\n{mode}\n\nQuestion:\n"), query, F.lit("\n\nContext:\n"), context, F.lit("\n\nAnswer:"))


def evidence_terms(text: Column) -> Column:
    """Distinct words of three letters and more, by their first ten, without stop words."""
    words = F.transform(T.found(text, EVIDENCE_WORD), lambda w: F.btrim(F.lower(w), F.lit("'")))
    return F.array_distinct(F.transform(F.filter(words, lambda w: ~F.array_contains(quoted(EVIDENCE_STOP), w)), lambda w: F.substring(w, 1, 10)))


def verified(answers: DataFrame) -> DataFrame:
    """answers (answer, query, sources array<struct<rank, chunk_index, chunk_text>>) with supported, reason, cited_ranks, overlap.

    The first rule that holds decides: empty, reported lack of context, inference words, no citation, unknown rank, wrong chunk, a name of the
    question that no source has, too few of the answer's words in the sources.
    """
    said = T.stripped(F.coalesce("answer", F.lit("")))
    ranks, cited_chunks = (T.found(said, CITATION, g) for g in (1, 2))
    pairs = F.arrays_zip(F.transform(ranks, lambda r: r.cast("int")).alias("rank"), F.transform(cited_chunks, lambda c: F.nullif(c, F.lit("")).cast("int")).alias("chunk"))
    rows = answers.withColumns({"__said": said, "__cited": pairs})
    rank_of = F.transform("sources", lambda s: s["rank"].cast("int"))
    cited = F.array_sort(F.array_distinct(F.transform("__cited", lambda p: p["rank"])))
    unknown = F.array_except(cited, rank_of)
    wrong = F.exists("__cited", lambda p: p["chunk"].isNotNull() & F.exists("sources", lambda s: (s["rank"].cast("int") == p["rank"]) & (s["chunk_index"].cast("int") != p["chunk"])))
    context = evidence_terms(F.array_join(F.transform("sources", lambda s: F.coalesce(s["chunk_text"], F.lit(""))), " "))
    own = evidence_terms(F.regexp_replace("__said", CITATION, " "))
    rows = rows.withColumns({"__context": context, "__own": own, "cited_ranks": cited})
    overlap = F.when((F.size("__own") > 0) & (F.size("__context") > 0), F.size(F.array_intersect("__own", "__context")) / F.size("__own")).otherwise(0.0)
    names = F.filter(T.found(F.coalesce("query", F.lit("")), ANCHOR), lambda w: ~F.array_contains(quoted(ANCHOR_STOP), w))
    lost = F.array_except(F.transform(names, lambda w: F.substring(F.lower(w), 1, 10)), F.col("__context"))
    low = F.lower("__said")
    reason = (
        F.when(F.col("__said") == "", "empty_answer")
        .when(F.startswith(low, F.lit("insufficient_context")), "model_reported_insufficient_context")
        .when(T.phrases_in(low, INFERENCE) > 0, "answer_uses_unsupported_inference_language")
        .when(F.size("__cited") == 0, "answer_has_no_source_rank_citations")
        .when(F.size(unknown) > 0, "answer_cites_source_ranks_not_in_context")
        .when(wrong, "answer_cites_wrong_chunk_for_source_rank")
        .when(F.size(lost) > 0, "query_named_anchors_not_found_in_selected_context")
        .when(overlap < LEAST_OVERLAP, "answer_terms_not_supported_by_selected_context")
        .otherwise("answer_citations_match_selected_context")
    )
    good = F.col("reason").isin("model_reported_insufficient_context", "answer_citations_match_selected_context")
    return rows.withColumns({"overlap": F.round(overlap, 4), "reason": reason}).withColumn("supported", good).drop("__said", "__cited", "__context", "__own")


def settled(answers: DataFrame) -> DataFrame:
    """Verified answers with status: unsupported ones, and those that report no context, are replaced."""
    keep = F.col("supported") & (F.col("reason") != "model_reported_insufficient_context")
    return answers.withColumns({"status": F.when(keep, "answered").otherwise("insufficient_context"), "answer": F.when(keep, F.col("answer")).otherwise(NO_CONTEXT)})


def extractive(prompts: pd.Series) -> pd.Series:
    """The answer of no model: the first sentence of the first source, with its citation."""

    def one(text: str) -> str:
        context = text.partition("\n\nContext:\n")[2]
        label, _, rest = context.partition("\n")
        sentence = rest.split(". ")[0].split("\n")[0].strip()
        return f"{sentence} {label}" if label.startswith("[Source") and sentence else "insufficient_context"

    return prompts.map(one)


def answered(contexts: DataFrame, models: dict[str, Callable[[pd.Series], pd.Series]], instruction: str = "Use only the provided context.", mode: str = "concise") -> DataFrame:
    """A row for each question and model: (query_id, query, model, ok, answer, error, sources). A model that fails makes rows, not a failed job."""
    names = list(models)
    asked = contexts.withColumn("prompt", prompt(F.col("query"), F.col("context"), instruction, mode)).select("query_id", "query", "sources", "prompt", F.explode(F.array(*map(F.lit, names))).alias("model"))

    @F.pandas_udf("ok boolean, answer string, error string")
    def generate(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for model, text in batches:
            out = pd.DataFrame({"ok": False, "answer": None, "error": None}, index=text.index)
            for name in model.unique():
                rows = model == name
                try:
                    out.loc[rows, "answer"] = models[name](text[rows])
                    out.loc[rows, "ok"] = True
                except Exception as e:  # noqa: BLE001  a failure is a result here
                    out.loc[rows, "error"] = f"{type(e).__name__}: {e}"
            yield out

    return asked.withColumn("out", generate("model", "prompt")).select("query_id", "query", "model", "out.ok", "out.answer", "out.error", "sources")


def progress_events(answers: DataFrame) -> DataFrame:
    """Rows (query_id, seq, event, frame): a start, one result or error for each model, an end, as server-sent frames."""
    order = Window.partitionBy("query_id").orderBy("model")
    result = answers.select("query_id", F.row_number().over(order).alias("seq"), F.when(F.col("ok"), "result").otherwise("error").alias("event"), F.to_json(F.struct("model", "answer", "error")).alias("payload"))
    ends = answers.groupBy("query_id").agg(F.count("*").cast("int").alias("n"))
    start = ends.select("query_id", F.lit(0).alias("seq"), F.lit("start").alias("event"), F.to_json(F.struct("n")).alias("payload"))
    end = ends.select("query_id", (F.col("n") + 1).alias("seq"), F.lit("done").alias("event"), F.to_json(F.struct("n")).alias("payload"))
    return start.unionByName(result).unionByName(end).select("query_id", "seq", "event", F.concat(F.lit("event: "), "event", F.lit("\ndata: "), "payload", F.lit("\n\n")).alias("frame"))
