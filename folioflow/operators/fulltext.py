"""Full-text search with positions: stems, stop words, phrases, alternatives and exclusions, ranks by cover density.

An index is a table (key, term, positions). A chunk's postings are made where its text lies, words stemmed once a task, and only those of
asked terms go further; queries meet the index by equal stems. A query is read as in web search: words together, "phrases", or between alternatives, a minus before what must not be there.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from folioflow.functions.stem import stem
from folioflow.sources.scratch import kept

WEIGHT = 0.1
WORD = r"[\p{L}\p{N}]+"
# English words that carry no meaning in a search.
STOP = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours", "yourself", "yourselves", "he", "him", "his", "himself", "she", "her",
    "hers", "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves", "what", "which", "who", "whom", "this", "that", "these",
    "those", "am", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing", "a", "an", "the", "and",
    "but", "if", "or", "because", "as", "until", "while", "of", "at", "by", "for", "with", "about", "against", "between", "into", "through", "during",
    "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own",
    "same", "so", "than", "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)


@F.pandas_udf(StringType())
def _stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


def _stop(c):
    return c.isin(*STOP)


#: Chunks whose words are sorted at once; words whose stems a task remembers.
SORTED, KNOWN = 256, 1 << 20


def _postings(keys: pa.Array, texts: pa.ListArray, known: dict[str, str | None], stemmed: bool) -> list[pa.Array]:
    """Columns (key, term, positions) of some chunks (key, words); a word that is known as None takes up a place only."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(texts), 0), np.int64)
    words = texts.flatten().dictionary_encode()
    distinct = words.dictionary.to_pylist()
    for word in distinct:
        if word not in known:
            known[word] = stem(word) if stemmed else word
    terms = sorted({t for w in distinct if (t := known[w]) is not None})
    place = {t: i for i, t in enumerate(terms)}
    term_of = np.array([place.get(known[w], -1) for w in distinct], np.int64)
    term = term_of[words.indices.to_numpy()] if len(distinct) else np.empty(0, np.int64)
    chunk = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(chunk)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    some = np.flatnonzero(term >= 0)
    group = chunk[some] * len(terms) + term[some]
    order = np.argsort(group, kind="stable")
    some, group = some[order], group[order]
    first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(group) else np.empty(0, np.int64)
    positions = pa.ListArray.from_arrays(pa.array(np.r_[first, len(group)].astype(np.int32)), pa.array(at[some].astype(np.int32)))
    return [keys.take(pa.array(chunk[some[first]])), pa.array(terms, pa.string()).take(pa.array(term[some[first]])), positions]


def _placed(chunks: DataFrame, key: str, text: str, stemmed: bool) -> DataFrame:
    """Rows (key, term, positions) of each row by itself."""
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(WORD), F.lit(0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = dict.fromkeys(STOP)
        for batch in batches:
            for start in range(0, batch.num_rows, SORTED):
                if len(known) > KNOWN:
                    known = dict.fromkeys(STOP)
                yield pa.RecordBatch.from_arrays(_postings(batch.column(0).slice(start, SORTED), batch.column(1).slice(start, SORTED), known, stemmed), [key, "term", "positions"])

    return chunks.select(key, words.alias("words")).mapInArrow(run, f"`{key}` {chunks.schema[key].dataType.simpleString()}, term string, positions array<int>")


def index(chunks: DataFrame, key: str = "chunk_id", text: str = "chunk_text", stemmed: bool = True) -> DataFrame:
    """Rows (key, term, positions): ascending places of a term's words; stop words take up places but aren't kept.

    Rows of one key count as one chunk, each from place 0; only these are brought together.
    """
    again = kept(chunks.groupBy(F.col(key).alias("__key")).agg(F.count("*").alias("n")).where("n > 1").select("__key"), "again")
    if again.isEmpty():
        return _placed(chunks, key, text, stemmed)
    same = F.col(key).eqNullSafe(F.col("__key"))
    united = _placed(chunks.join(again, same, "left_semi"), key, text, stemmed).groupBy(key, "term").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return _placed(chunks.join(again, same, "left_anti"), key, text, stemmed).unionByName(united)


def parsed(queries: DataFrame, phrase: str | None = None, stemmed: bool = True) -> DataFrame:
    """Rows (query_id, alternative, item, negative, place, term) of queries (query_id, query); a query that the column `phrase` marks is one phrase."""
    whole = F.regexp_extract_all("query", F.lit(r'-?"[^"]*"|\S+'), F.lit(0))
    tokens = F.when(F.coalesce(F.col(phrase), F.lit(False)), F.array(F.concat(F.lit('"'), F.col("query"), F.lit('"')))).otherwise(whole) if phrase else whole
    rows = queries.select("query_id", F.posexplode(tokens).alias("item", "token"))
    by_or = Window.partitionBy("query_id").orderBy("item")
    rows = rows.withColumn("alternative", F.sum((F.lower("token") == "or").cast("int")).over(by_or)).where("lower(token) <> 'or'")
    words = F.filter(F.transform(F.regexp_extract_all(F.lower("token"), F.lit(WORD), F.lit(0)), lambda w, i: F.struct(i.alias("place"), w.alias("word"))), lambda s: ~_stop(s["word"]))
    flat = rows.select("query_id", "alternative", "item", F.startswith("token", F.lit("-")).alias("negative"), F.explode(words).alias("w")).select("query_id", "alternative", "item", "negative", "w.place", "w.word")
    return flat.withColumn("term", _stemmed(F.col("word")) if stemmed else F.col("word")).drop("word")


def cover_density(found: list[tuple[int, str]], n: int) -> float:
    """Of places (position, term) of n terms: the weight over 1 and the words between, summed up over smallest covers."""
    found = sorted(found)
    last: dict[str, int] = {}
    total, before = 0.0, -1
    for i, (at, term) in enumerate(found):
        last[term] = i
        if len(last) == n and (start := min(last.values())) > before:
            inside = i - start
            noise = at - found[start][0] - inside
            total += WEIGHT / (1 + (noise if noise >= 0 else inside // 2))
            before = start
    return total


@F.pandas_udf(DoubleType())
def _cover_density(places: pd.Series, terms: pd.Series) -> pd.Series:
    """cover_density() of rows (array<struct<position, term>>, number of terms)."""
    return pd.Series([cover_density([(p["position"], p["term"]) for p in f], n) for f, n in zip(places, terms, strict=True)], dtype="float64")


def search(terms_of: DataFrame, asked: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Rows (query_id, key, text_score) of the chunks that match. terms_of: index(); asked: parsed().

    An item matches where its words stand side by side; an alternative where all its items match but none of the negative ones; a query by any alternative.
    """
    asked = kept(asked, "asked")
    # Terms that no query has are left behind before anything is written or shuffled.
    terms_of = kept(terms_of.join(asked.select("term").distinct(), "term", "left_semi").select(key, "term", "positions"), "terms")
    item_key = ["query_id", "alternative", "item"]
    size = asked.groupBy(*item_key).agg(F.count("*").alias("words"))
    # Chunks that have all words of an item, told without places; only theirs are looked at further.
    whole = terms_of.select(key, "term").join(asked, "term").groupBy(key, *item_key).agg(F.count("*").alias("n"))
    whole = kept(whole.join(size, item_key).where("n = words").drop("n"), "whole")
    met = kept(whole.join(asked, item_key).join(terms_of, [key, "term"]), "met")
    # Starts at which an item could stand, by each of its words; where all of them agree, it does.
    starts = met.select(key, *item_key, "negative", "words", F.explode(F.transform("positions", lambda p: p - F.col("place"))).alias("start"))
    items = starts.groupBy(key, *item_key, "negative", "words", "start").agg(F.count("*").alias("n")).where("n = words")
    found = items.select(key, "query_id", "alternative", "item", "negative").distinct()
    need = asked.where("not negative").groupBy("query_id", "alternative").agg(F.count_distinct("item").alias("items"))
    per = found.groupBy(key, "query_id", "alternative").agg(F.count_if(~F.col("negative")).alias("n"), F.count_if(F.col("negative")).alias("bad"))
    good = per.join(need, ["query_id", "alternative"]).where("n = items and bad = 0").select(key, "query_id", "alternative")
    places = met.where("not negative").join(good, [key, "query_id", "alternative"]).select(key, "query_id", "alternative", "term", F.explode("positions").alias("position")).distinct()
    gathered = places.groupBy(key, "query_id", "alternative").agg(F.collect_list(F.struct("position", "term")).alias("places"), F.count_distinct("term").cast("int").alias("terms"))
    scored = gathered.withColumn("text_score", _cover_density("places", "terms"))
    return scored.groupBy("query_id", key).agg(F.max("text_score").alias("text_score"))
