"""Entity graphs of documents: mentions consolidated, edges joined, communities, fuzzy search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions import text as T
from folioflow.sources.scratch import kept

from .components import components
from .similar_sets import candidates
from .substrings import inside

LEAST_SIMILARITY = 0.1
FACT_ENTITIES, FACT_RELATIONSHIPS, FACT_CHARS = 200, 300, 12_000
#: Chunks that a model gets at once, and how much of each.
CHUNKS_A_CALL, CHUNK_CHARS = 8, 12_000
EXTRACTION_PROMPT = "Name the entities of this text and how they are related, as JSON with the lists entities (name, type, description, confidence) and relationships (source, target, type, description, confidence).\n\n"
SUMMARY_PROMPT = "Summarise what these facts say of the document.\n\n"
ANSWER = (
    "entities array<struct<name:string,type:string,description:string,confidence:double>>, "
    "relationships array<struct<source:string,target:string,type:string,description:string,confidence:double>>"
)


def capitalised_mentions(chunks: DataFrame) -> DataFrame:
    """Mentions by rule, without a model: runs of capitalised words inside a sentence. Rows (resource_id, chunk_id, chunk_index, name, entity_type, position)."""
    names = T.found("chunk_text", r"(?<=[\p{Ll},;] )\p{Lu}[\p{L}'-]{2,}(?: \p{Lu}[\p{L}'-]{2,})*")
    return chunks.select("resource_id", "chunk_id", "chunk_index", F.posexplode(names).alias("position", "name")).withColumn("entity_type", F.lit("NAME"))


def by_model(rows: DataFrame, text: str, model: Callable[[list[str]], list[str]], size: int) -> DataFrame:
    """rows with answer and error of a model that takes a list of texts. A call that fails, or answers too few, is made again text by text; a text that fails alone is a row with an error."""

    def one(text: str) -> tuple[str | None, str | None]:
        try:
            return model([text])[0], None
        except Exception as e:  # noqa: BLE001  a failure is a result here
            return None, f"{type(e).__name__}: {e}"

    def call(texts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            found = list(model(texts))
            if len(found) == len(texts):
                return [(a, None) for a in found]
        except Exception:  # noqa: BLE001  told by the single calls
            pass
        return [one(t) for t in texts]

    @F.pandas_udf("answer string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [r for i in range(0, len(texts), size) for r in call(texts.iloc[i : i + size].tolist())]
            yield pd.DataFrame(found, columns=["answer", "error"])

    return rows.withColumn("__out", run(F.coalesce(F.col(text), F.lit("")))).select(*rows.columns, "__out.answer", "__out.error")


def extracted(chunks: DataFrame, model: Callable[[list[str]], list[str]], size: int = CHUNKS_A_CALL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mentions, edges, errors) of chunks (resource_id, chunk_id, chunk_index, chunk_text) by a model that answers with JSON of entities and relationships.

    The JSON may stand in a fence or between words. A chunk whose answer is none, or whose call failed alone, is a row of errors (chunk_id, error).
    """
    prompt = F.concat(F.lit(EXTRACTION_PROMPT), F.left(F.col("chunk_text"), F.lit(CHUNK_CHARS)))
    answers = kept(by_model(chunks.select("resource_id", "chunk_id", "chunk_index", prompt.alias("prompt")), "prompt", model, size).withColumn("r", F.from_json(T.json_in("answer"), ANSWER)), "answers")
    ids = ["resource_id", "chunk_id", "chunk_index"]
    mentions = answers.select(*ids, F.posexplode("r.entities").alias("position", "e")).select(*ids, "position", "e.name", F.col("e.type").alias("entity_type"), "e.description", "e.confidence")
    edges = answers.select(*ids, F.explode("r.relationships").alias("e")).select(*ids, "e.source", "e.target", F.col("e.type").alias("relationship_type"), "e.description", "e.confidence")
    bad = answers.where("error is not null or r is null or (r.entities is null and r.relationships is null)")
    return mentions, edges, bad.select("chunk_id", F.coalesce("error", F.lit("no JSON of entities and relationships")).alias("error"))


def summarised(given: DataFrame, model: Callable[[list[str]], list[str]], size: int = CHUNKS_A_CALL) -> DataFrame:
    """Rows (resource_id, summary, error) of facts() by a model; a prompt holds FACT_CHARS of a resource's facts."""
    facts_ = F.left(F.concat(F.lit("Entities:\n"), "entities", F.lit("\nRelationships:\n"), "relationships"), F.lit(FACT_CHARS))
    return by_model(given.select("resource_id", F.concat(F.lit(SUMMARY_PROMPT), facts_).alias("prompt")), "prompt", model, size).select("resource_id", F.col("answer").alias("summary"), "error")


def entities(mentions: DataFrame) -> DataFrame:
    """Entities by resource and normalised name: first name and description, known type, greatest confidence, chunks and mentions.

    mentions: (resource_id, chunk_id, chunk_index, position, name, entity_type, description, confidence).
    """
    for c, kind in (("description", "string"), ("confidence", "double")):
        if c not in mentions.columns:
            mentions = mentions.withColumn(c, F.lit(None).cast(kind))
    rows = mentions.withColumns({"entity_key": T.name_key("name"), "entity_type": T.type_key("entity_type", "UNKNOWN"), "at": F.struct("chunk_index", "position", "chunk_id")}).where("entity_key <> ''")
    first = lambda c, test: F.min_by(c, F.when(test, F.col("at")))
    return rows.groupBy("resource_id", "entity_key").agg(
        F.min_by(F.trim("name"), "at").alias("name"),
        F.coalesce(first("entity_type", F.col("entity_type") != "UNKNOWN"), F.lit("UNKNOWN")).alias("entity_type"),
        first("description", F.coalesce("description", F.lit("")) != "").alias("description"),
        F.max("confidence").alias("confidence"),
        F.count_distinct("chunk_id").alias("chunk_count"),
        F.count("*").alias("mention_count"),
    )


def relationships(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges by resource, ends and type, between known entities that differ: mentions, chunks, greatest confidence, first description.

    edges: (resource_id, chunk_id, chunk_index, source, target, relationship_type, description, confidence).
    """
    rows = edges.select("resource_id", "chunk_id", "chunk_index", T.name_key("source").alias("source_key"), T.name_key("target").alias("target_key"), T.type_key("relationship_type", "RELATED_TO").alias("relationship_type"), "description", "confidence").where("source_key <> target_key")
    # Edges are summed up before they meet the entities.
    merged = rows.groupBy("resource_id", "source_key", "target_key", "relationship_type").agg(
        F.count("*").alias("mention_count"),
        F.count_distinct("chunk_id").alias("chunk_count"),
        F.max("confidence").alias("confidence"),
        F.min_by("description", F.when(F.coalesce("description", F.lit("")) != "", F.struct("chunk_index", "chunk_id"))).alias("description"),
    )
    known = nodes.select("resource_id", "entity_key")
    for end in ("source_key", "target_key"):
        merged = merged.join(known.withColumnRenamed("entity_key", end), ["resource_id", end], "left_semi")
    return merged


def neighbours(mentions: DataFrame) -> DataFrame:
    """Edges between names that follow one another in a chunk: the relationships of no model."""
    from pyspark.sql import Window

    order = Window.partitionBy("chunk_id").orderBy("position")
    pairs = mentions.withColumn("target", F.lead("name").over(order)).where("target is not null")
    return pairs.select("resource_id", "chunk_id", "chunk_index", F.col("name").alias("source"), "target", F.lit("next to").alias("relationship_type"), F.lit(None).cast("string").alias("description"), F.lit(None).cast("double").alias("confidence"))


def communities(edges: DataFrame) -> DataFrame:
    """Rows (resource_id, entity_key, community): the least name that a name is linked to; names without a link have no row."""
    links = edges.select("resource_id", F.col("source_key").alias("u"), F.col("target_key").alias("v"))
    return components(links, ["resource_id"]).select("resource_id", F.col("node").alias("entity_key"), F.col("root").alias("community"))


def community_summaries(labels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows (resource_id, community, entity_count, name, summary) from the first names of each community."""
    from pyspark.sql import Window

    own = ["resource_id", "community"]
    named = kept(labels.join(nodes.select("resource_id", "entity_key", "name"), ["resource_id", "entity_key"]), "named")
    # No more names than a summary has are gathered of a community.
    first = named.withColumn("__n", F.row_number().over(Window.partitionBy(*own).orderBy("name"))).where("__n <= 8")
    names = first.groupBy(*own).agg(F.sort_array(F.collect_list("name")).alias("names"))
    return named.groupBy(*own).agg(F.count("*").alias("entity_count")).join(names, own).select(
        *own, "entity_count", F.array_join(F.slice("names", 1, 3), ", ").alias("name"), F.concat(F.lit("Related graph cluster containing "), F.array_join("names", ", "), F.lit(".")).alias("summary")
    )


def _first_of_each(rows: DataFrame, most: int, *columns: str) -> DataFrame:
    """Rows (resource_id, first): the first `most` structs of the columns of each resource as JSON; no more than that are gathered."""
    from pyspark.sql import Window

    cut = rows.withColumn("__n", F.row_number().over(Window.partitionBy("resource_id").orderBy(*columns))).where(F.col("__n") <= most)
    return cut.groupBy("resource_id").agg(F.to_json(F.sort_array(F.collect_list(F.struct(*columns)))).alias("first"))


def facts(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (resource_id, entities, relationships): the first ones of each resource as JSON, for a summary's prompt."""
    ent = _first_of_each(nodes, FACT_ENTITIES, "entity_key", "name", "entity_type", "chunk_count").withColumnRenamed("first", "entities")
    rel = _first_of_each(links, FACT_RELATIONSHIPS, "source_key", "target_key", "relationship_type", "mention_count").withColumnRenamed("first", "relationships")
    return ent.join(rel, "resource_id", "left").withColumn("relationships", F.coalesce("relationships", F.lit("[]")))


def _holding(values: DataFrame, queries: DataFrame, key: str) -> DataFrame:
    """Distinct rows (query_id, key) where a value (key, value) holds the query (query_id, query), in any case of letters."""
    low = values.select(key, F.lower("value").alias("value"))
    held = inside(low.select("value"), queries.select("query_id", F.lower("query").alias("phrase")))
    return low.join(held, "value").select("query_id", key).distinct()


def _by_text(queries: DataFrame) -> DataFrame:
    """(query_id, query) of the distinct texts, each for its own id: queries of the same text find the same. A null text finds nothing."""
    return queries.where("query is not null").select(F.col("query").alias("query_id"), "query").distinct()


def _for_all(found: DataFrame, queries: DataFrame) -> DataFrame:
    """What was found by _by_text(), for every query of that text."""
    members = queries.select("query_id", F.col("query").alias("__text"))
    return found.withColumnRenamed("query_id", "__text").join(members, "__text").select(*found.columns)


def _least_keys(rows: DataFrame, same: list[str], key: str, k: int) -> DataFrame:
    """The rows of the k least keys among those that agree in the columns `same`: where ties go by the key, no others can be among the k best."""
    from pyspark.sql import Window

    least = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*same).orderBy(key))).where(F.col("__n") <= k)
    return kept(least.drop("__n"), "least")


def similar_names(nodes: DataFrame, queries: DataFrame, k: int, key: str = "entity_key", name: str = "name", report: dict | None = None) -> DataFrame:
    """Rows (query_id, key, score, rank): names that contain a query or share more than LEAST_SIMILARITY of its trigrams.

    nodes: distinct (key, name); queries: (query_id, query). A name that holds a query scores 1.
    """
    return _for_all(_similar_names(nodes, _by_text(queries), k, key, name, report), queries)


def _similar_names(nodes: DataFrame, queries: DataFrame, k: int, key: str = "entity_key", name: str = "name", report: dict | None = None) -> DataFrame:
    values = _least_keys(nodes.select(key, F.col(name).alias("value")), ["value"], key, k)
    held = kept(_holding(values, queries, key).withColumn("score", F.lit(1.0)), "held")
    similar = candidates(values, queries, k, LEAST_SIMILARITY, key, known=held, report=report)
    scored = held.unionByName(similar.select("query_id", key, F.col("similarity").alias("score"))).groupBy("query_id", key).agg(F.max("score").alias("score"))
    return _best(scored, k, key)


def _best(scored: DataFrame, k: int, *order) -> DataFrame:
    from pyspark.sql import Window

    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), *order))).where(F.col("rank") <= k)


def relationship_top(links: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, relationship_id, resource_id, score, rank): relationships that a query names.

    links: (relationship_id, resource_id, relationship_type, description, source_name, target_name); queries: (query_id, query). A relationship is found by a
    description that is similar to the query, and where the query stands in its description, type or names; ties go by relationship_id.
    """
    return _for_all(_relationship_top(links, _by_text(queries), k), queries)


def _relationship_top(links: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    key = "relationship_id"
    links = _least_keys(links, ["relationship_type", "description", "source_name", "target_name"], key, k)
    texts = links.select(key, F.coalesce("description", F.lit("")).alias("value"))
    names = links.select(key, F.explode(F.array("relationship_type", "source_name", "target_name")).alias("value"))
    held = kept(_holding(texts.unionByName(names), queries, key), "held")
    score = relationship_score(F.col("query"), F.col("description"), F.col("relationship_type"), F.col("source_name"), F.col("target_name"))

    def scored(pairs: DataFrame) -> DataFrame:
        return pairs.join(links, key).join(queries.select("query_id", "query"), "query_id").select("query_id", key, "resource_id", score.alias("score"))

    known = kept(scored(held), "known")
    # What is similar by its description may score by its type instead: never more than the type most similar to the query.
    kinds = links.select(F.col("relationship_type").alias("kind")).where("kind is not null").distinct().select("kind", F.col("kind").alias("value"))
    floor = candidates(kinds, queries.select("query_id", F.upper("query").alias("query")), 1, 0.0, "kind").groupBy("query_id").agg(F.max("similarity").alias("floor"))
    similar = candidates(texts, queries, k, LEAST_SIMILARITY, key, floor=floor, known=known)
    new = similar.select("query_id", key).join(held, ["query_id", key], "left_anti")
    return _best(known.unionByName(scored(new)), k, key)


def summary_top(summaries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Rows (query_id, summary_id, resource_id, score, rank): summaries (summary_id, resource_id, summary_text) that are similar to a query or hold it."""
    return _for_all(_summary_top(summaries, _by_text(queries), k), queries)


def _summary_top(summaries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    key = "summary_id"
    summaries = _least_keys(summaries, ["summary_text"], key, k)
    values = summaries.select(key, F.col("summary_text").alias("value"))
    held = _holding(values, queries, key).join(values, key).join(queries.select("query_id", "query"), "query_id")
    known = kept(held.select("query_id", key, T.trigram_similarity(T.trigrams("value"), T.trigrams("query")).alias("score")), "held")
    similar = candidates(values, queries, k, LEAST_SIMILARITY, key, known=known).select("query_id", key, F.col("similarity").alias("score"))
    found = known.unionByName(similar.join(known, ["query_id", key], "left_anti"))
    return _best(found.join(summaries.select(key, "resource_id"), key), k, key)


def graph_search(nodes: DataFrame, links: DataFrame, summaries: DataFrame, chunks: DataFrame, queries: DataFrame, k: int) -> dict[str, DataFrame]:
    """entities, relationships, summaries and chunks by query: the first three as found, the chunks of the resources that these are of.

    nodes: (entity_key, name, resource_id); chunks: (chunk_id, resource_id, chunk_index, chunk_text). All are of resources that a search may see.
    """
    texts = kept(_by_text(queries), "texts")
    found = kept(_similar_names(nodes.select("entity_key", "name").distinct(), texts, k), "entities")
    entities = found.join(nodes.select("entity_key", "resource_id").distinct(), "entity_key")
    relationships, abstracts = kept(_relationship_top(links, texts, k), "relationships"), kept(_summary_top(summaries, texts, k), "summaries")
    resources = entities.select("query_id", "resource_id").unionByName(relationships.select("query_id", "resource_id")).unionByName(abstracts.select("query_id", "resource_id")).distinct()
    # The first k chunks of a resource are enough for any query's first k.
    from pyspark.sql import Window

    first = chunks.withColumn("__n", F.row_number().over(Window.partitionBy("resource_id").orderBy("chunk_index", "chunk_id"))).where(F.col("__n") <= k)
    around = first.join(resources, "resource_id").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("chunk_index", "chunk_id"))).where(F.col("rank") <= k)
    around = around.select("query_id", "chunk_id", "resource_id", "chunk_index", F.left("chunk_text", F.lit(700)).alias("snippet"), "rank")
    return {kind: _for_all(rows, queries) for kind, rows in (("entities", entities), ("relationships", relationships), ("summaries", abstracts), ("chunks", around))}


def related_chunks(chunks: DataFrame, resource_ids: DataFrame, chunk_ids: DataFrame, k: int) -> DataFrame:
    """The first k chunks that are named or belong to a named resource, with 700 characters of their text."""
    named = chunks.join(resource_ids.select("resource_id").distinct(), "resource_id", "left_semi").unionByName(chunks.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi"))
    return named.dropDuplicates(["chunk_id"]).orderBy("chunk_index", "chunk_id").limit(k).select("chunk_id", "resource_id", "chunk_index", F.left("chunk_text", F.lit(700)).alias("snippet"))


def relationship_score(query: Column, description: Column, kind: Column, source: Column, target: Column) -> Column:
    """Greatest of the similarities of description and type, and of the query standing in description or names."""
    low = F.lower(query)
    inside = lambda c, by: F.when(F.contains(F.lower(F.coalesce(c, F.lit(""))), low), by).otherwise(0.0)
    similar = lambda c, q: T.trigram_similarity(T.trigrams(F.coalesce(c, F.lit(""))), T.trigrams(q))
    return F.greatest(similar(description, query), similar(kind, F.upper(query)), inside(description, 1.0), inside(source, 0.8), inside(target, 0.8))
