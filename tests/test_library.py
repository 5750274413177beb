import pytest
from pyspark.sql import functions as F

from folioflow.functions.stem import stem
from folioflow.operators import fulltext as X
from folioflow.operators import registration as G
from folioflow.operators import tools as L
from folioflow.sources import sinks

# Words and stems from the published description of the algorithm.
PUBLISHED = dict(
    pair.split(":")
    for pair in "consign:consign consigned:consign consigning:consign consignment:consign consist:consist consistency:consist consistent:consist consolation:consol consolatory:consolatori console:consol consoled:consol consoling:consol consolingly:consol conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci conspirator:conspir conspire:conspir constable:constabl constables:constabl constant:constant knack:knack knave:knave knavery:knaveri knavish:knavish kneel:kneel kneeled:kneel kneeling:kneel knees:knee knell:knell knightly:knight knitted:knit knitting:knit knives:knive knob:knob knocked:knock knocker:knocker knocking:knock knots:knot known:known generate:generat generously:generous skies:sky dying:die flies:fli hopping:hop hoping:hope happy:happi by:by say:say cries:cri".split()
)


def test_stems_of_the_published_list():
    assert {w: stem(w) for w in PUBLISHED} == PUBLISHED


def search(spark, texts, query, phrase=None):
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id int, chunk_text string")
    queries = spark.createDataFrame([(1, query, phrase)], "query_id int, query string, exact boolean")
    return {r.chunk_id: r.text_score for r in X.search(X.index(chunks), X.parsed(queries, "exact")).collect()}


TEXTS = ["Golden rivers running through the mountains", "a river of gold; mountains far away", "the mountain rivers", "silver lakes"]


def test_words_and_stems(spark):
    assert set(search(spark, TEXTS, "river mountain")) == {0, 1, 2}
    assert set(search(spark, TEXTS, "river -running")) == {1, 2}
    assert set(search(spark, TEXTS, "lake or golden")) == {0, 3}
    assert search(spark, TEXTS, "the of") == {}


def test_phrases(spark):
    assert set(search(spark, TEXTS, '"mountain river"')) == {2}
    assert set(search(spark, TEXTS, "golden rivers", True)) == {0}


def test_cover_density(spark):
    found = search(spark, ["alpha beta", "alpha x x x beta", "alpha beta alpha"], "alpha beta")
    assert found[0] == pytest.approx(0.1) and found[1] == pytest.approx(0.1 / 4) and found[2] == pytest.approx(0.2)


def test_registration(spark):
    asks = spark.createDataFrame([("A", "a@x", "1", "FREE"), ("B", "A@X", "2", "FREE"), ("C", "c@x", "3", "GOLD"), ("D", "d@x", "9", "FREE")], "full_name string, email string, account_id string, tier_code string")
    users = spark.createDataFrame([("d@x", None), ("z@x", "7")], "email string, account_id string")
    tiers = spark.createDataFrame([("FREE", "ACTIVE"), ("GOLD", "INACTIVE")], "tier_code string, status string")
    accepted, approvals, subscriptions, refused = G.registered(asks, users, tiers)
    assert [r.full_name for r in accepted.collect()] == ["A"]
    assert {r.full_name: r.reason for r in refused.collect()} == {"B": "user exists", "C": "unknown tier", "D": "user exists"}
    assert approvals.join(accepted, "user_id").count() == subscriptions.join(accepted, "user_id").count() == 1


def test_tool_checks(spark):
    table = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "author_id int, author_name string")
    library = L.Library({"authors": table}, table, table)
    assert len(L.TOOLS) == 24 and [r.author_id for r in L.call(library, "get_authors", limit=2, offset=3).collect()] == [3, 4]
    for tool, args in (("get_authors", {"limit": 0}), ("get_authors", {"limit": 101}), ("get_authors", {"offset": -1}), ("get_books_by_author", {"author": " "}), ("other", {})):
        with pytest.raises(ValueError):
            L.call(library, tool, **args)


def test_stages_are_read_again(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    path = str(tmp_path / "s")
    assert sinks.stage(spark, path, build).count() == sinks.stage(spark, path, build).count() == 3 and len(built) == 1


def test_sinks_and_cache(spark, tmp_path):
    path = str(tmp_path / "e")
    rows = spark.createDataFrame([(1, "p", "m", "1", [0.5]), (2, "p", "m2", "1", [0.5])], "chunk_id int, provider string, model string, version string, vector array<double>")
    sinks.append(rows, path, "embeddings")
    sinks.append(rows.where("chunk_id = 1").withColumn("chunk_id", F.lit(3)), path, "embeddings")
    sinks.replace_partitions(rows.where("chunk_id = 2").withColumn("chunk_id", F.lit(9)), path, ["provider", "model", "version"])
    assert sorted((r.chunk_id, r.model) for r in spark.read.parquet(path).collect()) == [(1, "m"), (3, "m"), (9, "m2")]
    cache = spark.createDataFrame([("h1", 1, "old")], "hash string, version int, out string")
    asked = spark.createDataFrame([("h1", 1), ("h1", 2), ("h2", 1)], "hash string, version int")
    results, fresh = sinks.with_cache(asked, cache, ["hash", "version"], lambda d: d.withColumn("out", F.lit("new")))
    assert sorted((r["hash"], r.version, r.out) for r in results.collect()) == [("h1", 1, "old"), ("h1", 2, "new"), ("h2", 1, "new")] and fresh.count() == 2


def test_postings_are_made_where_texts_lie(spark):
    """Rows of one key, null among them, count as one chunk; without such rows nothing is brought together."""
    rows = [(1, "the wolf ran, the wolf sat"), (2, "stone"), (1, "wolf"), (None, "river stone"), (None, "stone"), (3, None), (4, ""), (5, "of the"), (6, "Été 漢字 été")]
    chunks = spark.createDataFrame(rows, "chunk_id int, chunk_text string")
    want = {(1, "wolf"): [0, 1, 4], (1, "ran"): [2], (1, "sat"): [5], (2, "stone"): [0], (None, "river"): [0], (None, "stone"): [0, 1], (6, "été"): [0, 2], (6, "漢字"): [1]}
    assert {(r.chunk_id, r.term): r.positions for r in X.index(chunks, stemmed=False).collect()} == want
    lone = X.index(chunks.where("chunk_id > 1"), stemmed=False)
    assert "Exchange" not in lone._jdf.queryExecution().executedPlan().toString()
    assert {(r.chunk_id, r.term): r.positions for r in lone.collect()} == {k: v for k, v in want.items() if k[0] and k[0] > 1}
