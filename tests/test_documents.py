"""Answers, graphs, page clean-up, routing, files, jobs, streams."""

import io
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.operators import answer as A
from folioflow.operators import catalog as C
from folioflow.operators import cleanup as P
from folioflow.operators import embedding as E
from folioflow.operators import graph as G
from folioflow.operators import jobs as J
from folioflow.operators import routing as R
from folioflow.sources import files, web
from folioflow.streaming import logs as L

SOURCES = "array<struct<rank:int,chunk_index:int,chunk_text:string>>"
TEXT = "Marley was dead to begin with, and Scrooge knew that he was dead."


@pytest.mark.parametrize(
    "answer,query,reason",
    [
        ("", "", "empty_answer"),
        ("insufficient_context", "", "model_reported_insufficient_context"),
        ("Marley was dead. [Source rank 1, chunk 8]", "", "answer_citations_match_selected_context"),
        ("Marley was dead.", "", "answer_has_no_source_rank_citations"),
        ("It can be inferred that Marley died [Source rank 1]", "", "answer_uses_unsupported_inference_language"),
        ("Marley was dead [Source rank 2]", "", "answer_cites_source_ranks_not_in_context"),
        ("Marley was dead [Source rank 1, chunk 9]", "", "answer_cites_wrong_chunk_for_source_rank"),
        ("Marley was dead [Source rank 1, chunk 8]", "What did Cratchit do", "query_named_anchors_not_found_in_selected_context"),
        ("Elephants juggle bananas daily around volcanoes [Source rank 1]", "", "answer_terms_not_supported_by_selected_context"),
    ],
)
def test_verdicts(spark, answer, query, reason):
    df = spark.createDataFrame([(answer, query, [(1, 8, TEXT)])], f"answer string, query string, sources {SOURCES}")
    assert A.verified(df).first().reason == reason


def results(spark, *rows):
    return spark.createDataFrame([(1, "Who is Marley", "factual_question", *r) for r in rows], "query_id int, query string, intent string, rank int, chunk_id string, title string, chunk_index int, page_start int, page_end int, section_title string, chunk_text string")


def test_context_budget_keeps_all_sources(spark):
    long = "Some filler words stand here. " * 60
    rows = [(1, "a", "T", 1, 19, 21, None, long), (2, "b", "T", 2, None, None, None, long), (3, "c", "T", 3, 5, 5, "S", long + "Marley appears here at last.")]
    out = A.packed_context(results(spark, *rows), 3, 1800, 900).first()
    assert [s["rank"] for s in out.sources] == [3, 1, 2] and len(out.context) <= 1800 + 4
    assert out.context.startswith("[Source rank 3, title T, chunk 3, page 5, section S]") and "page 19-21]" in out.context and "Marley appears" in out.context


def test_failing_model_makes_a_row(spark):
    contexts = A.packed_context(results(spark, (1, "a", "T", 8, None, None, None, TEXT)))

    def broken(prompts):
        raise RuntimeError("gone")

    rows = {r.model: r for r in A.answered(contexts, {"good": A.extractive, "bad": broken}).collect()}
    assert rows["good"].ok and "[Source rank 1" in rows["good"].answer
    assert not rows["bad"].ok and rows["bad"].error == "RuntimeError: gone"
    verdict = A.settled(A.verified(A.answered(contexts, {"good": A.extractive}))).first()
    assert verdict.status == "answered"


def test_graph(spark):
    m = spark.createDataFrame(
        [(1, "c1", 0, 0, "Sri  Ramana", None, None, 0.5), (1, "c2", 1, 0, "sri ramana", "person", "a sage", 0.9), (1, "c2", 1, 1, "Paul", "person", None, None), (1, "c2", 1, 2, "!!", "x", None, None)],
        "resource_id int, chunk_id string, chunk_index int, position int, name string, entity_type string, description string, confidence double",
    )
    nodes = G.entities(m)
    found = {r.entity_key: r for r in nodes.collect()}
    ramana = found["sri ramana"]
    assert set(found) == {"sri ramana", "paul"} and (ramana.name, ramana.entity_type, ramana.description, ramana.confidence, ramana.chunk_count) == ("Sri  Ramana", "PERSON", "a sage", 0.9, 2)
    e = spark.createDataFrame([(1, "c1", 0, "Paul", "Sri Ramana", "met", None, 0.2), (1, "c2", 1, "paul", "sri-ramana", "MET", "x", 0.4), (1, "c2", 1, "paul", "Paul", "is", None, None), (1, "c2", 1, "paul", "nobody", "met", None, None)], "resource_id int, chunk_id string, chunk_index int, source string, target string, relationship_type string, description string, confidence double")
    rel = G.relationships(e, nodes).collect()
    assert [(r.source_key, r.target_key, r.relationship_type, r.mention_count, r.confidence, r.description) for r in rel] == [("paul", "sri ramana", "MET", 2, 0.4, "x")]


def test_communities_of_a_path(spark):
    edges = spark.createDataFrame([(1, f"n{i:02d}", f"n{i + 1:02d}") for i in range(20)] + [(2, "a", "b")], "resource_id int, source_key string, target_key string")
    rows = G.communities(edges).collect()
    assert {r.community for r in rows if r.resource_id == 1} == {"n00"} and len(rows) == 23


def test_page_cleanup(spark):
    page = "[Page {0}]\nA Christmas Carol\nThen {0} gentle-\nmen spoke{1} with mer- ry hearts.\n{0}\nFree eBooks at Planet eBook.com\n"
    text = "\n".join(page.format(i, x) for i, x in ((1, " andpresented"), (2, ""), (3, " hadwarned"))) + "\nM\narley was dead\n"
    out = P.cleaned(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).orderBy("doc_id").collect()
    one = out[0]
    assert (one.repeated_lines, one.boilerplate_lines, one.page_number_lines, one.joined_words) == (3, 3, 3, 2)
    assert "gentlemen spoke and presented with merry hearts." in one.text and "Marley was dead" in one.text and "Carol" not in one.text and "[Page 2]" in one.text
    assert out[1].text == ""


@pytest.mark.parametrize(
    "question,tool,arguments",
    [
        ("Show books by the Paul Brunton in stock", "get_books_by_author", {"author": "Paul Brunton"}),
        ("details 123e4567-e89b-12d3-a456-426614174000", "get_resource_detail", {"resource_id": "123e4567-e89b-12d3-a456-426614174000"}),
        ("Which facets are there?", "get_available_facets", {}),
        ("show pending approval requests", "search_approval_requests", {"status": "PENDING"}),
        ("find users smith with status active", "search_users", {"q": "smith", "status": "ACTIVE"}),
        ("find books about rivers", "search_catalog_resources", {"q": "about rivers"}),
        ("what is checked out", "get_user_bookshelf", None),
        ("hello", None, None),
    ],
)
def test_routing(spark, question, tool, arguments):
    r = R.routed(spark.createDataFrame([(question,)], "question string")).first()
    assert (r.tool, r.arguments) == (tool, arguments)


def archive(**entries):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in entries.items():
            z.writestr(name.replace("__", "/").replace("_dot_", "."), text)
    return out.getvalue()


def test_files(spark, tmp_path):
    opf = '<package xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Carol</dc:title><dc:creator>Dickens</dc:creator><dc:date>1843-12-19</dc:date></metadata><manifest><item id="b" href="b.xhtml"/><item id="a" href="a.xhtml"/></manifest><spine><itemref idref="a"/><itemref idref="b"/></spine></package>'
    (tmp_path / "x.epub").write_bytes(archive(**{"META-INF__container_dot_xml": '<c><rootfiles><rootfile full-path="OPS/p.opf"/></rootfiles></c>', "OPS__p_dot_opf": opf, "OPS__a_dot_xhtml": "<p>First &amp; best</p><script>no</script>", "OPS__b_dot_xhtml": "<p>Second</p>"}))
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "y.docx").write_bytes(archive(**{"word__document_dot_xml": body}))
    (tmp_path / "z.txt").write_bytes(b"plain \xff text")
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    rows = {r.file_name: r for r in files.extracted(files.files(spark, str(tmp_path))).collect()}
    assert (rows["x.epub"].text, rows["x.epub"].title, rows["x.epub"].author, rows["x.epub"].published) == ("First & best\n\nSecond", "Carol", "Dickens", "1843-12-19")
    assert rows["y.docx"].text == "Hello\n\na | b"
    assert rows["z.txt"].text == "plain � text"
    assert rows["bad.epub"].text is None and "BadZipFile" in rows["bad.epub"].error


def test_large_files_are_rows_with_an_error(spark, tmp_path):
    from folioflow.sources import files

    (tmp_path / "small.txt").write_text("few words")
    (tmp_path / "large.txt").write_text("many words " * 100)
    rows = {r.file_name: r for r in files.extracted(files.files(spark, str(tmp_path), 50)).collect()}
    assert rows["small.txt"].text == "few words" and rows["small.txt"].error is None
    assert rows["large.txt"].text is None and rows["large.txt"].error == "larger than 50 bytes: 1100" and rows["large.txt"].length == 1100


def test_extraction_by_a_model_falls_back_to_single_texts(spark):
    from folioflow.operators import graph as G

    def model(prompts):
        if len(prompts) > 1 and any("bad" in p for p in prompts):
            raise RuntimeError("batch lost")
        if any("bad" in p for p in prompts):
            raise ValueError("cannot read it")
        return ['Here: ```json\n{"entities": [{"name": "Ada", "type": "person", "confidence": 0.5}], "relationships": [{"source": "Ada", "target": "Bob", "type": "knows"}]}\n```' if "Ada" in p else "no idea" for p in prompts]

    chunks = spark.createDataFrame([(1, i, i, t) for i, t in enumerate(["Ada here", "bad one", "Ada there", "nothing", None])], "resource_id int, chunk_id int, chunk_index int, chunk_text string").coalesce(1)
    mentions, edges, errors = G.extracted(chunks, model, 3)
    assert sorted((r.chunk_id, r.name, r.entity_type, r.confidence) for r in mentions.collect()) == [(0, "Ada", "person", 0.5), (2, "Ada", "person", 0.5)]
    assert sorted((r.chunk_id, r.source, r.target, r.relationship_type) for r in edges.collect()) == [(0, "Ada", "Bob", "knows"), (2, "Ada", "Bob", "knows")]
    assert {r.chunk_id: r.error for r in errors.collect()} == {1: "ValueError: cannot read it", 3: "no JSON of entities and relationships", 4: "no JSON of entities and relationships"}
    assert G.entities(mentions).first().mention_count == 2 and G.relationships(edges, G.entities(mentions)).count() == 0
    given = spark.createDataFrame([(1, "e" * 20_000, "r")], "resource_id int, entities string, relationships string")
    found = G.summarised(given, lambda ps: [str(len(p)) for p in ps]).first()
    assert found.summary == str(len(G.SUMMARY_PROMPT) + G.FACT_CHARS) and found.error is None


def test_changes_of_one_key(spark):
    table, changes = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "k int, v string, t int"), spark.createDataFrame([(2, "x", 2), (2, "y", 1), (3, "z", 1), (3, "z", 1)], "k int, v string, t int")
    from folioflow.operators import jobs as J

    assert sorted(map(tuple, J.upserted(table, changes, ["k"], ["t"]).collect())) == [(1, "a", 0), (2, "x", 2), (3, "z", 1)]
    assert sorted(map(tuple, J.upserted(table, changes, ["k"]).collect())) == [(1, "a", 0), (2, "y", 1), (3, "z", 1)]


def test_request_over_file_metadata(spark):
    found = spark.createDataFrame([("p", "File", "en")], "path string, title string, language string")
    asked = spark.createDataFrame([("p", "  ", "de")], "path string, title string, language string")
    r = files.with_request(found, asked).first()
    assert (r.title, r.language) == ("File", "de")


def test_server_sent_events(spark):
    rows = web.events_of(spark.createDataFrame([(1, 'event: a\ndata: {"x":\ndata: 1}\n\ndata: y\n\n')], "id int, text string")).orderBy("seq").collect()
    assert [(r.event, r.data) for r in rows] == [("a", '{"x":\n1}'), ("message", "y")]


def test_weather(spark):
    df = spark.createDataFrame([('{"current_condition": [{"temp_F": "50", "humidity": "40", "windspeedMiles": "5", "winddir16Point": "N", "weatherDesc": [{"value": "Sunny"}]}]}',)], "t string")
    w = df.select(web.weather_of_json("t").alias("w")).first().w
    assert (w.temperature_c, w.condition, w.wind, w.humidity) == (10.0, "Sunny", "5 mph N", 40)


def test_embedding_retries_by_halves(spark):
    def model(texts):
        if len(texts) > 2 or "bad" in texts:
            raise RuntimeError("too much")
        return np.ones((len(texts), 3))

    df = spark.createDataFrame([("a",), ("b",), ("bad",), (None,)], "text string")
    rows = {r.text: r for r in E.embedded(df, model, 3).collect()}
    assert rows["a"].vector == [1.0, 1.0, 1.0] and rows["bad"].vector is None and "too much" in rows["bad"].error and rows[None].error is None
    assert E.model_error("gpt-4o", 768) and E.model_error("nomic-embed-text", 512) and not E.model_error("nomic-embed-text", 768)


def test_embedding_input(spark):
    df = spark.createDataFrame([("My Title", "[Page 3] My Title 12 the text", "Part", 3, 4)], "t string, c string, s string, a int, b int")
    assert df.select(E.input_text("t", "c", section="s", page_start="a", page_end="b")).first()[0] == "Title: My Title\nSection: Part\nPage: 3-4\n\nthe text"


def test_stale_jobs(spark):
    rows = [(1, "PROCESSING", "2024-01-01 00:00:00", 0), (2, "PROCESSING", "2024-01-01 00:09:30", 0), (3, "PROCESSING", None, 3), (4, "QUEUED", None, 0)]
    jobs = spark.createDataFrame(rows, "job_id int, status string, h string, retry_count int").withColumn("heartbeat_at", F.col("h").cast("timestamp_ntz")).drop("h")
    jobs = jobs.withColumns({"max_retries": F.lit(3), "worker_id": F.lit("w"), "error_message": F.lit(None).cast("string"), "next_retry_at": F.lit(None).cast("timestamp_ntz")})
    out = {r.job_id: r for r in J.recovered(jobs, F.lit("2024-01-01 00:10:00").cast("timestamp_ntz"), 60).collect()}
    assert (out[1].status, out[1].retry_count, str(out[1].next_retry_at)) == ("QUEUED", 1, "2024-01-01 00:11:00")
    assert out[2].status == "PROCESSING" and out[3].status == "FAILED" and out[4].retry_count == 0


def test_reject_policy(spark):
    f = spark.createDataFrame([("h1",), ("h2",)], "file_hash string")
    known = spark.createDataFrame([("h1", "READY"), ("h2", "FAILED")], "file_hash string, status string")
    assert [r.file_hash for r in J.ingested(f, known, "reject").collect()] == ["h2"]
    assert {r.file_hash: r.version for r in J.ingested(f, known).collect()} == {"h1": 2, "h2": 1}


def test_streams(spark, tmp_path, small):
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    L.drained(L.window_counts(L.event_stream(spark, str(tmp_path / "in"), schema, 10)), "counts", "complete", str(tmp_path / "c1"))
    streamed = {(r.window_start, r.event_type): r.n for r in spark.table("counts").collect()}
    assert streamed == {(r.window_start, r.event_type): r.n for r in L.window_counts(events).collect()}
    seen = []
    L.drained(L.job_states(L.event_stream(spark, str(tmp_path / "in"), schema, 10)), "", "update", str(tmp_path / "c2"), lambda df, i: seen.append(df.toPandas()))
    last = pd.concat(seen).groupby("job_id").last()
    pdf = events.toPandas()
    for job, rows in pdf.groupby("user_id"):
        assert L.fold(("QUEUED", 0, pd.Timestamp(0)), rows)[:2] == (last.loc[job].status, last.loc[job].retries)


def test_catalog_checks(spark):
    with pytest.raises(ValueError):
        C.checked_page(0, 0)
    with pytest.raises(ValueError):
        C.checked_page(10, -1)
    assert C.cleaned("  ") is None and C.cleaned(" a ") == "a"
    df = spark.createDataFrame([('{"a": {"b": 1}, "t": ["x", "y"], "f": true}',)], "m string")
    test = lambda w: df.where(C.containment("m", w)).count() == 1
    assert test({"a": {"b": 1}}) and test({"t": ["y"]}) and test({"f": True}) and not test({"t": ["z"]}) and not test({"g": 1})
