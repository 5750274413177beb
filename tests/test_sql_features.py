"""Table functions, stages of a search, XML reports: their errors and edges."""

import pytest

from folioflow.functions import table_functions
from folioflow.operators import search as S
from folioflow.operators.metrics import Stages
from folioflow.sources import web


def test_chunks_of_checks_its_arguments(spark):
    table_functions.register(spark)
    spark.createDataFrame([(1, "t", "a b c d a b"), (1, None, "a b"), (2, None, None), (3, "x", "")], "doc_id int, title string, body string").createOrReplaceTempView("some_sections")
    rows = spark.sql("select * from chunks_of(table(some_sections) partition by (doc_id), 2, 0)").collect()
    assert sorted((r.doc_id, r.chunk_index, r.section_title, r.chunk_text, r.token_count) for r in rows) == [(1, 0, "t", "a b", 2), (1, 1, "t", "c d", 2)]
    for call, message in (("chunks_of(1)", "must be a table"), ("chunks_of(table(select 1 as doc_id))", "no column title, body"), ("chunks_of(table(some_sections), 'x')", "whole number")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"select * from {call}").collect()


def test_stages_tell_their_rows(spark):
    chunks = spark.createDataFrame([(i, f"wolf stone river number{i} runs past many plain words", "t", 0) for i in range(12)], "chunk_id int, chunk_text string, title string, chunk_index int")
    queries = spark.createDataFrame([(1, "wolf river"), (2, "nothing here")], "query_id int, query string")
    stages = Stages()
    found = S.hybrid(chunks, queries, 5, stages=stages)
    by_name = {name: n for name, n, _ in stages.events}
    assert by_name["queries"] == 2 and by_name["keyword"] == 12 and by_name["fused"] == 12 and by_name["features"] == 12 and by_name["ranked"] == found.count() == 5
    rows = stages.rows(spark, "s1").orderBy("event_index").collect()
    assert [(r.job_id, r.event_index, r.name, int(r.details["rows"])) for r in rows] == [("s1", i, n, k) for i, (n, k, _) in enumerate(stages.events)] and all(r.ms > 0 for r in rows)
    assert sorted(map(tuple, S.hybrid(chunks, queries, 5).collect())) == sorted(map(tuple, found.collect()))


def test_reports_of_every_kind(spark):
    given = {
        "one": '<?xml version="1.0"?><testsuite tests="3" failures="1" time="0.25"><testcase name="a"/></testsuite>',
        "none": "<testsuites/>",
        "cover": '<?xml version="1.0"?>\n<!-- made --><coverage line-rate="0.8765" version="7"><packages/></coverage>',
        "odd": '<testsuites><testsuite tests="x" errors="" skipped="2"/></testsuites>',
        "other": "<html/>",
        "cut": "<testsuite tests='1'",
        "text": "no report",
        "null": None,
    }
    rows = web.ci_reports(spark.createDataFrame(list(given.items()), "project string, report string")).collect()
    found = {(r.project, r.metric): r.value for r in rows}
    assert found["one", "tests"] == 3 and found["one", "test_failures"] == 1 and found["one", "skipped_tests"] == 0 and found["one", "test_execution_time_ms"] == 250
    assert found["none", "tests"] == 0 and found["cover", "coverage_percent"] == 87.65 and ("odd", "tests") in found and found["odd", "tests"] == 0 and found["odd", "skipped_tests"] == 2
    assert found["cut", "corrupt"] is None and {p for p, m in found if m == "corrupt"} >= {"cut", "null"} and not any(p == "other" for p, _ in found)
