"""JSON containment with types, arrays, nulls and keys with dots, against the rules on single pairs."""

import json
import random

from folioflow.operators import paths as P

DOCS = [
    '{"k": 69}', '{"k": "69"}', '{"k": 69.0, "x": [1, 2]}', '{"a.b": 1}', '{"a": {"b": 1}}', '{"a": [{"b": 1, "c": 2}, {"b": 3}]}', '{"a": [{"b": 1}, {"c": 2}]}', '["foo", "bar"]', '[["foo"], "bar"]',
    '{"n": null}', "{}", "[]", "3", '"x"', "null", "true", '{"t": true, "u": "true"}', "no json", "", None, '{"tags": ["b", "a", "a"], "deep": {"er": {"x": [1, {"y": [2]}]}}}',
]
ASKED = [
    '{"k": 69}', '{"k": "69"}', '{"a.b": 1}', '{"a": {"b": 1}}', '{"a": [{"b": 1, "c": 2}]}', '{"a": [{"b": 1}, {"c": 2}]}', '"bar"', '["bar"]', '["foo"]', '{"n": null}', "{}", "[]", '{"a": []}', '{"a": {}}', "3", "null",
    '{"t": true}', '{"t": "true"}', '{"tags": ["a", "b"]}', '{"deep": {"er": {"x": [{"y": [2]}]}}}', '{"k": 70}',
]


def plain(docs, asked):
    out = set()
    for q, b in asked:
        for d, a in docs:
            try:
                if a is not None and P.holds(json.loads(a), json.loads(b)):
                    out.add((q, d))
            except ValueError:
                pass
    return out


def run(spark, docs, asked):
    d = spark.createDataFrame(docs, "doc_id int, meta string").repartition(3)
    return {tuple(r) for r in P.containing(d, spark.createDataFrame(asked, "query_id int, wanted string"), "doc_id", "meta").collect()}


def test_rules():
    yes = [("[1, 2]", "1"), ('{"a": [1, {"b": 2}]}', '{"a": [{"b": 2}]}'), ("[1, [2]]", "[[2]]"), ('{"k": 1.0}', '{"k": 1}'), ('{"a": 1}', "{}")]
    no = [("1", "[1]"), ('{"k": "1"}', '{"k": 1}'), ("[true]", "[1]"), ('{"a": {"b": 1}}', '{"b": 1}'), ("[[1]]", "1"), ("[]", "{}"), ('{"a": 1}', '{"a": null}')]
    assert all(P.holds(json.loads(a), json.loads(b)) for a, b in yes) and not any(P.holds(json.loads(a), json.loads(b)) for a, b in no)


def test_containment_equals_the_rules(spark):
    docs, asked = list(enumerate(DOCS)), list(enumerate(ASKED))
    assert run(spark, docs, asked) == plain(docs, asked)


def test_random_documents(spark):
    rng = random.Random(1)

    def value(depth=0):
        if depth < 3 and rng.random() < 0.5:
            return {rng.choice("ab"): value(depth + 1) for _ in range(rng.randrange(3))} if rng.random() < 0.5 else [value(depth + 1) for _ in range(rng.randrange(3))]
        return rng.choice([1, 2.5, "1", True, None])

    docs, asked = [(i, json.dumps(value())) for i in range(150)], [(i, json.dumps(value())) for i in range(40)]
    assert run(spark, docs, asked) == plain(docs, asked)
    assert run(spark, docs[:0] or [(0, None)], asked) == set()


def test_filters_take_a_dot_as_part_of_a_key(spark):
    from folioflow.operators.catalog import containment

    df = spark.createDataFrame([(1, '{"a.b": 1}'), (2, '{"a": {"b": 1}}'), (3, '{"a": {"b": 1}, "t": ["x", "y"]}'), (4, None)], "id int, meta string")
    ids = lambda wanted: sorted(r["id"] for r in df.where(containment("meta", wanted)).collect())
    assert ids({"a.b": 1}) == [1] and ids({"a": {"b": 1}}) == [2, 3] and ids({"t": ["y"]}) == [3] and ids({"a": {"b": 2}}) == []
