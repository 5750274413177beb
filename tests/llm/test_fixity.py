"""Offsets and audits with null and repeated ids, null offsets, against plain Python."""

import random

from pyspark.sql import functions as F

from folioflow.llm import fixity


def test_offsets_of_null_and_repeated_ids(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, None, 3, 3, 5, 2000, 4000]), f"https://x/{rng.randrange(3)}", rng.choice(["", None, "<p>a</p>", "<p>bb</p>" * rng.randrange(4), "é漢" * 3000])) for _ in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(7)).withColumn("digest", F.lit("x"))
    placed, replica = fixity.drill(pages)
    got = placed.collect()
    by_archive = {}
    for r in sorted(got, key=lambda r: (r["archive"], r["page_id"] is not None, r["page_id"] or 0, r["digest"], r["offset"])):
        assert r["offset"] == by_archive.get(r["archive"], 0)
        by_archive[r["archive"]] = r["offset"] + r["length"]
    assert len(got) == 300 and set(by_archive) == {-1, 0, 1, 3}
    damage = [r["damage"] for r in fixity.audit(placed, replica).collect()]
    wanted = [r for r in got if r["lost"] or r["digest"] != r["replica_digest"]]
    assert len(damage) == len(wanted)
    assert fixity.drill(pages.limit(0))[0].collect() == []


def test_null_offsets_and_clashing_columns(spark):
    kind = "archive long, offset long, length long, digest string, no long, parent string, n int"
    one = spark.createDataFrame([(1, None, 5, "a", 1, "p", 2), (1, 0, 5, "b", 1, "p", 2)], kind)
    other = spark.createDataFrame([(1, None, 5, "z", 1, "p", 2), (1, 0, 5, "b", 1, "p", 2)], kind)
    assert [(r["archive"], r["offset"], r["damage"]) for r in fixity.audit(one, other).collect()] == [(1, -1, "changed")]
    assert fixity.audit(one, one).collect() == []
