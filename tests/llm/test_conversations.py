"""Repair of conversations against a plain search over edits, and the whole query against plain Python."""

import functools
import hashlib
import random
import re
import zlib

import duckdb
from pyspark.sql import functions as F

from folioflow.llm import conversations
from folioflow.llm.queries import QUERIES

WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain_repair(rows):
    """(cost, audit, repaired rows) of rows (role, text, must go, cut): the least pair over all suffixes."""

    @functools.cache
    def best(i, had, inserted):
        """had: initials' state as text; inserted: inserts at this row so far (more than three never help)."""
        found = []
        if i == len(rows) and had in ("", "a"):
            found.append((0, "", ()))
        given = "assistant" if had == "u" else "user"
        if inserted < 3:
            cost, audit, out = best(i, given[0], inserted + 1)
            found.append((cost + 2, "I" + audit, ((given, ""), *out)))
        if i < len(rows):
            role, text, gone, cut = rows[i]
            cost, audit, out = best(i + 1, had, 0)
            found.append((cost + 3, "D" + audit, out))
            if not gone:
                cost, audit, out = best(i + 1, given[0], 0)
                found.append((cost + 2 + cut, "R" + audit, ((given, text), *out)))
                if (had, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    cost, audit, out = best(i + 1, role[:1], 0)
                    found.append((cost + cut, "K" + audit, ((role, text), *out)))
        return min(found, default=(10**9, "~", ()))

    return best(0, "", 0)


def plain(rows):
    """All results by conversation of rows (conv_id, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        after = convs.setdefault(conv, [])
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        fault = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = said[2], said[3]
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        after += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv, after in convs.items():
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = {t for t, _, _ in after if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, role, text in after:
            blank = not text.strip(WHITE)
            twice = (role, text) in seen
            cut = not blank and text.strip(WHITE)[-1] not in ".!?"
            seen.add((role, text))
            first = [blank, twice and not blank, cut and not twice and not blank]
            counts = [a + b for a, b in zip(counts, first)]
            marked.append((role, text, blank or twice, int(first[2])))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(after, after[1:])]
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        cost, audit, fixed = plain_repair(tuple(marked))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_cheapest_equals_plain_search():
    rng = random.Random(3)
    for _ in range(400):
        rows = [(rng.choice(["system", "user", "assistant", "tool", "", "sys", "Assistant"]), f"t{i}", rng.random() < 0.2, rng.random() < 0.3) for i in range(rng.randrange(9))]
        codes = conversations.row_codes([r[0] for r in rows], [r[2] for r in rows], [False] * len(rows), [r[3] for r in rows])
        cost, audit, _ = plain_repair(tuple((r, t, g, int(c and not g)) for r, t, g, c in rows))
        assert conversations.cheapest(codes) == (cost, audit)


def test_ties_take_the_least_letter():
    code = conversations.row_codes(["assistant"], [False], [False], [False])
    # Delete (3) is dearer than an insert before it (2).
    assert conversations.cheapest(code) == (2, "IK")
    assert conversations.cheapest(b"") == (0, "")


def test_query_equals_plain(spark, small):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{small}/conversations.parquet'").fetchall()
    assert got(QUERIES["op13_tight_arcs"](spark, small)) == plain(rows)


def test_nulls_ties_repeats_and_clashing_columns(spark):
    rng = random.Random(5)
    texts = ["Yes.", "No", "", None, " \t\n", "Why?  \x0b", "é漢\U0001f642", "a.\nb", "x" * 300_000]
    rows = [(rng.choice([None, 1, 2, 3, 70]), rng.choice([None, 0, 1, 1, 5, 9]), rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(texts)) for _ in range(60)]
    rows += [(80 + i, None, "user", "Hi") for i in range(20)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("n", "copy", "phase", "blank", "gaps", "audit", "cut", "low")})
    assert got(conversations.repair_after_damage(df)) == plain(rows)
    assert got(conversations.repair_after_damage(df.limit(0))) == []


def test_one_conversation_with_most_rows(spark):
    """A conversation of 20,000 rows beside small ones: in order, whole, in one row."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"line {i}.") for i in range(20_000)] + [(8 + i % 50, i, "user", f"x {i}") for i in range(200)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    by_id = {r["conv_id"]: r for r in conversations.repair_after_damage(df).collect()}
    assert len(by_id) == 51
    dropped = sum(zlib.crc32(f"7:{i}".encode()) % 20 == 0 for i in range(20_000))
    edge = sum(zlib.crc32(f"7:{i}".encode()) % 20 == 0 for i in (0, 19_999))
    assert dropped - 2 <= by_id[7]["gaps"] + edge <= dropped + 2
    assert set(by_id[7]["audit"]) <= set("DIKR") and by_id[7]["cost"] > 0
