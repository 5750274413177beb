"""Repeated strings of 100 bytes against a set of all strings seen before."""

import hashlib
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import suffixes
from folioflow.llm.queries import QUERIES


def plain(rows):
    """Results of rows (doc_id, text); equal rows count as one document stated again."""
    seen, results = set(), {}
    # Documents of one id with different texts have an order of their own; no fixture repeats strings between such.
    for doc, text in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            piece = data[i : i + 100]
            if piece in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(piece)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        results[doc, text] = (doc, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return sorted((results[r] for r in rows), key=repr)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def made(seed, documents=60):
    """Texts out of few passages, near copies, runs of one letter and letters of several bytes."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé漢") for _ in range(rng.randrange(1, 8))) for _ in range(200)]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 60))) for _ in range(12)] + ["x" * 400, "ab" * 150, "\U0001f642" * 60]
    rows = []
    for i in range(documents):
        text = " ".join(rng.choice(passages) if rng.random() < 0.6 else rng.choice(words) for _ in range(rng.randrange(12)))
        if rng.random() < 0.4 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("abé") + text[at + 1 :]
        rows.append((i, text))
    return rows


def test_query_equals_plain(spark, small):
    assert got(QUERIES["op11_bucket_pointers"](spark, small)) == plain(duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())


@pytest.mark.parametrize("crowd, part", [(suffixes.CROWD, suffixes.PART_BYTES), (3, 700), (1, 2000)])
def test_made_texts(spark, monkeypatch, crowd, part):
    """Also with nearly every anchor crowded, and texts gone through in many parts."""
    rows = made(4) + made(4)[:7] + [(None, "n" * 350), (None, "n" * 350), (1000, None), (1001, ""), (1002, "y" * 99), (1003, "z" * 100), (1004, "z" * 101)]
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(suffixes, "PART_BYTES", part)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    df = df.withColumns({c: F.lit(1) for c in ("doc", "sub", "packed", "bucket", "kind", "ranges", "kept", "n_spans")})
    assert got(suffixes.removals(df)) == plain(rows)
    assert suffixes.removals(df.limit(0)).collect() == []


def test_long_text_and_hot_passage(spark):
    """A text of several parts, and a passage that most documents hold, each between words of its own."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, " ".join([word(), word(), passage, word()]) if i % 3 else " ".join(word() for _ in range(30))) for i in range(300)]
    long = " ".join(word() for _ in range(400_000))
    rows += [(500, long), (501, "q" + long[2_000_000:2_200_000])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(suffixes.removals(df)) == plain(rows)


def test_refined_equals_sorting():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 6000).astype(np.uint8)
    data[1000:1400] = data[3000:3400]
    data[5000:5300] = 97
    ends = np.array([2000, 4000, 6000])
    starts = np.concatenate([np.arange(e - 2000, e - 99) for e in ends])
    numbers = suffixes.refined(data, starts, ends)
    by_bytes = {}
    for s, n in zip(starts.tolist(), numbers.tolist()):
        assert by_bytes.setdefault(data[s : s + 100].tobytes(), n) == n
    assert len(set(by_bytes.values())) == len(by_bytes)
