"""Counts of texts that hashes confuse, of long texts in parts, and the verdict of the ratio, against plain Python."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from folioflow.llm import quality


def plain(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)]


def counts(text):
    t = quality.Texts(pa.array([text], pa.string()))
    return [int(x[0]) for x in (t.words(), t.word_chars(), t.symbols(), t.repeated_lines(), t.repeated_words())]


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") & 1] for i in range(n))


def test_words_and_lines_that_polynomials_confuse():
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    text = f"{one}\n{other}\n"
    assert counts(text) == plain(text) and counts(text)[3] == 0
    text = f"w x y z {one} end w x y z {other}"
    assert counts(text) == plain(text) and counts(text)[4] == 0


@pytest.fixture
def small_parts(monkeypatch):
    for name, value in (("HASH_BYTES", 64), ("SORTED", 16), ("COUNTED", 8)):
        monkeypatch.setattr(quality, name, value)
    monkeypatch.setattr(quality.parts, "__defaults__", (64,))


def test_long_texts_in_parts(small_parts):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice(["ab ", "a", "b", " ", "\n", "é漢 ", "#", "a b a b\n"]) for _ in range(rng.randrange(400)))
        assert counts(text) == plain(text), text


def test_equal_hashes_of_different_strings_take_another_seed(small_parts, monkeypatch):
    real = quality.digest
    monkeypatch.setattr(quality, "digest", lambda x, seed: real(x, seed) % 3 if seed < 8 else real(x, seed))
    text = " ".join(f"w{i % 23}" for i in range(200)) + "\n" + "\n".join(f"line {i % 7}" for i in range(40))
    assert counts(text) == plain(text)


def test_windows_with_equal_keys_take_another_factor(monkeypatch):
    monkeypatch.setattr(quality, "MULTIPLIER", np.uint64(0))  # at first, a window's key is its last word's only
    names = np.array([1, 2, 3, 4, 5, 9, 9, 8, 7, 5, 1, 2, 3, 4, 5], np.uint64)
    assert np.flatnonzero(quality.in_repeated_windows(names)).tolist() == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_long_text_in_bounded_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    words = np.array([f"word{i}" for i in range(200_000)])
    text = " ".join(words[rng.integers(0, len(words), 1_200_000)])
    tracemalloc.start()
    found = counts(text)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == 1_200_000 and peak < 10 * len(text)


def test_ratio_by_plain_python(spark):
    rng = random.Random(6)
    good, bad = "river stone house garden light".split(), "click here win now free".split()
    texts = {i: " ".join(rng.choice(good if i % 2 else bad) for _ in range(rng.randrange(10, 40))) for i in range(80)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    part = {r["__id"]: r["__part"] for r in quality.labelled_ids(labels).collect()}

    def buckets(text):
        words = [int(quality.mixed(np.array([quality.digest(w.encode(), quality.SEED)], np.uint64))[0]) for w in text.split()]
        mult, mask = int(quality.MULTIPLIER), (1 << 64) - 1
        pairs = [int(quality.mixed(np.array([(a * mult + b) & mask], np.uint64))[0]) for a, b in zip(words, words[1:], strict=False)]
        return [(x * mult & mask) >> (64 - quality.BUCKET_BITS) for x in words + pairs]

    corpus = Counter(b for t in texts.values() for b in buckets(t))
    target = Counter(b for i, t in texts.items() if part.get(i) == quality.TARGET for b in buckets(t))
    share = sum(target.values()) / sum(corpus.values())
    ratio = {b: math.log((target[b] + 1) / (corpus[b] * share + 1)) for b in corpus}
    score = {i: sum(ratio[b] for b in buckets(t)) / len(buckets(t)) for i, t in texts.items()}
    ones = {p: sorted(score[i] for i in part if part[i] == p) for p in (quality.HELD, quality.BAD)}
    cost = lambda at: quality.GOOD_WEIGHT * sum(s < at for s in ones[quality.HELD]) / len(ones[quality.HELD]) + sum(s >= at for s in ones[quality.BAD]) / len(ones[quality.BAD])
    threshold = min(ones[quality.HELD], key=lambda at: (round(cost(at), 9), at))
    for r in quality.assess(docs, labels).collect():
        assert r["score"] == pytest.approx(score[r["doc_id"]]) and r["threshold"] == pytest.approx(threshold)
        failed = len(texts[r["doc_id"]].split()) < quality.LEAST_WORDS or 100 * plain(texts[r["doc_id"]])[4] > quality.MOST_REPEATED * len(texts[r["doc_id"]].split())
        assert r["kept"] == (not failed and r["score"] >= r["threshold"] - 1e-12)  # a score equal to the threshold passes
    assert any(abs(s - threshold) < 1e-9 for s in score.values())


def test_all_labelled_documents_count(spark):
    labels = spark.range(45_000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality", "0 as toxic")
    counts = {r["__part"]: r["count"] for r in quality.labelled_ids(labels).groupBy("__part").count().collect()}
    assert counts[quality.BAD] == 22_500 == counts[quality.TARGET] + counts[quality.HELD]


def test_threshold_over_ranges_equals_plain(spark):
    rng = np.random.default_rng(2)
    good, bad = rng.normal(1, 1, 300).round(1), rng.normal(-0.5, 1, 200).round(1)
    rows = spark.createDataFrame([(quality.HELD, float(x)) for x in good] + [(quality.BAD, float(x)) for x in bad], "__part int, score double")
    assert quality.threshold_of(rows) == quality.best_threshold(good, bad)
    assert quality.threshold_of(rows.where(f"__part = {quality.HELD}")) == quality.best_threshold(good, np.array([]))
    assert quality.threshold_of(rows.where(f"__part = {quality.BAD}")) is None is quality.threshold_of(rows.limit(0))


def test_few_texts_meet_the_labels(spark):
    """All documents among the ids stay, and next to none of the others, whose texts needn't be shuffled."""
    docs = spark.range(40_000).selectExpr("id as doc_id", "'x' as text").union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    ids = spark.range(0, 40_000, 10).selectExpr("cast(id as int) as __id")
    found = {r["doc_id"] for r in quality.perhaps_among(docs, ids, "__id").collect()}
    assert set(range(0, 40_000, 10)) <= found and len(found) < 4_100
    assert quality.perhaps_among(docs, ids.limit(0), "__id").count() == 0
