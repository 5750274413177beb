"""The pipeline's stage of near duplicates: five-word shingles, similarity 0.8, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import simhash
from folioflow.llm.common import lower_table


def words(text):
    return (text or "").encode().translate(lower_table()).split()


def similarity(a, b):
    cut = lambda ws: {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else {()}
    x, y = cut(words(a)), cut(words(b))
    return len(x & y) / len(x | y)


def roots(n, linked):
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def corpus(rng, n=150):
    """Texts with exact and near copies, a chain of edits, and a passage that a third of them share."""
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(120)]
    texts = []
    for i in range(n):
        if i and rng.random() < 0.5:
            old = texts[rng.randrange(len(texts))].split()
            for _ in range(rng.randrange(1 + len(old) // 40)):
                old[rng.randrange(len(old))] = rng.choice(vocabulary)
            texts.append(" ".join(old).title() if rng.random() < 0.3 else " ".join(old))
        else:
            own = [rng.choice(vocabulary) for _ in range(rng.randrange(60, 240))]
            texts.append(" ".join(own + passage if rng.random() < 0.33 else own))
    return texts


def kept_ids(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    return sorted(r["doc_id"] for r in simhash.one_of_each(docs, **options).select("doc_id").collect())


def families(rng):
    """Texts of 120 to 300 words in families of six, whose members' similarity lies about 0.6, 0.7, 0.8 and 0.9."""
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = []
    for share in (0.6, 0.7, 0.75, 0.8, 0.85, 0.9):
        for _ in range(12):
            base = [rng.choice(vocabulary) for _ in range(rng.randrange(120, 300))]
            # An edit changes five shingles of each of two texts: a similarity of s needs about this many a text.
            edits = round(len(base) * (1 - share) / (1 + share) / 5)
            for _ in range(6):
                copy = list(base)
                for _ in range(edits):
                    copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
                texts.append(" ".join(copy))
    return texts


def check_against_similarity(texts, kept, recall=0.9):
    """By the texts' own shingles: nothing goes that has no partner, nearly every similar pair is in one class, one row a class."""
    near = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(texts[i], texts[j]) >= 0.8]
    partner = {i for p in near for i in p}
    gone = set(range(len(texts))) - set(kept)
    assert gone <= partner
    root = roots(len(texts), lambda i, j: (i, j) in pairs) if (pairs := set(near)) else list(range(len(texts)))
    # Classes by brute force keep a row each; more rows stay only for links that were not found.
    classes = set(root)
    assert classes <= set(kept) and len(kept) <= len(classes) + (1 - recall) * len(near)
    found = sum(i in gone or j in gone for i, j in near)
    assert found >= recall * len(near)
    return len(near)


def test_families_against_similarity(spark):
    texts = families(random.Random(7))
    assert check_against_similarity(texts, kept_ids(spark, texts)) > 100


def test_mixed_corpus_against_similarity(spark):
    texts = [*corpus(random.Random(1)), "", None, " \n", "few words", "Few words", "few words here now"]
    kept = kept_ids(spark, texts)
    assert check_against_similarity(texts, kept) > 40 and len(kept) < 0.8 * len(texts)


@pytest.mark.parametrize("crowd", [40, 12])
def test_crowded_groups_lose_no_link(spark, crowd):
    """A crowd of near copies, a crowd with a passage in common, both far above the size of a group."""
    rng = random.Random(4)
    texts = corpus(rng, 60)
    for edits in (1, 8):
        base = [f"b{edits}_{i}" for i in range(200)]
        for _ in range(70):
            copy = list(base)
            for _ in range(rng.randrange(1, edits + 1)):
                copy[rng.randrange(len(copy))] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    passage = " ".join(f"p{i}" for i in range(150))
    texts += [" ".join([passage, *(f"y{rng.random()}" for _ in range(150))]) for _ in range(70)]
    near = texts[-1].split()
    near[200] = "other"
    texts.append(" ".join(near))
    check_against_similarity(texts, kept_ids(spark, texts, crowd=crowd))


def test_estimates_lie_about_the_similarity():
    rng = random.Random(3)
    missed = []
    for text in families(rng)[::6]:
        ws = text.split()
        other = list(ws)
        for _ in range(len(ws) // 45):
            other[rng.randrange(len(other))] = "other"
        a, b = (np.frombuffer(simhash.Sketch([w.encode() for w in t]).bins, np.uint8)[None] for t in (ws, other))
        score, miss = simhash.estimated(a, b)
        missed.append(abs(score[0] - similarity(text, " ".join(other))) <= miss[0])
    assert np.mean(missed) > 0.95


def test_rows_of_any_id_and_type(spark):
    text = " ".join(f"word{i}" for i in range(80))
    near = text.replace("word7 ", "other ")
    rows = [(None, near), (None, text), (None, near), (5, text), (5, "quite another text"), (5, text), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"__row": F.lit(1), "key": F.lit("x"), "f0": F.lit(0), "tags": F.create_map(F.lit("a"), F.lit(1))})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    got = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert sorted(got, key=repr) == sorted([(5, text), (5, "quite another text"), (7, None)], key=repr)
    assert simhash.one_of_each(docs.where("text = 'quite another text'")).count() == 1
    assert simhash.one_of_each(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [0, 3])
def test_pipeline_cases(spark, small, tmp_path, n):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table through run()."""
    text = "The river runs past the old house and the garden with the light stone wall, on to the sea"
    rows = [(1, text, "en", "a", len(text))] * n + [(None, f"{text} {k}", "en", None, None) for k in range(n)] + [(2, None, None, None, None), (3, "", "en", "a", 0), (4, "?!", None, None, 2)][:n]
    folder = tmp_path / str(n)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"__row": F.lit(0), "__id": F.lit(1), "__text": F.lit("x"), "score": F.lit(2)}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{small}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
    found = corpus_pipeline.run(spark, str(folder)).collect()
    assert [(r["doc_id"], r["piece"]) for r in found] == ([(1, 0)] if n else [])
