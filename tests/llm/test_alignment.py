"""Alignment of two tokenizers against loops over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import duckdb
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioflow.llm import alignment
from folioflow.llm.queries import QUERIES

NONE = (0, 0, 0, 0, 0, 0, "")


def ranges(spelled):
    out, at = [], 0
    for s in spelled:
        out.append((at, at + len(s)))
        at += len(s)
    return out


def plain(texts):
    """Results of texts by the given files themselves, every pair of tokens looked at within a window."""
    a_model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a_model.encode_special_tokens = True
    b_model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    shown = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    found, counts = [], Counter()
    for text in texts:
        found.append(None)
        if not text:
            continue
        said = " " + text
        a = a_model.encode(said, add_special_tokens=False).ids
        b = b_model.encode(text)
        a_bytes = [bytes(byte_of[c] for c in a_model.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        if b"".join(a_bytes) != said.encode() or b"".join(b_bytes) != said.encode():
            continue
        ra, rb = ranges(a_bytes), ranges(b_bytes)
        links, low = [], 0
        for i, (s, e) in enumerate(ra):
            while rb[low][1] <= s:
                low += 1
            j = low
            while j < len(rb) and rb[j][0] < e:
                links.append((a[i], b[j]))
                j += 1
        counts.update(links)
        ends = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, at = [], 0
        for e in ends:
            inside = [",".join(str(x) for x, (s, t) in zip(ids, r) if at <= s and t <= e) for ids, r in ((a, ra), (b, rb))] if len(text) < 2000 else None
            groups.append("|".join(inside) if inside else "")
            at = e
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if len(text) < 2000 else None
        found[-1] = (len(a), len(b), len(ends), links, digest)
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    return [NONE if f is None else (*f[:3], len(f[3]), sum(counts[p] == top[p[1]] for p in f[3]), sum(counts[p] for p in f[3]), f[4]) for f in found]


def same(got, texts):
    want = plain([t for _, t in texts])
    want = sorted(((i, *w) for (i, _), w in zip(texts, want)), key=lambda r: repr(r[:7]))
    got = sorted((tuple(r) for r in got.collect()), key=lambda r: repr(r[:7]))
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[:7] == w[:7]
        if w[7] is not None:
            assert g[7] == w[7]


def test_query_equals_plain(spark, small):
    same(QUERIES["op12_interval_index"](spark, small), duckdb.sql(f"select doc_id, text from '{small}/documents.parquet'").fetchall())


TEXTS = ["", None, " ", "  two  spaces ", "a", "\n\n\tx", "<|endoftext|> and <s> </s>", "▁under▁line", "漢字 é \U0001f642\U0001f469‍\U0001f4bb", "nul\0l", "é ﬁ", "it's we'll", "1234567 89", "a" * 3000, "word " * 5000]


@pytest.mark.parametrize("most", [0, 7, alignment.HEAD])
def test_cases_and_rare_pairs(spark, most):
    """Few or no pairs broadcast: the rest by shuffle, with the same results."""
    rng = random.Random(2)
    letters = "ab é漢\U0001f642\n'1<"
    rows = [(k if k % 5 else None, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (3, "a")] + [(100, "".join(rng.choice(letters) for _ in range(rng.randrange(40)))) for _ in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({c: F.lit(1) for c in ("pairs", "times", "n", "pair", "best", "__row", "n_a")})
    same(alignment.align(df, most=most), rows)
    assert alignment.align(df.limit(0), most=most).collect() == []
