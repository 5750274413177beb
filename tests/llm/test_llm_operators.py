"""The numbered operators against plain Python, on fixtures with nulls, empty and long texts, repeated rows and clashing columns."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from folioflow.llm import decontaminate, fixity, langid, lengths, licenses, maintext, packing, pii, quality, simhash
from folioflow.llm.common import Scratch, lower_table, pieces
from folioflow.llm.components import components
from folioflow.llm.queries import ORACLES, QUERIES

LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog, licensed under CC BY-NC 4.0 today."),
    (1, "The quick brown fox jumps over the lazy dog, licensed under CC BY-NC 4.0 today."),
    (2, None),
    (3, ""),
    (4, " \n\t"),
    (5, LONG),
    (6, "Mail bob@example.com or +1 (555) 123-4567, 10.0.0.256 no, 10.0.0.1 yes, 4111 1111 1111 1111."),
    (None, "Ein Text ohne Kennung, der trotzdem gelesen wird."),
    (7, "漢字 and é, with 🙂 <|endoftext|> inside"),
]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with columns whose names clash with the operators' own."""
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").repartition(3)
    clash = {c: F.lit(0) for c in ("fp", "score", "piece", "length", "component_id", "term", "label", "__row", "u", "v", "lang_pred")}
    return df.withColumns(clash | {"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def by_id(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# 1


def test_fixity_finds_exactly_the_damage(spark, small, duck, compare):
    compare(QUERIES["op1_merkle_fixity"](spark, small), duck, ORACLES["op1_merkle_fixity"])


def test_fixity_cases(spark):
    kind = "archive long, offset long, length long, digest string"
    one = [(0, i * 70_000, 5, f"d{i}") for i in range(40)] + [(None, 0, 1, "n"), (2, 0, 1, "only here"), (3, 5, 1, "a"), (3, 5, 1, "a")]
    other = [(0, i * 70_000, 5, "x" if i == 17 else f"d{i}") for i in range(40) if i != 30] + [(None, 0, 1, "n"), (0, 71, 2, "new"), (3, 5, 1, "a")]
    found = fixity.audit(spark.createDataFrame(one, kind), spark.createDataFrame(other, kind))
    assert by_id(found, "archive", "offset", "damage") == [(0, 17 * 70_000, "changed"), (0, 30 * 70_000, "missing"), (0, 71, "extra"), (2, 0, "missing"), (3, 5, "changed")]
    none = spark.createDataFrame([], kind)
    assert fixity.audit(none, none).count() == 0
    same = spark.createDataFrame(one, kind)
    assert fixity.audit(same, same).count() == 0


def test_fixity_descends_only_where_roots_differ(spark):
    kind = "archive long, offset long, length long, digest string"
    rows = [(a, i * 65_536, 5, f"{a}-{i}") for a in range(3) for i in range(50)]
    scratch = Scratch(spark, "t")
    tree = fixity.build(spark.createDataFrame(rows, kind), 3, scratch)
    changed = fixity.build(spark.createDataFrame([(a, o, n, "x" if (a, o) == (1, 0) else d) for a, o, n, d in rows], kind), 3, scratch)
    roots = [{r.archive: r.digest for r in t.levels[3].collect()} for t in (tree, changed)]
    assert [a for a in range(3) if roots[0][a] != roots[1][a]] == [1] and len(roots[0]) == 3


# 2


def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def test_length_sums(spark, docs, nothing):
    sizes = np.array([len(e.ids) for e in tokenizer().encode_batch([t or "" for _, t in TEXTS], add_special_tokens=False)])
    sums = lengths.with_sums(lengths.encoded_lengths(docs))
    for r in sums.collect():
        n = r.length
        assert (r.n_docs, r.docs_longer, r.docs_within) == ((sizes == n).sum(), (sizes > n).sum(), (sizes <= n).sum())
        assert (r.tokens_within, r.tokens_kept, r.tokens_lost) == (sizes[sizes <= n].sum(), np.minimum(sizes, n).sum(), (sizes - np.minimum(sizes, n)).sum())
    for r in lengths.at_limits(sums, [0, 3, 2048, 10**9]).collect():
        assert (r.tokens_kept, r.docs_longer) == (np.minimum(sizes, r.limit).sum(), (sizes > r.limit).sum())
    assert [r.length for r in lengths.value_at(sums, [1.0]).collect()] == [sizes.max()]
    assert lengths.with_sums(lengths.encoded_lengths(nothing)).count() == 0


# 3


def page(body, head="<title>T</title>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{body}</body></html>"


ARTICLE = "".join(f"<p>Paragraph {i} has a fair number of plain words in it, as articles do.</p>" for i in range(4))
PLAIN = "\n".join(f"Paragraph {i} has a fair number of plain words in it, as articles do." for i in range(4))
NOISE = '<header><a href="/">Home</a></header><nav><ul><li><a>One</a></ul></nav><div class="cookie-banner">We use cookies on this site for many reasons and purposes.</div>'
TAIL = '<aside>Related things to read next time around here.</aside><div id="comments"><p>I liked this article very much indeed, thank you all.</p></div><form>Search <input></form><footer>&copy; all of us</footer>'


@pytest.mark.parametrize(
    "html,text",
    [
        (None, ""),
        ("", ""),
        (page(f"{NOISE}<article><h1>Title</h1>{ARTICLE}</article>{TAIL}"), f"Title\n{PLAIN}"),
        (page(f'{NOISE}<div class="wrap"><div><h2>Title</h2>{ARTICLE}</div></div>{TAIL}'), f"Title\n{PLAIN}"),
        (page(f'<div class="sidebar"><p>{"Side words of no use here at all. " * 9}</p></div><main>{ARTICLE}</main>'), PLAIN),
        (page(f"<article>{ARTICLE}<script>var a = '<p>no</p>';</script><style>p</style></article>"), PLAIN),
        (page("<article><p>A &amp; B &lt;i&gt;  spaced\n out<p>unclosed <b>bold</article>"), "A & B <i> spaced out\nunclosed bold"),
        ("just text", "just text"),
        ("a<!-->b<!-- c > d", "ab"),
    ],
)
def test_main_text(html, text):
    assert maintext.main_text(html) == text


def section(name, size):
    return f"<h2>Head {name}</h2>" + "".join(f"<p>{name}{i} {('plain words of it ' * 40)[:size]}</p>" for i in range(4))


def test_main_text_of_several_sections():
    parts = [section("a", 500), section("b", 450)]
    wanted = ["Head a", "a0", "a1", "a2", "a3", "Head b", "b0", "b1", "b2", "b3"]
    for body in (f'<div class="wrap"><section>{parts[0]}</section><section>{parts[1]}</section></div>', f'<article><div class="post-part">{parts[0]}</div><div class="post-part">{parts[1]}</div></article>'):
        lines = maintext.main_text(page(f"{NOISE}{body}{TAIL}")).split("\n")
        assert [line[: len(w)] for line, w in zip(lines, wanted, strict=True)] == wanted
    lead = "A lead of one sentence that is far shorter than the article below it, though as dense as it."
    long = "".join(f"<p>{('More plain words. ' * 5)}</p>" for _ in range(40))
    assert maintext.main_text(page(f"{NOISE}<div><div>{lead}</div><section>{long}</section></div>{TAIL}")).startswith(lead)


@pytest.mark.parametrize(
    "before,after",
    [
        ('<div class="site has-sidebar">', "</div>"),
        ('<div id="content-no-sidebar">', "</div>"),
        ('<div class="page menu-open">', "</div>"),
        ("<form id='aspnetForm'>", "</form>"),
        ('<div class="comments-open">', "</div>"),
    ],
)
def test_main_text_in_wrappers_named_like_boilerplate(before, after):
    for body in (f"<article>{ARTICLE}</article>", f"<div><div>{ARTICLE}</div></div>"):
        assert maintext.main_text(page(f"{before}{body}{after}")) == PLAIN
    assert maintext.main_text(page(f"{before}<article>{ARTICLE}</article>{TAIL}{after}<footer>outside</footer>")) == PLAIN
    assert maintext.main_text(page(f'<article>{ARTICLE}</article><div class="comments">{ARTICLE * 3}</div>')) == PLAIN


def test_main_text_of_pages(spark, small):
    for r in maintext.op3_text_density(spark, small).collect():
        assert r.n_chars == len(r.text) and r.text == re.sub(r"[^\S\n]+", " ", r.text).strip()
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    import html

    for r in maintext.op3_text_density(spark, small).collect():
        inner = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("<p>|</p>|<h1>|</h1>|<br>", inner))
        assert r.text == "\n".join(b for b in blocks if b)


def test_broken_pages_end(spark):
    for text in ("<", "<p", "<!--", "<script>", "<a title=\"", "</p></div>", "<table><tr><td>a<td>b<tr><td>c", "<ul><li>a<li>b", "<p>" * 3000 + "deep", "a<b " * 100_000, "<div>x " * 30_000, "<header>" * 30_000, "<script>" + "</script " * 50_000):
        assert isinstance(maintext.main_text(text), str)


# 4


def brute_base(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    hits = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), len(hits), min((i for i, _ in hits), default=None), max((i for i, _ in hits), default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_base(spark, docs, small, nothing):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op4_aho_corasick"](spark, small).collect():
        assert brute_base(texts[r.doc_id]) == (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert sorted(r.n_words for r in licenses.scan(docs).collect()) == sorted(brute_base(t)[0] for _, t in TEXTS)
    assert licenses.scan(nothing).count() == 0
    scanner = licenses.Scanner()
    for text in ("cc by cc by", "CC-BY\nall rights  reserved, General/Public+License", "bycc by", ""):
        n, found, _ = scanner.scan(text.encode())
        assert (n, sum(b for _, b, _ in found)) == brute_base(text)[:2]


@pytest.mark.parametrize(
    "text,names,restriction",
    [
        ("MIT OR GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.1),
        ("MIT AND GPL-3.0-only", {"mit", "gpl-3.0-only"}, 0.6),
        ("MIT OR GPL-3.0 AND LGPL-2.1", {"mit", "gpl-3.0", "lgpl-2.1"}, 0.1),
        ("(MIT OR GPL-3.0) AND LGPL-2.1", {"mit", "gpl-3.0", "lgpl-2.1"}, 0.4),
        ("GPL-2.0 WITH Classpath-exception-2.0 */", {"gpl-2.0", "classpath-exception-2.0"}, 0.3),
        ("MIT AND (GPL-2.0", {"mit", "gpl-2.0"}, 0.6),
    ],
)
def test_licence_expressions(text, names, restriction):
    assert licenses.evaluate(text) == (names, restriction)
    n, found, score = licenses.Scanner().scan(f"// SPDX-License-Identifier: {text}\nnext AND line".encode())
    assert {x for x, _, _ in found} == names and score == restriction
    assert licenses.evaluate("...") is None


# 5


def brute_quality(text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    counts = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if counts[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_counts(spark, small, docs, nothing):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op5_ngram_ratio"](spark, small).collect():
        assert tuple(r[c] for c in COUNTS) == brute_quality(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words) and not (r.kept and r.base_failed)
    labels = spark.createDataFrame([(1, 1, 0), (6, 1, 0), (5, 0, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.assess(docs, labels)
    assert sorted(tuple(r[c] for c in COUNTS) for r in out.collect()) == sorted(brute_quality(t) for _, t in TEXTS)
    assert quality.assess(docs, labels.limit(0)).where("kept = base_failed").isEmpty()
    assert quality.assess(nothing, labels).count() == 0


def test_quality_hashes_on_random_texts():
    rng = np.random.default_rng(3)
    for _ in range(200):
        texts = ["".join(rng.choice(list("ab \n\n\t#é漢 "), rng.integers(0, 150))) for _ in range(rng.integers(1, 6))] + [None]
        t = quality.Texts(pa.array(texts, pa.string()))
        assert list(zip(*(x.tolist() for x in (t.words(), t.word_chars(), t.symbols(), t.repeated_lines(), t.repeated_words())), strict=True)) == [brute_quality(x) for x in texts]


def test_quality_ratio_and_threshold(spark):
    texts = pa.array(["a b a", "", "c"], pa.string())
    bucket, doc = quality.Texts(texts).ngrams()
    assert Counter(doc.tolist()) == {0: 5, 2: 1} and len(set(bucket[doc == 0].tolist())) == 4
    rows = spark.createDataFrame([("a b a", 1), ("c", 0), (None, 0)], "text string, __part int")
    corpus, target = quality.corpus_counts(rows)
    assert (corpus.sum(), target.sum()) == (6, 5) and (corpus >= target).all()
    good, bad = np.array([0.0, 1.0, 2.0, 3.0]), np.array([-1.0, -0.5])
    assert quality.best_threshold(good, bad) == 0.0 and quality.best_threshold(good, np.array([])) == 0.0 and quality.best_threshold(np.array([]), bad) is None


# 6


def test_language_held_out_accuracy(spark, medium):
    docs = spark.read.parquet(f"{medium}/documents.parquet")
    rows = QUERIES["op6_byte_cnn"](spark, medium).join(docs.select("doc_id", "lang"), "doc_id").collect()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r.lang == r.lang_pred for r in rows if r.held_out]
    assert sum(held) / len(held) >= 0.97


def test_language_cases(spark, docs, nothing):
    rows = by_id(langid.identify(docs), "doc_id", "lang_pred", "score")
    assert {r[1] for r in rows if r[0] in (2, 3, 4)} == {"und"} and {r[1] for r in rows if r[0] in (1, 5, 6, 7, None)} == {"en"} and len(rows) == len(TEXTS)
    kept = langid.in_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 3
    assert langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").isEmpty()
    assert langid.identify(nothing).count() == 0
    assert not langid.has_letter("123 !? ٣".encode()) and langid.has_letter("٣ é".encode())


def test_language_learns_from_what_it_may(spark):
    rows = [(i, "abc " * 30, "good" if zlib.crc32(str(i).encode()) % 4 != 2 else "bad") for i in range(60)]
    assert langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string")).languages == ["good"]


def test_windows_cover_whole_texts():
    for n in (0, 1, 255, 256, 257, 5000):
        text = bytes(1 + i % 255 for i in range(n))
        assert langid.cut(text).tobytes().rstrip(b"\0") == text


# 7


def brute_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def test_myers_distance():
    rng = np.random.default_rng(5)
    for _ in range(500):
        p, t = ("".join(rng.choice(list("abc"), rng.integers(lo, hi))) for lo, hi in ((1, 14), (0, 22)))
        k = int(rng.integers(0, 9))
        found, true = decontaminate.distance(decontaminate.bits(p), len(p), t, k)[0], brute_distance(p, t)
        assert found == (true if true <= k else k + 1)


def test_matches_equal_brute_force():
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcd"), rng.integers(1, 6)))
    for _ in range(300):
        item = " ".join(word() for _ in range(rng.integers(3, 12)))
        changed = list(item)
        for _ in range(rng.integers(0, 8)):
            at = int(rng.integers(0, max(1, len(changed))))
            changed[at : at + int(rng.integers(0, 2))] = list(rng.choice(list("abcd"), rng.integers(0, 2)))
        text = f"{word()} {word()} {''.join(changed)} {word()}"
        matcher = decontaminate.Matcher([item.encode()], 0.2)
        found = matcher.matches(text.encode())
        true = brute_distance(matcher.items[0].text, decontaminate.normalised(text.encode()))
        assert bool(found) == (true <= matcher.items[0].budget) and (not found or found[0][1] >= true)


def test_pieces_are_one_more_than_the_budget():
    for n in (1, 5, 9, 40, 237):
        item = decontaminate.Item("x" * n)
        assert len(item.leaves) == item.budget + 1
        assert sorted(p for leaf in item.leaves for p in range(*item.nodes[leaf][:2])) == list(range(n))


def test_decontamination(spark, docs, nothing):
    items = spark.createDataFrame([(10, "quick BROWN fox, jumps over the lazy dog"), (11, None), (12, ""), (13, "?!"), (14, "nowhere to be found in any of these documents")], "item_id long, text string")
    found = decontaminate.matches(docs, items)
    assert by_id(found, "doc_id", "item_id", "distance") == [(1, 10, 0), (1, 10, 0)]
    r = found.first()
    assert TEXTS[0][1][r.start : r.end] == "quick brown fox jumps over the lazy dog"
    edited = docs.withColumn("text", F.replace("text", F.lit("brown fox"), F.lit("brwn foxx")))
    assert by_id(decontaminate.matches(edited, items), "doc_id", "distance") == [(1, 2), (1, 2)]
    kept = decontaminate.without_matches(docs, items)
    assert kept.columns == docs.columns and kept.count() == len(TEXTS) - 2
    assert decontaminate.without_matches(docs, items.limit(0)).count() == len(TEXTS)
    assert decontaminate.matches(nothing, items).count() == 0


def test_blocks_hold_all_items(spark):
    items = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "item_id long, text string")
    got = [i for block in decontaminate.blocks(items, "item_id", "text", 40) for i, _ in block]
    assert sorted(got) == list(range(50))


# 8

BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(text):
    out = []
    for kind, pattern in BASE_PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(d - 9 if d > 9 else d for d in (int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])))
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and total % 10 == 0) or kind == "phone" and not 9 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


def test_pii_spans_on_random_texts():
    rng = np.random.default_rng(7)
    for _ in range(5000):
        text = "".join(rng.choice(list("ab.@@%_-+  0123()1."), rng.integers(0, 70)))
        assert pii.base_spans(text) == brute_spans(text)
    pii.base_spans("1" * 200_000 + "@" + "a." * 50_000)  # long runs take linear time


def test_pii_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op8_pmi_sanitiser"](spark, small).collect():
        spans = brute_spans(texts[r.doc_id])
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in spans) for kind in pii.KINDS]


def test_pii_terms_by_brute_force(spark):
    # Zorblatt stands by one address in two contexts and nowhere else; the other words are common.
    texts = ["today Zorblatt wrote ada@x.org again", "later Zorblatt sent ada@x.org more", "today someone wrote eve@y.org again", *["today someone wrote again and later sent more"] * 30]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r for r in pii.find(df).collect()}
    terms = {i: sorted(texts[i][t["start"] : t["end"]] for t in r.terms) for i, r in found.items()}
    assert terms[0] == terms[1] == ["Zorblatt"] and not any(terms[i] for i in range(2, len(texts)))
    n = len(texts)
    assert found[0].terms[0]["ratio"] == pytest.approx(np.log(2 * n / (2 * 2)) / np.log(n / 2))
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert out[0] == "today  wrote [EMAIL] again" and out[2] == "today someone wrote [EMAIL] again" and out[5] == texts[5]


def test_pii_terms_everywhere_in_documents_of_their_entity(spark):
    # Zorblatt and Wu never stand within six words of the address, and Zorblatt stands twice.
    far = "one thing that nobody would think about for very long at all here"
    texts = [f"Zorblatt Wu {far} today ada@x.org again {far} Zorblatt", f"Zorblatt Wu {far} later ada@x.org more", f"Zorblatt {far} without any address", *[f"{far} today again later more"] * 60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][t["start"] : t["end"]] for t in r.terms] for r in pii.find(df).collect()}
    assert found.pop(0) == ["Zorblatt", "Wu", "Zorblatt"] and found.pop(1) == ["Zorblatt", "Wu"] and not any(found.values())
    out = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Wu" not in out[0] + out[1] and "Zorblatt" not in out[0] + out[1] and out[2] == texts[2]
    # A name near two places of one document is marked at all of its places there.
    once = [f"Zorblatt wrote ada@x.org today {far} Zorblatt {far} later Zorblatt sent ada@x.org", *texts[3:]]
    row = pii.find(spark.createDataFrame(list(enumerate(once)), "doc_id long, text string")).where("doc_id = 0").first()
    assert [once[0][t["start"] : t["end"]] for t in row.terms].count("Zorblatt") == 3


def test_pii_cases(spark, docs, nothing):
    assert pii.find(docs).count() == len(TEXTS) and pii.find(nothing).count() == 0
    out = pii.sanitise(docs)
    assert out.columns == docs.columns and out.count() == len(TEXTS)
    six = out.where("doc_id = 6").first().text
    assert six == "Mail [EMAIL] or [PHONE], 10.0.0.256 no, [IP] yes, [CARD]."
    assert sorted(str(r.text) for r in out.where("doc_id is null or doc_id <> 6").collect()) == sorted(str(t) for i, t in TEXTS if i != 6)
    assert pii.replaced("abcdef", [("email", 1, 4), ("phone", 2, 5)], []) == "a[EMAIL]f"


# 9


def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), 42) for i in range(max(1, len(words) - 2))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(prints):
    """Of (id, print) rows: the least id that each reaches."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return [least.get(find(i)) for i in range(len(prints))]


def test_simhash_query(spark, small):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    prints = [(i, brute_print(t)) for i, t in texts]
    wanted = sorted((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_classes(prints), strict=True))
    assert by_id(QUERIES["op9_simhash_trie"](spark, small), "doc_id", "fingerprint", "component_id") == sorted(wanted, key=repr)


def test_simhash_cases(spark, docs, nothing):
    prints = [(i, brute_print(t)) for i, t in TEXTS]
    found = simhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in found), key=repr) == sorted(((i, p, c) for (i, p), c in zip(prints, brute_classes(prints), strict=True)), key=repr)
    assert simhash.near_duplicates(nothing).count() == 0
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and by_id(kept, "doc_id") == [(1,), (2,), (5,), (6,), (7,), (None,)]


def test_one_row_of_each_class_whatever_its_id(spark):
    words = [f"word{i}" for i in range(1000)]
    near = [" ".join(words), " ".join([*words[:200], "other", *words[201:]]), " ".join([*words, "more"])]
    far = [" ".join(f"{k}{i}" for i in range(90)) for k in "xyz"]
    classes = brute_classes(list(enumerate(map(brute_print, [*near, *far]))))
    assert classes == [0, 0, 0, 3, 4, 5]
    # Null-id copies beside an identified one, a class without ids, and one id in two classes and twice in one.
    rows = [*((None, t) for t in near), (9, near[1]), (None, near[1]), (None, far[0]), (None, far[0]), (4, far[1]), (4, far[2]), (4, far[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    wanted = sorted([(9, near[1]), (None, far[0]), (4, far[1]), (4, far[2])], key=repr)
    assert by_id(simhash.one_of_each(df), "doc_id", "text") == wanted
    unnamed = spark.createDataFrame([(None, t) for t in near], "doc_id long, text string").repartition(3)
    assert simhash.one_of_each(unnamed).count() == 1


@pytest.mark.parametrize("hot", [simhash.HOT, 3, 0])
def test_trie_join_equals_brute_force(spark, hot):
    rng = np.random.default_rng(8)
    centres = rng.integers(0, 2**63, 40, dtype=np.uint64)
    values = set(centres.tolist())
    for c in centres[:20].tolist():  # clusters, with chains of single flips
        for _ in range(12):
            c ^= sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(1, 3)))
            values.add(c)
    values |= {0, 2**64 - 1, 1, 3, 7}
    rows = [(i, v) for i, v in enumerate(sorted(values))]
    df = spark.createDataFrame([(v - 2**64 if v >> 63 else v,) for _, v in rows], "fp long")
    root = {v: v for _, v in rows}
    found = components(simhash.links(df, Scratch(spark, "t"), hot), Scratch(spark, "t")).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.root, set()).add(r.node % 2**64)
    wanted = {}
    for (i, v), c in zip(rows, brute_classes(rows), strict=True):
        wanted.setdefault(c, set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in wanted.values() if len(g) > 1) and root


def test_trie_links_find_each_pair_once():
    rng = np.random.default_rng(9)
    a = np.unique(rng.integers(0, 1 << 12, 300, dtype=np.uint64))
    pairs = [tuple(sorted(p)) for i, j in simhash.trie_links(a, np.array([0]), np.array([len(a)])) for p in zip(i.tolist(), j.tolist(), strict=True)]
    wanted = {(i, j) for i in range(len(a)) for j in range(i + 1, len(a)) if bin(int(a[i] ^ a[j])).count("1") <= 2}
    assert len(pairs) == len(set(pairs)) and set(pairs) == wanted


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (None, 3)], "u long, v long")
    assert {(r.node, r.root) for r in components(edges, Scratch(spark, "t")).collect()} == {(i, 0) for i in range(201)}


# 10


def test_packing_query(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    check_packing(QUERIES["op10_linear_grouping"](spark, small).collect(), [*texts.items()])


def check_packing(rows, texts):
    wanted = []
    for (i, _), e in zip(texts, tokenizer().encode_batch([t or "" for _, t in texts], add_special_tokens=False), strict=True):
        ids = np.array([*e.ids, 0], "<u4")
        wanted += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(wanted, key=repr)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(r.length for r in rows)
    assert len(bins) <= 1.02 * total / 2048 + 1


def test_packing_of_one_repeated_row(spark):
    rows = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one two three").alias("text"))
    check_packing(packing.packed_documents(rows).collect(), [(1, "one two three")] * 3000)


def test_packing_cases(docs, nothing):
    check_packing(packing.packed_documents(docs).collect(), TEXTS)
    assert packing.packed_documents(nothing).count() == 0
    with_ids = packing.packed_documents(docs, with_ids=True).where("doc_id = 3").first()
    assert with_ids.ids == [0] and with_ids.length == 1


def test_histogram_packing():
    rng = np.random.default_rng(10)
    for _ in range(40):
        capacity = int(rng.choice([20, 64, 2048]))
        counts = {int(k): int(rng.integers(1, rng.choice([3, 500]))) for k in rng.integers(1, capacity + 1, rng.choice([1, 5, 60]))}
        runs = packing.pack_histogram(counts, capacity)
        held = Counter()
        for r in runs:
            assert r.count > 0 and r.left == capacity - sum(k * n for k, n in r.parts) >= 0
            for k, n in r.parts:
                held[k] += n * r.count
        assert held == counts
        where = packing.places(runs)
        assert sum(r.count * n for r in runs for _, n in r.parts) == sum(counts.values()) and len(where["length"]) == sum(len(r.parts) for r in runs)
    # Three thirds fill a sequence: best fit of decreasing halves and thirds leaves none open.
    assert sum(r.count for r in packing.pack_histogram({512: 400, 1024: 200}, 2048)) == 200
    assert packing.pack_histogram({}, 2048) == []


def test_ids_equal_the_tokenizer():
    import public_tokenizers

    rng = np.random.default_rng(11)
    letters = list("abcAB'stve dm  ll0123456789!?.,<|>endoftextÉéßÿ×÷İıſΣς́ ½²\x1c\x85\n\t漢字🙂_-ǅ")
    texts = ["".join(rng.choice(letters, rng.integers(0, 45))) for _ in range(800)] + ["a<|endoftext|>b <|startoftext|>", "it's IT'S 'S x''s", "z" * 5000]
    got = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 500)([t.encode() for t in texts])
    for t, g, e in zip(texts, got, tokenizer().encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(g, "<u4").tolist() == e.ids, t


def test_parts_by_ranks_equal_the_tokenizer():
    """Two tokens side by side, words of any letters, marks: the ids of the given tokenizer itself."""
    import random

    import public_tokenizers

    encode, rng = packing.WordIds(public_tokenizers.path("word_bpe_49k.json"), 100), random.Random(5)
    assert encode.fast is not None
    tokens = [t.removesuffix("</w>") for t in encode.tokenizer.get_vocab(with_added_tokens=False)]
    made = {rng.choice(tokens) + rng.choice(tokens) + rng.choice(["", *tokens[:500]]) for _ in range(40_000)}
    made |= {"".join(rng.choice("abcdefghijklmnopqrstuvwxyzàéüß") for _ in range(rng.randrange(1, 30))) for _ in range(20_000)} | {"a" * 5000, "".join(rng.choice("!?.,-") for _ in range(3000))}
    parts = sorted({p for w in made if encode.PLAIN.fullmatch(w) and "<|" not in w for p in encode.PARTS.findall(w.lower())})
    assert len(parts) > 30_000 and encode._parts(parts) == encode._each(parts)


# The rest


def test_pieces_are_bounded():
    batch = pa.RecordBatch.from_arrays([pa.array(["x" * n for n in [10] * 50 + [5000] + [10] * 50])], ["t"])
    parts = list(pieces(batch, 200))
    assert sum(p.num_rows for p in parts) == 101 and all(p.num_rows == 1 or p.nbytes <= 1000 for p in parts)
    assert [v for p in parts for v in p.column(0).to_pylist()] == batch.column(0).to_pylist()


def test_pipeline(spark, small):
    import corpus_pipeline

    from test_similar import check_against_similarity

    docs = spark.read.parquet(f"{small}/documents.parquet")
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = Scratch(spark, "t").keep(stage(spark, now, small))
        assert now.columns == docs.columns, name
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    given = sorted((r.doc_id, r.text) for r in docs.collect())
    assert kept["language"] == {i for i, _ in given}
    check_against_similarity([t for _, t in given], [n for n, (i, _) in enumerate(given) if i in kept["near_duplicates"]])
    items = [decontaminate.normalised(r.text.encode()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    for r in now.collect():
        assert not any(i in decontaminate.normalised(r.text.encode()) for i in items) and not brute_spans(r.text) and r.n_chars == len(r.text)
    rows = corpus_pipeline.run(spark, small).collect()
    check_packing(rows, [(r.doc_id, r.text) for r in now.collect()])


def test_every_language_is_learned(spark, monkeypatch):
    """However many there are, each is in the sample."""
    monkeypatch.setattr(langid, "ALL_DOCS", 12)
    rows = [(i, f"{'abcdefghij'[i % 30 % 10] * 6} {i % 30} text", f"l{i % 30}") for i in range(600)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert net.languages == sorted({f"l{k}" for k in range(30)})


def test_an_id_that_fills_a_language_leaves_its_others_in(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2][:120]
    rows = [(i, f"the {i} words of it", "en") for i in ids[:60]] + [(i, f"les {i} mots de la", "fr") for i in ids[60:]]
    one = next(i for i in range(1000, 1100) if zlib.crc32(str(i).encode()) % 4 != 2)
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    many = spark.range(100_000).select(F.lit(one).cast("long").alias("doc_id"), F.lit("les mots encore").alias("text"), F.lit("fr").alias("lang"))
    net = langid.fit(df.unionByName(many))
    assert net.languages == ["en", "fr"]
    # A very long text, and two languages that a network without weights finds equal: the first of them.
    for w in (net.weights, net.offset):
        w[:] = 0
    found = langid.predict(spark.createDataFrame([("word " * 300_000,), (None,), ("12",)], "text string"), net).collect()
    assert [(r["lang_pred"], r["score"]) for r in found] == [("en", 0.5), ("und", 0.0), ("und", 0.0)]


def test_language_by_a_plain_forward_pass():
    """Windows of a small network, filter by filter."""
    rng = np.random.default_rng(3)
    windows = rng.integers(0, 256, (6, langid.WINDOW)).astype(np.uint8)
    net = langid.train(windows, np.array([0, 1, 2, 0, 1, 2]), ["a", "b", "c"])
    taps = max(langid.WIDTHS)
    for window, p in zip(windows, net.probabilities(windows), strict=True):
        seen = np.concatenate([net.embedding[window], np.repeat(net.embedding[:1], taps - 1, axis=0)])
        pooled = [max(float(seen[i : i + taps].ravel() @ net.filters[:, f]) for i in range(langid.WINDOW)) + net.bias[f] for f in range(net.filters.shape[1])]
        z = np.maximum(pooled, 0) @ net.weights + net.offset
        assert np.allclose(np.exp(z - z.max()) / np.exp(z - z.max()).sum(), p, atol=1e-4)


def test_pipeline_language_stage_heeds_the_prediction(spark, monkeypatch):
    import corpus_pipeline
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(1, "sure", "en"), (2, "unsure", "en"), (3, "half", "de"), (4, "none", None)], "doc_id long, text string, lang string")
    told = lambda rows, *_: rows.withColumn("lang_pred", F.when(F.col("__text") == "none", "und").otherwise("en")).withColumn("score", F.expr("case __text when 'sure' then 0.9 when 'half' then 0.5 else 0.3 end"))
    monkeypatch.setattr(langid, "fit", lambda *_: None)
    monkeypatch.setattr(langid, "predict", told)
    assert sorted(r["doc_id"] for r in corpus_pipeline.known_language(spark, docs, "").collect()) == [1, 3]
